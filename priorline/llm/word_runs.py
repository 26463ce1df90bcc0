"""Periodic runs of words: stretches that repeat with a period, found through Lyndon roots.

The first phase of Baier's suffix sorter groups suffixes by their longest Lyndon prefix: groups start as equal words, are taken
from the greatest down, and each one moves the nearest suffix to the left of every member that is in a smaller group to a
group of its own, whose prefix is the old one followed by the taken group's. When a group is taken its prefix is final, so
the phase gives the Lyndon array (lengths of longest Lyndon words), and equal groups are equal Lyndon words. It is run under
the order of the words and under the opposite one; every run has, under one of the two, a longest Lyndon word of its
period's length as root. Roots that follow an equal one are skipped, the others are extended to both sides by counting
equal words (LCE), and what reaches the least length is a run.

Only words that a run can hold are sorted: a run of LEAST or more words with at least two periods is covered by strings of
LEAST / 2 words that occur twice in their document, so stretches without such strings are left out beforehand. That
changes no run.

Work is per chunk of whole documents inside a task, so nothing is shuffled; memory follows the chunk or the longest document.

Defined cases: null and empty texts have no words and no runs; words are cut at ASCII white space; of a run's words those after its
first period are dropped; repeated rows are searched each; a null doc_id counts as ''; a document is one piece of work, however
long; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import pieces, release_memory

LEAST = 12
#: Bytes of text at once, words that are sorted at once (a single stretch aside), steps of extension for all candidates together.
AT_ONCE, SORTED_AT_ONCE, STEPS = 4_000_000, 200_000, 64
#: Strings are first told apart by so many bits.
TABLE_BITS = 22


def lyndon_groups(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length of the longest Lyndon word at each place of ``word``, and a number that is the same where these words are."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(word, kind="stable")
    new = np.flatnonzero(np.r_[True, word[order[1:]] != word[order[:-1]]])
    # A group is the interval of ranks [begin, end) and is named by its begin.
    begins, ends = new.tolist(), [*new[1:].tolist(), n]
    sizes = np.diff(np.r_[new, n])
    group = np.empty(n, np.int64)
    group[order] = np.repeat(new, sizes)
    group, members = group.tolist(), dict(zip(begins, np.split(order, new[1:]), strict=True))
    members = {b: m.tolist() for b, m in members.items()}
    end_of, begin_at, length = dict(zip(begins, ends, strict=True)), dict(zip(ends, begins, strict=True)), dict.fromkeys(begins, 1)
    # Places whose group isn't taken yet, as a list with links to both sides; n stands for none.
    left, right = [n, *range(n)], [*range(1, n + 1), 0]
    found = [0] * n
    end = n
    while end:
        taken = begin_at[end]
        size = length[taken]
        before, times = [], []
        last = n
        for i in members.pop(taken):
            if group[i] != taken:  # moved to a greater group since
                continue
            found[i] = size
            j, k = left[i], right[i]
            right[j], left[k] = k, j
            if j != last:
                before.append(j)
                times.append(1)
                last = j
            elif j != n:
                times[-1] += 1
        end = taken
        if not before:
            continue
        for count in {1} if max(times) == 1 else sorted(set(times), reverse=True):
            moved: dict[int, list[int]] = {}
            for j, t in zip(before, times, strict=True):
                if t == count:
                    moved.setdefault(group[j], []).append(j)
            more = count * size
            for old, who in moved.items():
                stop = end_of[old]
                if stop - old == len(who):
                    length[old] += more
                    continue
                begin = stop - len(who)
                end_of[begin], begin_at[stop], end_of[old], begin_at[begin] = stop, begin, begin, old
                length[begin] = length[old] + more
                members[begin] = who
                for j in who:
                    group[j] = begin
    return np.array(found, np.int64), np.array(group, np.int64)


def _common(word: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from places a and b on (step 1) or backwards (-1); ``word`` ends on both sides in words of its own."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(STEPS):
        live = live[word[a[live] + step * k] == word[b[live] + step * k]]
        if not len(live):
            return out
        out[live] += 1
    for c in live.tolist():
        i, j, size = int(a[c]) + step * STEPS, int(b[c]) + step * STEPS, 4 * STEPS
        while True:
            if step > 0:
                x, y = word[i : i + size], word[j : j + size]
            else:
                x, y = word[max(i - size + 1, 0) : i + 1][::-1], word[max(j - size + 1, 0) : j + 1][::-1]
            n = min(len(x), len(y))
            other = np.flatnonzero(x[:n] != y[:n])
            if len(other):
                out[c] += other[0]
                break
            out[c] += n
            i, j, size = i + step * n, j + step * n, 2 * size
    return out


def find_runs(word: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least ``least`` words in ``word``, in order. Words are whole numbers from
    0 on; negative ones, each there once, part texts from one another."""
    n = len(word)
    apart = word < 0
    rows = []
    lowest = np.where(apart, word.astype(np.int64), 0)
    padded = np.r_[lowest.min(initial=0) - 1, word, lowest.min(initial=0) - 2].astype(np.int64)
    for ordered in (word, np.where(apart, word, word.max(initial=0) - word)):
        lyndon, group = lyndon_groups(ordered)
        at = np.arange(n)
        back, onward = at - lyndon, at + lyndon
        follows = (back >= 0) & (group[np.maximum(back, 0)] == group)
        onward_same = (onward < n) & (word[np.minimum(onward, n - 1)] == word)
        back_same = (at > 0) & (word[np.maximum(at - 1, 0)] == word[onward - 1])
        at = np.flatnonzero(~follows & ~apart & (onward_same | back_same))
        period = lyndon[at]
        ahead = _common(padded, at + 1, at + 1 + period, 1)
        behind = _common(padded, at, at + period, -1)
        length = behind + period + ahead
        keep = length >= np.maximum(least, 2 * period)
        rows.append(np.stack([(at - behind)[keep], length[keep], period[keep]], 1))
    found = np.unique(np.concatenate(rows), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def can_repeat(word: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Which words are in a string of ``n`` words that comes twice in its document; some more where hashes agree."""
    held = np.zeros(len(word), bool)
    if len(word) < n:
        return held
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.flatnonzero(owner[n - 1 :] == owner[: len(word) - n + 1])
    key = owner[whole].astype(np.uint64)
    for k in range(n):
        key = _mixed(key * np.uint64(0xD1342543DE82EF95) + word[whole + k].astype(np.uint64) + np.uint64(1))
    slot = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    often = np.bincount(slot, minlength=1 << TABLE_BITS)[slot] > 1
    whole, key = whole[often], key[often]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, whole[twice], 1)
    np.add.at(edge, whole[twice] + n, -1)
    return np.cumsum(edge[:-1]) > 0


def document_runs(word: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Rows (start, length, period) of all documents, starts counted from each one's first word, and the documents' numbers.
    Document d has the words from bounds[d] to bounds[d + 1]."""
    held = can_repeat(word, bounds, least // 2)
    fresh = np.r_[True, ~held[:-1]] if len(held) else held
    fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(held & fresh)
    after = np.r_[held[1:] & ~fresh[1:], False] if len(held) else held
    ends = np.flatnonzero(held & ~after) + 1
    big = ends - starts >= least
    starts, ends = starts[big], ends[big]
    rows, owners, at = [], [], 0
    while at < len(starts):
        sizes = np.cumsum(ends[at:] - starts[at:] + 1)
        to = at + max(1, int(np.searchsorted(sizes, SORTED_AT_ONCE, "right")))
        parts = zip(range(at, to), starts[at:to].tolist(), ends[at:to].tolist(), strict=True)
        flat = np.concatenate([x for k, a, b in parts for x in (word[a:b].astype(np.int64), [at - k - 1])])
        got = find_runs(flat, least)
        begins = np.r_[0, sizes[: to - at - 1]]
        stretch = np.searchsorted(begins, got[:, 0], "right") - 1
        got[:, 0] += starts[at:to][stretch] - begins[stretch]
        owner = np.searchsorted(bounds, got[:, 0], "right") - 1
        got[:, 0] -= bounds[owner]
        rows.append(got)
        owners.append(owner)
        at = to
    if not rows:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(owners)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and where each text's begin (and the last one's end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at the ends leaves empty strings
    return flat.filter(pa.array(full)), np.r_[0, np.cumsum(full)][offsets - offsets[0]]


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document doc_id, n_words, runs (an array of start, length, period by start, then period) and collapsed, its words with
    one space between, without those that a run holds after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1), AT_ONCE):
                words, bounds = split_words(batch.column(1).slice(a, b - a))
                numbered = words.dictionary_encode()
                found, owner = document_runs(numbered.indices.to_numpy(), bounds, least)
                edge = np.zeros(len(words) + 1, np.int64)
                start = bounds[owner] + found[:, 0]
                np.add.at(edge, start + found[:, 2], 1)
                np.add.at(edge, start + found[:, 1], -1)
                kept = np.cumsum(edge[:-1]) == 0
                places = np.r_[0, np.cumsum(kept)][bounds]
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(places, pa.int32()), words.filter(pa.array(kept))), " ")
                each = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(b - a + 1)), pa.int32()), each)
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), lists, texts]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _hash(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; texts of one id in ten repeat a piece of theirs from some word on."""
    words = F.filter(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", _hash(F.col("doc_id")).alias("h"))
    cut = chosen.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.expr("h div 10"))
    cut = cut.withColumn("a", F.expr("cast(if(size(w) > 0, g % size(w), 0) as int)")).withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)"))
    periodic = F.expr("concat(slice(w, 1, a), transform(sequence(a, size(w) - 1), i -> w[a + (i - a) % p]))")
    return cut.select("doc_id", F.when(F.expr("h % 10 = 0 and size(w) > 0"), F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def collapse(docs: DataFrame) -> DataFrame:
    """Per document the number of its runs, the greatest one, and digests of all runs and of the collapsed text."""
    found = runs(planted(docs)).withColumn("best", F.expr("array_min(transform(runs, r -> struct(-r.length as length, r.start as start, r.period as period)))"))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    length = -F.col("best.length")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
