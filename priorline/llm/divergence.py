"""Source divergence audit: how the words of a source differ from those of its language's other sources.

Terms are packed by length. A chunk's bytes are cut into terms by numpy; terms of up to 8 bytes become one uint64,
those of up to 16 bytes two, and are put in order by a radix sort of 16-bit digits; longer ones go to a bucket for
each power of two of their length and are sorted there as bytes. Equal neighbours are runs, whose lengths are the
counts and whose changes of document the numbers of documents. Spark adds the runs of all chunks by language, source
and term; a term's row then has one count for each source that holds it, and tasks take blocks of such rows, as a
matrix of terms by sources, to sums for each pair of sources. No pair of rows is ever made for a term.

All arithmetic is on whole numbers. A kept term (in LEAST_DOCS documents of a language at least) has in a group
p = 1 + floor(SCALE * (count + 1) / (N + V)), N the group's kept occurrences, V the language's kept terms; a pair's
value is the sum of floor((p - q) * (p - q) / q) over all kept terms. N + V must stay below 9e15.

A language's sources are held as one array, and a task holds sources by sources numbers for each language (8 bytes each,
as many as the result has rows) up to MOST_CELLS; beyond, it gives them out with each batch of terms.

Defined cases: null text, lang and source are ''; a group without a term still has its rows of part pair, 0 where its
language keeps no term; repeated rows count as often as they come; a row is a document, whatever its doc_id; texts count
whole, however long; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import pieces, release_memory
from priorline.session import materialize

SCALE, LEAST_DOCS, TOP_TERMS = 1_000_000_000, 3, 200
#: Bytes of text at once; cells of a matrix of terms by sources, and of the sums that a task holds.
AT_ONCE, BLOCK_CELLS, MOST_CELLS = 8_000_000, 1 << 18, 1 << 22

#: Bytes of terms: ASCII letters and all of characters beyond ASCII. Only A-Z are lowered.
_IN_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_LOWERED = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
#: Keeps the first k bytes of a big-endian word.
_FIRST = np.array([0] + [(1 << 64) - (1 << 64 - 8 * k) for k in range(1, 9)], np.uint64)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order by ``keys``, the most important one last: passes over 16-bit digits, which numpy's stable sort
    takes by radix. Digits that are the same everywhere take no pass."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, 8 * key.dtype.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if (digit != digit[:1]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def find_terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of each term of documents that lie one after the other, from bounds[d] to bounds[d + 1]."""
    inside = np.r_[_IN_TERM[data], False]
    fresh = np.r_[True, ~inside[:-1]]
    fresh[bounds] = True
    starts = np.flatnonzero(inside & fresh)
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | fresh[1:])) + 1
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds)))
    return starts, ends - starts, docs


def count_runs(data: np.ndarray, bounds: np.ndarray, groups: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The different (term, group) with their occurrences and documents, ``groups`` a number for each document."""
    starts, lengths, docs = find_terms(data, bounds)
    width = max(16, 1 << int(lengths.max(initial=1) - 1).bit_length())
    low = np.r_[_LOWERED[data], np.zeros(width, np.uint8)]
    words = np.ndarray((len(low) - 7,), ">u8", low, strides=(1,))
    rows = np.ndarray((len(low) - width + 1, width), np.uint8, low, strides=(1, 1))
    kinds = np.where(lengths <= 8, 0, np.where(lengths <= 16, 1, np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)))
    raw = low.tobytes()
    terms: list[bytes] = []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for kind in np.flatnonzero(np.bincount(kinds)).tolist() if len(starts) else []:
        at = np.flatnonzero(kinds == kind)
        s, n, d = starts[at], lengths[at], docs[at]
        g = groups[d].astype(np.uint32)
        if kind < 2:
            packed = [words[s + 8].astype(np.uint64) & _FIRST[n - 8]] if kind else []
            packed.append(words[s].astype(np.uint64) & _FIRST[np.minimum(n, 8)])
            order = radix_order([g, *packed])
        else:
            cells = rows[s, : 1 << kind]
            cells[np.arange(1 << kind) >= n[:, None]] = 0
            packed = [cells.view(f"S{1 << kind}").ravel()]
            order = radix_order([g])
            order = order[np.argsort(packed[0][order], kind="stable")]
        g, d = g[order], d[order]
        new = np.r_[True, g[1:] != g[:-1]]
        for p in packed:
            new[1:] |= p[order[1:]] != p[order[:-1]]
        first = np.flatnonzero(new)
        new[1:] |= d[1:] != d[:-1]
        found.append((g[first], np.diff(np.r_[first, len(g)]), np.add.reduceat(new.astype(np.int64), first)))
        one = order[first]
        terms += [raw[a:b] for a, b in zip(s[one].tolist(), (s[one] + n[one]).tolist(), strict=True)]
    if not found:
        return [], *(np.zeros(0, np.int64) for _ in range(3))
    return terms, *(np.concatenate(x) for x in zip(*found, strict=True))


def count_terms(docs: DataFrame) -> DataFrame:
    """Rows lang, source, term, n (occurrences), docs, one for each; those of a null term stand for the groups themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(0), AT_ONCE):
                part = batch.slice(a, b - a)
                text, lang, source = part.columns
                sizes = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset).astype(np.int64)
                data = np.frombuffer(text.buffers()[2], np.uint8)[sizes[0] : sizes[-1]] if sizes[-1] > sizes[0] else np.zeros(0, np.uint8)
                lang, source = lang.dictionary_encode(), source.dictionary_encode()
                pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                different, groups = np.unique(pair, return_inverse=True)
                terms, of, n, docs_ = count_runs(data, sizes - sizes[0], groups)
                of = different[np.r_[of, np.arange(len(different))].astype(np.int64)]
                none = np.zeros(len(different), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))),
                        pa.array([*terms, *[None] * len(different)], pa.binary()).cast(pa.string()), pa.array(np.r_[n, none]), pa.array(np.r_[docs_, none]),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
        release_memory()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / sizes) in whole numbers, three digits at a time."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, sizes).shape, np.int64)
    whole = rest // sizes
    rest = rest - whole * sizes
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // sizes
        rest = rest % sizes
    return 1 + whole * SCALE + out


def pair_sums(kept: DataFrame) -> DataFrame:
    """lang, g, h, value from rows lang, v, sizes (an array by source number), of, n (numbers of sources and their counts;
    null in a row that stands for a language as such)."""

    def rows_of(lang: str, sums: np.ndarray) -> pa.RecordBatch:
        g, h = (x.ravel() for x in np.indices(sums.shape))
        other = g != h
        columns = [pa.array([lang] * int(other.sum()), pa.string()), *(pa.array(x[other].astype(np.int32)) for x in (g, h)), pa.array(sums.ravel()[other])]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "g", "h", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            numbers = langs.indices.to_numpy()
            for k in np.unique(numbers).tolist():
                name, mine = langs.dictionary[k].as_py(), np.flatnonzero(numbers == k)
                part = batch.take(pa.array(mine))
                sizes = np.array(part.column(2)[0].as_py(), np.int64) + part.column(1)[0].as_py()
                sums = held.get(name)
                if sums is None:
                    sums = np.zeros((len(sizes), len(sizes)), np.int64)
                part = part.filter(part.column(3).is_valid())
                step = max(1, BLOCK_CELLS // len(sizes))
                for at in range(0, part.num_rows, step):
                    block = part.slice(at, step)
                    counts = np.zeros((block.num_rows, len(sizes)), np.int64)
                    row = np.repeat(np.arange(block.num_rows), block.column(3).value_lengths().to_numpy())
                    counts[row, block.column(3).flatten().to_numpy()] = block.column(4).flatten().to_numpy()
                    p = shares(counts, sizes)
                    for g in range(len(sizes)):
                        off = p[:, g : g + 1] - p
                        sums[g] += (off * off // p).sum(0)
                if sum(x.size for x in held.values()) + sums.size > MOST_CELLS:
                    yield rows_of(name, sums)
                    held.pop(name, None)
                else:
                    held[name] = sums
        for name, sums in held.items():
            yield rows_of(name, sums)

    sums = kept.select("lang", "v", "sizes", "of", "n").mapInArrow(run, "lang string, g int, h int, value long")
    return sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def _share(n: str, size: str) -> str:
    return f"1 + (cast({n} + 1 as decimal(20, 0)) * cast({SCALE} as decimal(10, 0))) div cast({size} + v as decimal(20, 0))"


def audit(docs: DataFrame) -> DataFrame:
    """Per document group (lang, source): part pair with the divergence from each other source of its language, part term
    with the TOP_TERMS terms that it has beyond its language's share."""
    counts = materialize(count_terms(docs), "term_counts")
    numbered = counts.where("term is null").select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("of"))
    sources = materialize(numbered, "sources")
    # A few rows a language where sources are few, and Spark broadcasts only what is under its threshold.
    held = counts.where("term is not null").join(sources, ["lang", "source"])
    by_term = held.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("of", "n")).alias("held")).where(F.col("docs") >= LEAST_DOCS)
    terms = materialize(by_term.select("lang", "term", "held.of", "held.n"), "kept_terms")
    found = terms.select("lang", F.explode(F.arrays_zip("of", "n")).alias("x")).groupBy("lang", "x.of").agg(F.sum("x.n").alias("size"))
    sized = sources.join(found, ["lang", "of"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("of", F.coalesce("size", F.lit(0)).alias("size")))).alias("s"))
    kept_terms = terms.groupBy("lang").agg(F.count("*").alias("v"))
    languages = materialize(sized.join(kept_terms, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.col("s.size").alias("sizes")), "languages")

    rows = terms.join(languages, "lang")
    as_such = languages.select("lang", F.lit(None).cast("string").alias("term"), F.lit(None).cast("array<int>").alias("of"), F.lit(None).cast("array<bigint>").alias("n"), "v", "sizes")
    sums = pair_sums(rows.select(as_such.columns).unionByName(as_such))
    name = lambda number, alias: sources.select("lang", F.col("of").alias(number), F.col("source").alias(alias))
    pairs = sums.join(name("g", "source"), ["lang", "g"]).join(name("h", "item"), ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    whole = rows.withColumn("all_n", F.expr("aggregate(n, 0L, (a, x) -> a + x)")).withColumn("all_size", F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))
    each = whole.select("*", F.explode(F.arrays_zip("of", "n")).alias("x")).select("lang", "v", "term", "all_n", "all_size", "x.of", F.col("x.n").alias("own_n"), F.element_at("sizes", F.col("x.of") + 1).alias("own_size"))
    over = each.withColumn("p", F.expr(_share("own_n", "own_size"))).withColumn("q", F.expr(_share("all_n", "all_size"))).where("p > q")
    best = Window.partitionBy("lang", "of").orderBy(F.col("value").desc(), "term")
    top = over.withColumn("value", F.expr("(p - q) * (p - q) div q")).select("lang", "of", "term", "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP_TERMS)
    top = top.join(sources, ["lang", "of"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    return ranked.unionByName(top)


ORACLE = r"""
with d as (
  select coalesce(lang, '') lang, coalesce(source, '') source,
         list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) terms
  from documents),
grp as (select distinct lang, source from d),
kept as (select lang, term from (select lang, unnest(list_distinct(terms)) term from d) group by 1, 2 having count(*) >= 3),
counts as (select lang, source, term, count(*)::bigint n from (select lang, source, unnest(terms) term from d) join kept using (lang, term) group by 1, 2, 3),
v as (select lang, count(*)::bigint v from kept group by 1),
size as (select lang, source, sum(n)::bigint size from counts group by 1, 2),
dense as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) n,
         1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (coalesce(s.size, 0) + v.v) p
  from grp g join kept k using (lang) join v using (lang) left join counts c on (c.lang, c.source, c.term) = (g.lang, g.source, k.term)
       left join size s on (s.lang, s.source) = (g.lang, g.source)),
whole as (
  select k.lang, k.term, 1 + 1000000000::hugeint * (c.n + 1) // (s.size + v.v) q
  from kept k join v using (lang) join (select lang, term, sum(n) n from counts group by 1, 2) c using (lang, term) join (select lang, sum(size) size from size group by 1) s using (lang)),
sums as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) value from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(s.value, 0)::bigint as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source left join sums s on (s.lang, s.source, s.item) = (a.lang, a.source, b.source)),
terms as (select d.lang, d.source, 'term' part, d.term item, ((d.p - w.q) * (d.p - w.q) // w.q)::bigint as value from dense d join whole w using (lang, term) where d.n > 0 and d.p > w.q)
select lang, source, part, item, value, rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int rank from (select * from pairs union all select * from terms))
where part = 'pair' or rank <= 200
"""
