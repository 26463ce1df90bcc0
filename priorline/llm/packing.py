"""Best-fit packing of token sequences with a swap-based local search.

Documents become ids (an end id after each); one longer than a sequence is cut into full pieces behind
a first piece with what is left over. Pieces are dealt by hash into groups of bounded size, which Spark
packs in parallel: best fit in order of size, then a local search over the bins that aren't full. The
emptiest bin gives its pieces away: one moves into another bin's gap, or one or two of them change
places with a smaller piece of another bin, always so that the other bin fills up and the sum of squared
fills grows, until the bin is empty or no exchange is left. Bins that aren't full in their groups are
dealt anew, whole, in groups of that size again, and packed once more.

Within a group the search takes all pieces and pairs of a bin and all sums, and ends only when no move or exchange is
left or the number of bins meets its lower bound. Rounds over groups end when one frees less than a bin a group.

Defined cases: a null or empty text is a piece of one end id; documents of any length are cut; equal
lengths are taken in order of (doc_id, piece); rows that repeat are packed as often as they come; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import pieces, release_memory
from priorline.llm.tokens import AT_ONCE, FEW_KNOWN, MOST_KNOWN, encoder
from priorline.session import materialize

TOKENIZER, END_ID, CAPACITY = "byte_bpe_50k.json", 0, 2048
#: Pieces that one task packs at most, about.
GROUP_PIECES = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, fill long"


def cut(n_ids: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = n_ids % capacity or min(n_ids, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n_ids, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, keep_words: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each document. Without ``keep_words`` a task leaves
    no tokenizer in its worker, which stages of other kinds go on to use: less memory for some time to load it again."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, True, "<u4", most_known=MOST_KNOWN if keep_words else FEW_KNOWN)
        for batch in batches:
            for a, b in pieces(batch.column(1), AT_ONCE if keep_words else AT_ONCE // 2):
                ids, texts = batch.column(0).slice(a, b - a).to_pylist(), encode.many(batch.column(1).slice(a, b - a))
                rows = []
                for doc_id, packed in zip(ids, texts, strict=True):
                    packed += end
                    for k, (start, n) in enumerate(cut(len(packed) // 4, capacity)):
                        rows.append((doc_id, k, start, n, zlib.crc32(packed[4 * start : 4 * (start + n)])))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        if not keep_words:
            del encode
            encoder.cache_clear()
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def fewest(lengths: list[int], capacity: int = CAPACITY) -> int:
    """A number of bins that no packing is below: by the sum, and as a bin takes at most k pieces of over
    1 / (k + 1) of it."""
    ordered = np.sort(np.asarray(lengths))
    over = [-(-(len(ordered) - int(np.searchsorted(ordered, capacity // (k + 1), "right"))) // k) for k in range(1, 9)]
    return max(math.ceil(int(ordered.sum()) / capacity), *over)


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices into ``lengths``, whose sums are at most ``capacity``: best fit in order of size,
    then the local search."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin has r free places
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            rooms ^= (not by_room[room]) << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return _local_search(bins, lengths, capacity)


def _local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = fewest(lengths, capacity)
    open_bins = {b for b in range(len(bins)) if fill[b] < capacity}
    used = len(bins)
    # For each sum of a piece and its bin's free places, by the piece's length: pieces that could make way for one of that size.
    makes_way: dict[int, dict[int, list[tuple[int, int]]]] = {}
    sums: list[int] = []

    def offer(b: int) -> None:
        for i in bins[b]:
            key = lengths[i] + capacity - fill[b]
            if key not in makes_way:
                makes_way[key] = {}
                bisect.insort(sums, key)
            makes_way[key].setdefault(lengths[i], []).append((b, i))

    def changed(b: int) -> None:
        if fill[b] == capacity or not bins[b]:
            open_bins.discard(b)
            return
        offer(b)
        bisect.insort(rooms, (capacity - fill[b], b))

    for b in open_bins:
        offer(b)
    moved: int | None = 0
    while moved is not None and used > least:  # until a round finds nothing; each exchange adds to the sum of squared fills
        moved = None
        for source in sorted(open_bins, key=lambda b: fill[b]):
            rooms = sorted((capacity - fill[b], b) for b in open_bins if b != source)
            was = fill[source]
            while used > least and source in open_bins:
                target = _give_away(source, bins, lengths, fill, capacity, rooms, makes_way, sums, open_bins)
                if target is None:
                    break
                moved = target
                changed(target)
                used -= not bins[source]
            if fill[source] != was:
                changed(source)
    return [b for b in bins if b]


def _give_away(source, bins, lengths, fill, capacity, rooms, makes_way, sums, open_bins) -> int | None:
    """One move or exchange out of ``source``; the bin that filled up, or None where there is none."""
    own = sorted({lengths[i]: i for i in bins[source]}.items(), reverse=True)  # pieces of one length are alike
    for n, i in own:  # a move, into the smallest gap that takes it
        at = bisect.bisect_left(rooms, (n, -1))
        while at < len(rooms):
            room, b = rooms[at]
            if b not in open_bins or capacity - fill[b] != room:
                del rooms[at]
            elif fill[b] + n <= fill[source]:  # else squared fill wouldn't grow; emptier bins stand behind this one
                break
            else:
                bins[source].remove(i)
                bins[b].append(i)
                fill[source] -= n
                fill[b] += n
                return b
    room = capacity - fill[source]
    for size, given in _offers(bins[source], lengths):  # one for one, two for one
        # A sum of size + room or more leaves the other bin no fuller than this one is.
        for key in sums[bisect.bisect_left(sums, size) : bisect.bisect_left(sums, size + room)]:
            found = _standing(makes_way[key], key, size, source, bins, lengths, fill, capacity, open_bins)
            if found is None:
                continue
            b, j = found
            for i in given:
                bins[source].remove(i)
            bins[b].remove(j)
            bins[source].append(j)
            bins[b].extend(given)
            fill[source] += lengths[j] - size
            fill[b] += size - lengths[j]
            return b
    return None


def _offers(members: list[int], lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """All sums of one or two of a bin's pieces, largest first, each with pieces that have it."""
    alike: dict[int, list[int]] = {}
    for i in members:
        alike.setdefault(lengths[i], []).append(i)
    found: dict[int, tuple[int, ...]] = {}
    for n, at in alike.items():
        for m, other in alike.items():
            if n < m:
                found[n + m] = (at[0], other[0])
        if len(at) > 1:
            found.setdefault(2 * n, (at[0], at[1]))
    return sorted((found | {n: (at[0],) for n, at in alike.items()}).items(), reverse=True)


def _standing(entries, key, size, source, bins, lengths, fill, capacity, open_bins) -> tuple[int, int] | None:
    """The bin and its shortest piece below ``size`` that still make up the sum ``key``; what no longer does goes."""
    for n in sorted(entries):
        if n >= size:
            return None
        at = len(entries[n]) - 1
        while at >= 0:
            b, j = entries[n][at]
            if b == source:  # its entries come back when it has changed
                at -= 1
            elif b not in open_bins or capacity - fill[b] != key - n or j not in bins[b]:
                del entries[n][at]
                at -= 1
            else:
                return b, j
        if not entries[n]:
            del entries[n]
    return None


def _pack_group(table: pa.Table, capacity: int) -> pa.Table:
    """One group's pieces with sequence_id, offset and fill of the sequence."""
    group = table.column("group")[0].as_py()
    table = table.drop_columns("group").sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "start")])
    sequence, offset, fill = (np.zeros(len(table), dtype=np.int64) for _ in range(3))
    lengths = table.column("length").to_pylist()
    for k, members in enumerate(pack_lengths(lengths, capacity)):
        at = 0
        for i in members:
            sequence[i], offset[i] = (group << 32) + k, at
            at += lengths[i]
        fill[members] = at
    for name, column in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
        table = table.append_column(name, pa.array(column))
    return table


def pack_pieces(cut_pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset. ``cut_pieces``, a written table, is read twice: for its count and for
    packing. Groups are dealt by a row's place in its files, so no doc_id makes a group larger."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    groups = max(1, math.ceil(cut_pieces.count() / group_pieces))
    dealt = cut_pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        return _pack_group(table, capacity)

    packed = materialize(dealt.groupBy("group").applyInArrow(run, PLACED), "packed")
    full, taken = [], groups
    while groups > 1:
        again = packed.where(F.col("fill") < capacity)
        rows, before = again.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        full.append(packed.where(F.col("fill") == capacity))
        groups = max(1, math.ceil(rows / group_pieces))
        dealt = again.select(*names, (taken + F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).cast("long").alias("group"))
        packed = materialize(dealt.groupBy("group").applyInArrow(run, PLACED), "packed")
        taken += groups
        if before - packed.where(F.col("offset") == 0).count() < groups:
            break
    return reduce(DataFrame.unionByName, [*full, packed]).drop("fill")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, keep_words: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(materialize(token_pieces(docs, tokenizer, end_id, capacity, keep_words), "pieces"), capacity)
