"""Token ids in files, compressed by Re-Pair grammars with random access.

Documents are put in ascending order of doc_id (equal ids by the hash of the text, then the text) over range
partitions; each partition writes blocks of some million ids. In a block, pairs of neighbouring symbols are
replaced by nonterminals again and again, the most frequent first, until no pair occurs LEAST_COUNT times;
a rule costs the bytes of about four symbols. A round replaces at once all pairs whose count is within
1/STEP of the most frequent one's; overlapping occurrences are replaced from the left. The end id takes part
in no pair, so no rule reaches over the end of a document.

Block format (little-endian): magic ``RPR2``; counts of documents, symbols, rules and rounds and the bytes of
a symbol, 2 or 4 (5 x uint32); first nonterminal of each round (uint32 each); rules as pairs of symbols;
expansion length of each rule (uint32); place of each document in the symbols and in the ids (uint64 each,
one more than documents); symbols. A document is decoded from its own symbols and the rules alone.

Blocks lie as rows of Parquet files, with the partition and the place of the block in it; the number of
ids before each partition comes from one small table with a row for each partition.

Defined cases: null and empty texts are a lone end id; a document is never cut, so a very long one makes
a block larger; rows that repeat a doc_id stay; null ids come first; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import pieces, release_memory
from priorline.llm.tokens import encoder
from priorline.session import materialize

TOKENIZER, END_ID, FIRST_NONTERMINAL = "word_bpe_49k.json", 1, 49_408
#: Ids in a block; a pair's least count; a round's pairs have at least 1 / STEP of the largest count; a rule
#: that overlaps leave with fewer uses waits for a later round.
BLOCK_IDS, LEAST_COUNT, STEP, LEAST_USES = 1 << 20, 12, 32, 4
MAGIC, HEAD = b"RPR2", "<IIIII"
#: Bytes of text whose different words are looked up together: the more at once, the fewer of them.
AT_ONCE = 8_000_000
_TABLE_BITS = 18
BLOCKS = "part int, block int, first_id long, n_ids long, doc_ids array<long>, data binary"
READ = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _pairs(symbols: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of neighbours as one number, and its place in a table of 2**_TABLE_BITS."""
    kind, bits, spread = (np.uint32, 16, np.uint32(0x9E3779B1)) if narrow else (np.uint64, 32, np.uint64(0x9E3779B97F4A7C15))
    pairs = symbols[:-1].astype(kind) << kind(bits) | symbols[1:].astype(kind)
    return pairs, (pairs * spread >> kind(2 * bits - _TABLE_BITS)).astype(np.intp)


def _round(symbols: np.ndarray, first: int, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols with the most frequent pairs replaced by nonterminals from ``first`` on, and those pairs
    (left, right); no pair where none is frequent."""
    none = np.empty((0, 2), np.uint32)
    if len(symbols) < 2:
        return symbols, none
    pairs, slots = _pairs(symbols, first <= 1 << 16)
    # Pairs with an end id go to a slot of their own, behind the table.
    ends = np.flatnonzero(symbols == end_id)
    slots[ends[ends < len(slots)]] = slots[ends[ends > 0] - 1] = 1 << _TABLE_BITS
    # A slot's count is at least that of each of its pairs, so few pairs have to be sorted.
    full = np.bincount(slots, minlength=1 + (1 << _TABLE_BITS)) >= LEAST_COUNT
    full[-1] = False
    places = np.flatnonzero(full.take(slots))
    ordered = np.sort(pairs[places])
    begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    counts = np.diff(np.r_[begins, len(ordered)])
    often = np.flatnonzero(counts >= max(LEAST_COUNT, counts.max(initial=0) // STEP))
    if not len(often):
        return symbols, none
    # The table gives a pair's number, -1 for none; of pairs that share a slot the most frequent is taken now.
    often = often[np.argsort(counts[often], kind="stable")]
    chosen = ordered[begins[often]]
    narrow = first <= 1 << 16
    bits = 16 if narrow else 32
    left, right = (chosen >> chosen.dtype.type(bits)).astype(np.uint32), (chosen & chosen.dtype.type((1 << bits) - 1)).astype(np.uint32)
    at = _pairs(np.stack((left, right), 1).reshape(-1), narrow)[1][::2]
    number = np.full(1 + (1 << _TABLE_BITS), -1, np.int32)
    number[at] = np.arange(len(chosen))
    # What is chosen lies in a full slot, so no other place is looked at.
    rule = number.take(slots[places])
    taken = rule >= 0
    hits, rule = places[taken], rule[taken]
    same = chosen[rule] == pairs[hits]
    hits, rule = hits[same], rule[same]
    # Neighbouring hits overlap: of each run of them every second one counts, from the left.
    run = np.flatnonzero(np.r_[True, np.diff(hits) != 1])
    even = (np.arange(len(hits)) - np.repeat(run, np.diff(np.r_[run, len(hits)]))) & 1 == 0
    hits, rule = hits[even], rule[even]
    uses = np.bincount(rule, minlength=len(chosen))
    good = uses >= LEAST_USES
    if not good.any():
        return symbols, none
    taken = good[rule]
    hits, rule = hits[taken], (np.cumsum(good) - 1)[rule[taken]]
    out = symbols.copy()
    out[hits] = first + rule
    keep = np.ones(len(out), bool)
    keep[hits + 1] = False
    return out[keep], np.stack((left[good], right[good]), 1)


def compress(ids: np.ndarray, starts: np.ndarray, end_id: int = END_ID) -> bytes:
    """A block of the given ids; ``starts`` are the documents' places in them, and each document ends with end_id."""
    symbols, firsts, rules = ids.astype(np.uint32), [], [np.empty((0, 2), np.uint32)]
    known = np.ones(FIRST_NONTERMINAL, np.uint32)
    while True:
        symbols, found = _round(symbols, len(known), end_id)
        if not len(found):
            break
        firsts.append(len(known))
        rules.append(found)
        known = np.r_[known, known[found[:, 0]] + known[found[:, 1]]]
    kind = "<u2" if len(known) <= 1 << 16 else "<u4"
    # No rule crosses the end of a document, so each one begins at a symbol.
    places = np.searchsorted(np.r_[0, np.cumsum(known[symbols], dtype=np.int64)], np.r_[starts, len(ids)])
    head = MAGIC + struct.pack(HEAD, len(starts), len(symbols), len(known) - FIRST_NONTERMINAL, len(firsts), int(kind[2]))
    lengths, bounds = known[FIRST_NONTERMINAL:].astype("<u4"), np.r_[starts, len(ids)].astype("<u8")
    parts = (np.array(firsts, "<u4"), np.concatenate(rules).astype(kind), lengths, places.astype("<u8"), bounds, symbols.astype(kind))
    return head + b"".join(x.tobytes() for x in parts)


class Block:
    """A block as it was stored; ``document(k)`` decodes one document from its own symbols."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a block")
        docs, symbols, rules, rounds, width = struct.unpack_from(HEAD, data, 4)
        kind = f"<u{width}"
        at = 4 + struct.calcsize(HEAD)
        read = []
        for each, n in (("<u4", rounds), (kind, 2 * rules), ("<u4", rules), ("<u8", docs + 1), ("<u8", docs + 1), (kind, symbols)):
            read.append(np.frombuffer(data, each, n, at))
            at += read[-1].nbytes
        self._firsts, flat, self.lengths, places, starts, self._symbols = read
        self._places, self.starts = places.astype(np.int64), starts.astype(np.int64)
        self._rules = flat.reshape(-1, 2).astype(np.int64)
        # Expansions of all symbols end to end: terminals, then the rules of each round from those before.
        self._sizes = np.r_[np.ones(FIRST_NONTERMINAL, np.int64), self.lengths.astype(np.int64)]
        self._at = np.r_[0, np.cumsum(self._sizes)[:-1]]
        self._flat = np.arange(FIRST_NONTERMINAL, dtype=np.uint32)
        bounds = [*self._firsts.tolist(), len(self._sizes)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            both = self._rules[a - FIRST_NONTERMINAL : b - FIRST_NONTERMINAL].reshape(-1)
            self._flat = np.r_[self._flat, self._expand(both)]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self._sizes[symbols]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self._flat[np.repeat(self._at[symbols] - ends + sizes, sizes) + np.arange(total)]

    def __len__(self) -> int:
        return len(self.starts) - 1

    def document(self, k: int) -> np.ndarray:
        return self._expand(self._symbols[self._places[k] : self._places[k + 1]])

    def ids(self) -> np.ndarray:
        return self._expand(self._symbols)


def write_ids(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes blocks of ids in ascending doc_id order; the frame that reads the files."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    end = np.array([end_id], dtype="<u2").tobytes()
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, False, "<u2"), TaskContext.get().partitionId()
        ids, packed, held, number, first = [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(x) // 2 for x in packed], dtype=np.int64)
            data = compress(np.frombuffer(b"".join(packed), "<u2"), np.r_[0, np.cumsum(sizes)[:-1]], end_id)
            row = (part, number, first, int(sizes.sum()), ids, data)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for a, b in pieces(batch.column(1), AT_ONCE):
                texts = encode.many(batch.column(1).slice(a, b - a))
                for doc_id, x in zip(batch.column(0).slice(a, b - a).to_pylist(), texts, strict=True):
                    ids.append(doc_id)
                    packed.append(x + end)
                    held += len(x) // 2 + 1
                    if held >= BLOCK_IDS:
                        yield block()
                        first += held
                        ids, packed, held, number = [], [], 0, number + 1
        if ids:
            yield block()
        release_memory()

    # Many rows of one doc_id are parted by the hash of the text; only ids and hashes are sampled for the ranges.
    order = ("doc_id", F.xxhash64("text"))
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return materialize(ordered.mapInArrow(run, BLOCKS), "ids")


def read_ids(blocks: DataFrame) -> DataFrame:
    """Per document, decoded one by one from the files: doc_id, start, n_tokens, ids_crc32."""
    names = [x.split()[0] for x in READ.split(", ")]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, doc_ids, data = (batch.column(k)[i].as_py() for k in (0, 1, 2, 3))
                stored = Block(data)
                decoded = [stored.document(k).astype("<u4") for k in range(len(stored))]
                sizes, crc = [len(x) for x in decoded], [zlib.crc32(x.tobytes()) for x in decoded]
                columns = ([part] * len(doc_ids), doc_ids, first + np.r_[0, np.cumsum(sizes)[:-1]], sizes, crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    rows = blocks.select("part", "first_id", "doc_ids", "data").mapInArrow(run, READ)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("base"))  # a row for each partition
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
