"""SentencePiece BPE, encoded by rounds over flat arrays.

Texts lie one after the other as bytes, a space before each that isn't empty. They are cut into units where no piece of
the vocabulary can reach across: before a space that follows something else, and on both sides of a line feed where no
piece holds one. Arrow tells the different units of a chunk; only these are encoded, together: their characters are one
array of symbols. In a round, each unit's least rank of a pair of neighbours is found (a segmented minimum), all its
leftmost pairs of that rank that don't overlap become one symbol, what is left is moved together, and ranks are told
anew beside the new symbols only; units without a pair go. Where the merged piece could make a pair of a better rank
with a neighbour, only the leftmost one merges in that round, so that the order is the library's: best score first,
leftmost first. Characters that no piece has become the pieces of their bytes.

Any two neighbours whose text is a piece are a pair, however that piece is cut. Decoding is the library's.

Defined cases: null and empty texts have no ids and decode to ''; a space and U+2581 are the same symbol; repeated rows are
encoded each; a text is one piece of work, however long, and a word of n characters takes at most n rounds, each over what
is left of it; further columns are ignored by ``encode``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from priorline.llm.common import pieces, release_memory

MODEL = "piece_bpe_32k.model"
#: Bytes of text at once.
AT_ONCE = 3_000_000
#: The library's mark for a space.
MARK = "▁"
#: What the library must leave as it is for texts to be encoded here: compatibility forms, marks, several spaces, controls.
PROBE = "ﬁ  é Å　x\t\r\n ▁a\x00 "
_BEYOND = 0x110000
#: The rank of no pair.
_NONE = np.iinfo(np.int32).max


class PieceEncoder:
    """The pairs of a model and the rounds over them."""

    def __init__(self, name: str = MODEL) -> None:
        self.library = sp = SentencePieceProcessor(model_file=public_tokenizers.path(name))
        size = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(size)) or sp.decode(sp.encode(PROBE)) != PROBE.replace(MARK, " "):
            raise ValueError(f"{name} changes texts before it encodes them, or has unused pieces")
        plain = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(a != MARK and b == MARK for p in plain for a, b in zip(p, p[1:])):
            raise ValueError(f"{name} has pieces across words")
        self.cut_lines = not any("\n" in p for p in plain)
        # Symbols: pieces by their id, then characters that are only parts of pieces.
        symbols = dict(plain)
        for p in sorted(plain, key=plain.get):
            for c in p:
                symbols.setdefault(c, size + len(symbols) - len(plain))
        self._base = size + len(symbols) - len(plain)  # from here on code points without a piece
        self._symbol_of = np.arange(self._base, self._base + _BEYOND)
        for p, i in symbols.items():
            if len(p) == 1:
                self._symbol_of[ord(p)] = i
        self._symbol_of[ord(" ")] = self._symbol_of[ord(MARK)]
        self._code_of = np.zeros(self._base, np.int64)
        self._code_of[[i for p, i in symbols.items() if i >= size]] = [ord(p) for p, i in symbols.items() if i >= size]
        self._pieces = size
        self._byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        # Pairs, by key, and the rank of the piece that each makes: best score first.
        pairs = [(symbols[p[:k]] * self._base + symbols[p[k:]], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        keys, made = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
        scores = np.array([sp.get_score(i) for i in range(size)])
        _, rank = np.unique(-scores, return_inverse=True)
        self._keys, self._made = np.r_[keys, np.iinfo(np.int64).max], np.r_[made, -1].astype(np.int32)
        self._rank = np.r_[rank, _NONE].astype(np.int32)  # of -1, which is no piece, the last
        # Ranks whose pieces are a side of a pair of as good a rank: these merge one by one.
        self._careful = np.zeros(rank.max() + 2, bool)
        for side in (keys // self._base, keys % self._base):
            merged = side < size
            better = rank[made[merged]] <= rank[side[merged]]
            self._careful[rank[side[merged][better]]] = True

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 for none."""
        key = left.astype(np.int64) * self._base + right
        key[(left >= self._base) | (right >= self._base)] = -1
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._made[at], np.int32(-1))

    def rounds(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, unit) once no pair is left, by unit; ``unit`` ascends."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        made = np.full(len(symbols), -1, np.int32)
        made[:-1] = np.where(unit[1:] == unit[:-1], self._pairs(symbols[:-1], symbols[1:]), -1)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            sizes = np.diff(np.r_[first, len(unit)])
            rank = self._rank[made]
            best = np.minimum.reduceat(rank, first)
            open_ = np.repeat(best < _NONE, sizes)
            if not open_.all():
                done.append((symbols[~open_], unit[~open_]))
                symbols, unit, made, rank = symbols[open_], unit[open_], made[open_], rank[open_]
                best, sizes = best[best < _NONE], sizes[best < _NONE]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # Of hits that touch one another every second one overlaps.
            fresh = np.r_[True, hit[1:] != hit[:-1] + 1]
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - start) % 2 == 0
            lead = np.r_[True, unit[hit[1:]] != unit[hit[:-1]]]
            hit = hit[take & (lead | ~self._careful[rank[hit]])]
            symbols[hit] = made[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            place = np.cumsum(stay)[hit] - 1
            symbols, unit, made = symbols[stay], unit[stay], made[stay]
            for left in (place, place[place > 0] - 1):
                right = np.minimum(left + 1, len(symbols) - 1)
                inside = (left < right) & (unit[left] == unit[right])
                made[left] = np.where(inside, self._pairs(symbols[left], symbols[right]), -1)
        if not done:
            return symbols, unit
        symbols, unit = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(unit, kind="stable")
        return symbols[order], unit[order]

    def _ids(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in place of symbols, several for a character that only its bytes can stand for."""
        odd = symbols >= self._pieces
        if not odd.any():
            return symbols.astype(np.int32), unit
        codes = symbols[odd]
        points = np.where(codes >= self._base, codes - self._base, self._code_of[np.minimum(codes, self._base - 1)])
        spelled = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        size = np.ones(len(symbols), np.int64)
        size[odd] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        ids = np.repeat(symbols, size)
        ids[np.repeat(odd, size)] = self._byte_ids[np.frombuffer(spelled, np.uint8)]
        return ids.astype(np.int32), np.repeat(unit, size)

    def units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different units, one after the other, and where each unit's begin (and the last one's end)."""
        data = b"".join(units.to_pylist())
        points = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
        begins = np.frombuffer(data, np.uint8) & 0xC0 != 0x80
        ends = np.cumsum(np.r_[0, pc.binary_length(units).to_numpy(zero_copy_only=False)])
        counts = np.diff(np.r_[0, np.cumsum(begins)][ends])
        symbols, unit = self._ids(*self.rounds(self._symbol_of[points], np.repeat(np.arange(len(units)), counts)))
        return symbols, np.searchsorted(unit, np.arange(len(units) + 1))

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (and the last one's end)."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        texts = pc.replace_substring(texts, MARK, " ")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
        bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        if bounds[-1] == bounds[0]:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        space = data == 0x20
        cut = space & np.r_[True, ~space[:-1]]
        if self.cut_lines:
            line = data == 0x0A
            cut |= line
            cut[1:] |= line[:-1]
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.r_[starts, len(data)].astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        ids, at = self.units(words.dictionary)
        which = words.indices.to_numpy()
        sizes = np.diff(at)[which]
        ends = np.r_[0, np.cumsum(sizes)]
        flat = ids[np.arange(ends[-1]) + np.repeat(at[which] - ends[:-1], sizes)]
        return flat, ends[np.searchsorted(starts, bounds)]


@lru_cache(maxsize=2)
def encoder(name: str = MODEL) -> PieceEncoder:
    return PieceEncoder(name)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document doc_id, ids (array<int>) and decoded, what the library's decode makes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1), AT_ONCE):
                ids, bounds = encoder(model).many(batch.column(1).slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                texts = [encoder(model).library.decode(ids[s:e].tolist()) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256."""
    return encode(docs, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
