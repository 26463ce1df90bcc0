"""Fingerprints of substrings, and documents told apart by hashed marks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.session import materialize

_RNG = np.random.default_rng(20_240_229)
_TABLES = _RNG.integers(0, 1 << 64, (2, 256), np.uint64)
_BASES = tuple(int(x) | 1 for x in _RNG.integers(1 << 62, 1 << 63, 2, np.uint64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Powers that a worker keeps; log2 of the most rows of a broadcast table of marks.
KEPT_POWERS, MARK_BITS = 1 << 19, 20


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of a base modulo 2**64 and of its inverse. Longer ones than KEPT_POWERS aren't kept."""
    if which in _powers and len(_powers[which][0]) >= n:
        return _powers[which]
    both = []
    for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        steps = np.full(max(n, KEPT_POWERS), b, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    if n <= KEPT_POWERS:
        _powers[which] = (both[0], both[1])
    return both[0], both[1]


class Prints:
    """64-bit fingerprints of the substrings of some bytes: polynomials over random values of the bytes.
    ``which`` picks one of two independent families."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        up, self._down = _power(which, len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * up[: len(data)], out=self._sums[1:])

    def all(self, length: int) -> np.ndarray:
        """Of each substring of that length."""
        n = len(self._sums) - length
        return (self._sums[length:] - self._sums[:n]) * self._down[:n]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._down[start]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(uid, doc, text): ``uid`` is a digest of doc_id and text, so rows that repeat share it; null text is empty."""
    return docs.select(uid().alias("uid"), F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


def uid(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits of doc_id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))))


def marked(keyed: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``keyed`` cut in two: rows whose uid is perhaps among those of ``rows``, and those where it
    surely is not. A table of at most 2**MARK_BITS hashed marks is broadcast, so only rows of the first
    part need to be shuffled; a clash of marks costs a needless shuffle of one row. With more ``rows`` than
    some 2**MARK_BITS most marks are set, and most texts are shuffled once: the table is a saving, no need."""
    mark = F.xxhash64("uid").bitwiseAND(F.lit((1 << MARK_BITS) - 1)).alias("mark")
    marks = F.broadcast(materialize(rows.select(mark).distinct(), "marks"))
    tagged = keyed.withColumn("mark", mark)
    return tagged.join(marks, "mark", "left_semi").drop("mark"), tagged.join(marks, "mark", "left_anti").drop("mark")
