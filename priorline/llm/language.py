"""Language identification with hyperdimensional profiles.

Each letter, of any script, has a random vector of +1 and -1, drawn by a hash of its code point whenever it is
needed. A trigram's vector binds its letters by position: the first letter's vector rotated by two places,
times the second's rotated by one, times the third's. A document bundles (adds up) the vectors of its trigrams,
a language those of its documents; the language whose prototype has the largest cosine with the document's
vector wins. Sums are of whole numbers, so a document's vector doesn't depend on what is worked on with it.

Only labelled training rows make prototypes; source, doc_id and lang of a document are no inputs of its
prediction. What the driver sees is one vector for each language.

Defined cases: null text, or text without a letter, gives UNKNOWN and score 0; rows with null lang aren't
learned from; with no training rows all is UNKNOWN; ties go to the first language in order; long texts
count whole; repeated rows count as often as they come; ``identify`` ignores further columns, ``keep_known``
keeps them as they are. Letters are what Unicode calls so; other characters, marks that combine with letters
among them, are gaps.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import release_memory, set_aside

DIMENSIONS, SEED = 1024, 7
UNKNOWN = "und"
#: A trigram is three code points of so many bits, 0 for a gap.
BITS = 21
#: Trigrams that are bundled at once, pairs of language and trigram that are counted before they are bundled,
#: trigrams whose vectors a task remembers.
PART, MOST_COUNTED, MOST_KNOWN = 4096, 1 << 20, 1 << 15
#: Characters and documents that are worked on at once.
AT_ONCE, DOCS_AT_ONCE = 500_000, 1024
#: Documents with this remainder of crc32(doc_id as text) by FOLDS are held out.
FOLDS, HELD_OUT = 5, 0

_state: dict = {}


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def _letter_codes() -> np.ndarray:
    """Each code point that is a letter, 0 in place of the others."""
    if "codes" not in _state:
        _state["codes"] = np.array([c if chr(c).isalpha() else 0 for c in range(sys.maxunicode + 1)], np.uint32)
    return _state["codes"]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The vector of each code point: the bits of DIMENSIONS / 64 hashes of it."""
    n = DIMENSIONS // 64
    z = (points.astype(np.uint64)[:, None] * np.uint64(n) + np.arange(1, n + 1, dtype=np.uint64) + np.uint64(SEED << 32)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    bits = np.unpackbits((z ^ (z >> np.uint64(31))).astype("<u8").view(np.uint8), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def trigram_vectors(trigrams: np.ndarray) -> np.ndarray:
    mask = (1 << BITS) - 1
    points, at = np.unique(np.stack([trigrams >> 2 * BITS, trigrams >> BITS & mask, trigrams & mask]), return_inverse=True)
    v, (a, b, c) = letter_vectors(points), at.reshape(3, -1)
    return np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]


def _counted(owner: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different trigrams, and (owner, number of the trigram among them, count) of each pair, by owner."""
    different, number = np.unique(grams, return_inverse=True)
    keys = np.sort(owner.astype(np.int64) * len(different) + number)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return different, keys[first] // len(different), keys[first] % len(different), np.diff(np.r_[first, len(keys)])


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if i > at and (size + n > AT_ONCE or i - at == DOCS_AT_ONCE):
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, trigram) of each trigram whose middle is a letter, and whether a document has a letter."""
    low = [x.lower() if x else "" for x in texts]
    points = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _letter_codes()[points].astype(np.int64)
    owner = np.repeat(np.arange(len(low)), np.array([len(x) + 1 for x in low]))
    owner = np.r_[0, owner]
    keep = np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]
    codes, owner = codes[keep], owner[keep]
    middle = np.flatnonzero(codes[1:-1]) + 1 if len(codes) > 2 else np.empty(0, np.int64)
    grams = codes[middle - 1] << 2 * BITS | codes[middle] << BITS | codes[middle + 1]
    has = np.zeros(len(low), bool)
    has[owner[middle]] = True
    return owner[middle], grams, has


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from (text, lang): each task bundles its documents of a language, Spark adds the bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        counted: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def bundle() -> None:
            for name, parts in counted.items():
                grams, number = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(number, np.concatenate([c for _, c in parts]))
                total = totals.setdefault(name, np.zeros(DIMENSIONS))
                for at in range(0, len(grams), PART):
                    total += n[at : at + PART] @ trigram_vectors(grams[at : at + PART]).astype(np.float64)
            counted.clear()

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                owner, grams, _ = _trigrams(texts[a:b])
                if not len(grams):
                    continue
                names, number = np.unique(np.array(langs[a:b], dtype=object).astype(str), return_inverse=True)
                different, of, gram, count = _counted(number[owner], grams)
                for k in np.unique(of).tolist():
                    counted.setdefault(str(names[k]), []).append((different[gram[of == k]], count[of == k]))
                size += len(gram)
                if size > MOST_COUNTED:
                    bundle()
                    size = 0
        bundle()
        for name, total in totals.items():
            columns = [pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "dim", "part"])
        release_memory()

    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = rows.mapInArrow(run, "lang string, dim int, part long").groupBy("lang", "dim").agg(F.sum("part").alias("value"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():  # DIMENSIONS numbers for each language
        found.setdefault(r.lang, np.zeros(DIMENSIONS))[r.dim] = r.value
    return dict(sorted((k, v) for k, v in found.items() if v.any()))


class Classifier:
    """Prototypes with the vectors of the trigrams seen of late."""

    def __init__(self, prototypes: dict[str, np.ndarray]) -> None:
        self.names = list(prototypes)
        self._unit = np.stack([v / np.linalg.norm(v) for v in prototypes.values()], 1) if prototypes else np.zeros((DIMENSIONS, 0))
        self._known = np.empty(0, np.int64)
        self._vectors = np.zeros((0, DIMENSIONS), np.int8)

    def _vectors_of(self, different: np.ndarray) -> np.ndarray:
        """The vectors of at most PART trigrams, which are in order."""
        at = np.searchsorted(self._known, different)
        known = np.zeros(len(different), bool)
        inside = at < len(self._known)
        known[inside] = self._known[at[inside]] == different[inside]
        found = np.empty((len(different), DIMENSIONS), np.int8)
        found[known] = self._vectors[at[known]]
        if not known.all():
            new = different[~known]
            found[~known] = trigram_vectors(new)
            if len(self._known) + len(new) > MOST_KNOWN:
                self._known, self._vectors = different, found
            else:
                self._known, self._vectors = np.insert(self._known, at[~known], new), np.insert(self._vectors, at[~known], found[~known], axis=0)
        return found

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The vector of each text, and which texts have a letter."""
        owner, grams, has = _trigrams(texts)
        if not len(grams):
            return np.zeros((len(texts), DIMENSIONS)), has
        different, owner, gram, count = _counted(owner, grams)
        # Sums below 2**24 are exact in single precision.
        kind = np.float32 if np.bincount(owner, count).max() < 1 << 24 else np.float64
        vectors = np.zeros((len(texts), DIMENSIONS), kind)
        order = np.argsort(gram, kind="stable")
        owner, gram, count = owner[order], gram[order], count[order]
        for at in range(0, len(different), PART):
            part = different[at : at + PART]
            a, b = np.searchsorted(gram, (at, at + len(part)))
            matrix = np.zeros((len(texts), len(part)), kind)
            matrix[owner[a:b], gram[a:b] - at] = count[a:b]
            vectors += matrix @ self._vectors_of(part).astype(kind)
        return vectors.astype(np.float64), has

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.names:
            return names, scores
        vectors, has = self.bundles(texts)
        norms = np.linalg.norm(vectors, axis=1)
        cosines = vectors @ self._unit / np.where(norms > 0, norms, 1.0)[:, None]
        best = np.argmax(cosines, 1)
        for d in np.flatnonzero(has).tolist():
            names[d], scores[d] = self.names[best[d]], float(min(1.0, max(0.0, cosines[d, best[d]])))
        return names, scores


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, which it must not have yet, from its column ``text``."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(prototypes)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            names, scores = [], []
            for a, b in _chunks(texts):
                n, s = classifier.predict(texts[a:b])
                names += n
                scores += s
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])
        release_memory()

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; prototypes from the documents not held out."""
    prototypes = learn(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), prototypes)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is told, with the columns of ``docs``; a missing lang becomes the prediction. Where no
    document has both a lang and a letter nothing can be told, and all stay as they are."""
    prototypes = learn(docs)
    if not prototypes:
        return docs
    aside, place, back = set_aside(docs)
    out = predict(aside, prototypes, place["text"]).where(F.col("lang_pred") != UNKNOWN)
    return back(out.withColumn(place["lang"], F.coalesce(place["lang"], "lang_pred")))
