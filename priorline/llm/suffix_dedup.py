"""Exact removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

Which suffixes: every LENGTH-byte string has one anchor, the start of its GRAM-byte substring with the
least hash (the leftmost of equals). The anchor depends on the string alone, so repeated strings have
anchors with equal grams, and only suffixes that start at anchors need to be in the arrays, about
2 of LENGTH - GRAM. An entry is a suffix's head (its first GRAM bytes) and its position (document, place);
arrays are in the order of the heads' bytes, then of the positions.

The family: documents come in batches. A batch's array is compared with each level: with a level of its own
size it is merged into an array of twice that size, which meets the next level; with larger ones it is
merge-joined. In a merged array, neighbours with equal heads are found by one scan. So there are at most
log2(batches) + 1 levels, and an entry is rewritten as often at most. Levels are Parquet folders that a
manifest names, and a family that is opened again goes on from them.

From matches to bytes: an anchor with a matched head stands for its strings, consecutive starts. Strings
are judged in sets, first all of an anchor, then sixteen neighbours, then one by one. What a set's
strings have in common is its core, what they cover together its span. With a span that repeats all
strings repeat; with a core that doesn't, none. Where cores meet but spans differ, sets are cut into
smaller ones, of each repeated span that shares the core one as a witness. Spans and strings are held to be
equal where their BLAKE2 digests of 128 bits are; cores that clash only cost work. A removed run is a union
of repeated strings.

Only documents that take part in matches have their texts shuffled (see ``marked``).

Defined cases: null text is an empty one; texts under LENGTH bytes lose nothing; matches never cross
documents; rows that repeat (same doc_id and text) are copies of one another; a null doc_id is one like
any other; very long texts are read in chunks that overlap by LENGTH - 1 bytes; an empty table gives no
rows; further columns are ignored by ``cut`` and ``dedup`` and kept by ``apply_dedup``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.llm.common import pieces, release_memory, set_aside
from priorline.llm.prints import Prints, keyed_texts, marked, mix, uid
from priorline.session import materialize, remove, steps, work_dir

LENGTH, GRAM = 400, 64
#: The pipeline cuts repeats from so many bytes on: over 50 words of any of the languages have more.
PASSAGE = 256
#: Neighbouring strings in a set of the second kind.
SET = 16
BATCHES = 4
#: Bytes that are hashed at once, and bits for a place among them.
CHUNK, POSITION_BITS = 500_000, 22

ANCHORS = "head binary, span binary, uid binary, at int, n int, place int"
BLOCKS = "core long, span binary, uid binary, at int, n int, place int, asked boolean"
STRINGS = "string binary, uid binary, at int, asked boolean"
SPANS = "array<struct<start:int,end:int>>"
CUT = f"doc_id long, n_bytes long, spans {SPANS}, kept binary"
#: What a query tells of ``cut``'s rows: counts and a digest; the bytes kept as text, in which U+FFFD stands for what a cut left of a character.
DIGESTS = ("doc_id", "n_bytes", "n_bytes - octet_length(kept) as n_removed", "cast(size(spans) as long) as n_spans", "sha2(kept, 256) as kept_sha256")
TEXT = "make_valid_utf8(cast(kept as string)) as text"
#: Bytes of texts that go back from a worker at once.
OUT_BYTES = 8_000_000
LEVEL, MANIFEST = ("head", "uid", "place"), "version long, size long, path string"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _digests(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, salts: list[bytes] | None = None) -> pa.Array:
    """BLAKE2 digests of data[begin:end], each with its salt."""
    view, new = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    bounds = zip(begins.tolist(), ends.tolist(), strict=True)
    if salts is None:
        return pa.array([new(view[a:b], digest_size=16).digest() for a, b in bounds], pa.binary())
    return pa.array([new(view[a:b], digest_size=16, salt=s).digest() for (a, b), s in zip(bounds, salts, strict=True)], pa.binary())


def _salts(*columns: np.ndarray) -> list[bytes]:
    """16 bytes for each row of at most four columns of small numbers."""
    packed = np.zeros((len(columns[0]), 4), "<u4")
    for k, c in enumerate(columns):
        packed[:, k] = c
    flat = packed.tobytes()
    return [flat[k : k + 16] for k in range(0, len(flat), 16)]


def _substrings(data: np.ndarray, begins: np.ndarray, length: int) -> pa.Array:
    """data[begin:begin + length] of each begin as a binary column."""
    flat = data[begins[:, None] + np.arange(length)]
    offsets = np.arange(len(begins) + 1, dtype=np.int32) * np.int32(length)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For the anchors of the documents data[starts[k]:ends[k]]: k, first string's start in the document,
    number of strings, anchor's place in the document, anchor's place in data, first string's start in data."""
    sizes = np.maximum(ends - starts - (length - 1), 0)
    if not sizes.sum():
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty, empty
    grams = mix(Prints(data, 0).all(GRAM))
    mask = np.uint64((1 << POSITION_BITS) - 1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    string = np.arange(sizes.sum()) + first
    place = (least[string] & mask).astype(np.int64)
    run = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    lo, hi, place, owner = string[run], string[np.r_[run[1:] - 1, len(string) - 1]], place[run], owner[run]
    return owner, lo - starts[owner], hi - lo + 1, place - starts[owner], place, lo


def _chunks(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of some rows with the rows' numbers, starts, ends, and places in their texts; a text over
    CHUNK bytes comes in parts that overlap by length - 1."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] and texts.buffers()[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1
        if stop > row:
            bounds = offsets[row : stop + 1]
            yield data[bounds[0] : bounds[-1]], np.arange(row, stop), bounds[:-1] - bounds[0], bounds[1:] - bounds[0], np.zeros(stop - row, np.int64)
            row = stop
            continue
        for at in range(int(offsets[row]), int(offsets[row + 1]) - length + 1, CHUNK):
            part = data[at : min(at + CHUNK + length - 1, int(offsets[row + 1]))]
            yield part, np.array([row]), np.array([0]), np.array([len(part)]), np.array([at - int(offsets[row])])
        row += 1


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, rows, starts, ends, places in _chunks(batch.column(2), length):
                owner, at, n, place, inside, lo = anchors(data, starts, ends, length)
                row, before = rows[owner], places[owner]
                small = [pa.array(x.astype(np.int32)) for x in (at + before, n, place + before)]
                span = _digests(data, lo, lo + n + (length - 1), _salts(inside - lo, n))
                yield pa.RecordBatch.from_arrays([_substrings(data, inside, GRAM), span, batch.column(0).take(pa.array(row)), *small], names=_names(ANCHORS))
        release_memory()

    return keyed.mapInArrow(run, ANCHORS)


def neighbours(array: DataFrame) -> DataFrame:
    """Heads that stand more than once in a written array: one scan in order, piece of a file by piece. What is
    equal across two pieces shows in the first and last heads of all pieces, a few rows for each of them."""
    piece = F.concat_ws(":", F.input_file_name(), F.input_file_block_start())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_head, last_piece = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            heads, pieces = batch.column(0), batch.column(1)
            again = np.zeros(batch.num_rows, bool)
            fresh = np.zeros(batch.num_rows, bool)
            again[1:] = pc.equal(heads[1:], heads[:-1]).to_numpy(zero_copy_only=False)
            fresh[1:] = pc.not_equal(pieces[1:], pieces[:-1]).to_numpy(zero_copy_only=False)
            again[0], fresh[0] = heads[0].as_py() == last_head, pieces[0].as_py() != last_piece
            edge = fresh.copy()
            edge[:-1] |= fresh[1:]
            edge[-1] = True  # perhaps the piece's last
            again &= ~fresh
            shown = np.flatnonzero(again | edge)
            yield pa.RecordBatch.from_arrays([heads.take(pa.array(shown)), pa.array(again[shown]), pieces.take(pa.array(shown))], names=["head", "again", "piece"])
            last_head, last_piece = heads[-1].as_py(), pieces[-1].as_py()
        release_memory()

    seen = array.select("head", piece.alias("piece")).mapInArrow(run, "head binary, again boolean, piece string")
    both = seen.groupBy("head").agg(F.max("again").alias("again"), F.count_distinct("piece").alias("pieces"))
    return both.where("again or pieces > 1").select("head")


class SuffixFamily:
    """Levels of suffix arrays in ``folder``: tables (head, uid, place) in order, the sizes in batches, a manifest."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        """A new family, or with the ``folder`` of one the family as it was left."""
        self._spark, self._version = spark, 0
        self._stored: list[tuple[int, str]] = []  # (batches, path), the largest first
        self.folder = folder or f"{work_dir(spark)}/family-{uuid.uuid4().hex}"
        if folder:
            rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
            self._version = rows.agg(F.max("version")).head()[0]
            now = rows.where(F.col("version") == self._version).collect()  # a row for each level
            self._stored = sorted(((r["size"], r["path"]) for r in now), reverse=True)

    @property
    def levels(self) -> list[tuple[int, DataFrame]]:
        return [(size, self._spark.read.parquet(path)) for size, path in self._stored]

    def add(self, suffixes: DataFrame) -> DataFrame:
        """A batch's suffixes (head, uid, place). Gives the heads that are in the batch and anywhere else, in the
        batch itself or in those before (with them, where levels merged, heads that met before)."""
        size, array, merged = 1, suffixes.select(*LEVEL), []
        while self._stored and self._stored[-1][0] == size:
            merged.append(self._stored.pop()[1])
            array = self._spark.read.parquet(merged[-1]).unionByName(array)
            size *= 2
        path = f"{self.folder}/level-{size}-{uuid.uuid4().hex}"
        array.repartitionByRange(*LEVEL).sortWithinPartitions(*LEVEL).write.option("compression", "zstd").parquet(path)
        array = self._spark.read.parquet(path)
        found = neighbours(array)
        mine = array.select("head").distinct()
        for _, level in self.levels:
            found = found.unionByName(mine.join(level.select("head").distinct(), "head"))
        found = materialize(found, "met")
        self._stored.append((size, path))
        self._version += 1
        rows = self._spark.createDataFrame([(self._version, *x) for x in self._stored], MANIFEST)
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        for old in merged:  # the manifest no longer names them
            if old.startswith(work_dir(self._spark) + "/"):
                remove(self._spark, old)
        return found


def _resolve(sets: DataFrame, name: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Sets of strings (core, span, uid, at, n, place, asked) to (uid, start, end) of those of which all
    strings repeat, and to the sets that have to be cut (uid, at, n, place, asked): with cores that meet
    and spans that differ. Each span goes on once; one that repeats is asked no more and bears witness."""
    first = F.min(F.struct("uid", "at", "n", "place")).alias("one")
    spans = materialize(sets.groupBy("core", "span").agg(F.count("*").alias("copies"), first, F.max("asked").alias("asked")), name)
    # What is joined is written first, so that both sides come straight from exchanges and Spark may split hot cores.
    copied = materialize(spans.where("copies > 1 and asked").select("core", "span"), f"{name}-copied")
    repeated = sets.where("asked").join(copied, ["core", "span"])
    whole = repeated.select("uid", F.col("at").alias("start"), (F.col("at") + F.col("n") + (length - 1)).alias("end"))
    open_ = (F.col("copies") == 1) & F.col("asked")
    mixed = spans.groupBy("core").agg(F.count("*").alias("spans"), F.max(open_).alias("any")).where("spans > 1 and any").select("core")
    return whole, spans.join(materialize(mixed, f"{name}-mixed"), "core").select("one.*", open_.alias("asked"))


def _of_texts(texts: DataFrame, sets: DataFrame, schema: str, work: Callable[[np.ndarray, dict], list[pa.Array]]) -> DataFrame:
    """Runs ``work`` (a text's bytes, a set) for each of ``sets``; the columns it gives stand around uid."""
    names = _names(schema)
    per_doc = sets.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("at", "n", "place", "asked"))).alias("sets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, own = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8), batch.column(2)[i].as_py()
                for a in range(0, len(own), 64):
                    done = [work(data, x) for x in own[a : a + 64]]
                    columns = [pa.concat_arrays(c) for c in zip(*done, strict=True)]
                    columns.insert(names.index("uid"), pa.array([batch.column(0)[i].as_py()] * len(columns[0]), pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        release_memory()

    # Rows that repeat share a uid and so their sets.
    return texts.select("uid", "text").join(per_doc, "uid").select("uid", "text", "sets").mapInArrow(run, schema)


def _cut_set(data: np.ndarray, x: dict, length: int) -> list[pa.Array]:
    """An anchor's strings in sets of SET neighbours, by their distance from the anchor."""
    at, last, place = x["at"], x["at"] + x["n"] - 1, x["place"]
    lo, part = max(0, at - SET), data[max(0, at - SET) : last + length + SET]
    k = np.arange((place - last) // SET, (place - at) // SET + 1)
    final = place - SET * k  # the last start of a whole set, the start of its core
    begin, end = np.maximum(final - SET + 1, at), np.minimum(final, last)
    core = mix(Prints(part, 0).of(final - lo, final - lo + length - SET + 1) + mix(k.astype(np.uint64)))
    span = _digests(part, begin - lo, end - lo + length, _salts(final - begin, end - begin, k & 0xFFFFFFFF))
    small = [pa.array(c.astype(np.int32)) for c in (begin, end - begin + 1, begin)]
    return [pa.array(core.view(np.int64)), span, *small, pa.array(np.full(len(k), x["asked"]))]


def _one_by_one(data: np.ndarray, x: dict, length: int) -> list[pa.Array]:
    at, n = x["at"], x["n"]
    begins = np.arange(at, at + n)
    return [_digests(data, begins, begins + length), pa.array(begins.astype(np.int32)), pa.array(np.full(n, x["asked"]))]


def _matched(keyed: DataFrame, batches: int, length: int) -> DataFrame:
    """The sets of strings of anchors whose heads stand anywhere else; arrays and anchors go once these are written."""
    spark = keyed.sparkSession
    with steps(spark):
        numbered = _anchor_rows(keyed, length).withColumn("batch", F.pmod(F.xxhash64("uid"), F.lit(batches)).cast("int"))
        entries = materialize(numbered, "anchors", ("batch",))
        with steps(spark) as arrays:
            family = SuffixFamily(spark)
            arrays.append(family.folder)
            found = [family.add(entries.where(F.col("batch") == b)) for b in range(batches)]
            heads = found[0]
            for more in found[1:]:
                heads = heads.unionByName(more)
            heads = materialize(heads.distinct(), "matches", outlives=True)
        sets = entries.join(heads, "head").select(F.xxhash64("head").alias("core"), *_names(ANCHORS)[1:], F.lit(True).alias("asked"))
        return materialize(sets, "matched", outlives=True)


def repeated_intervals(keyed: DataFrame, batches: int = BATCHES, length: int = LENGTH) -> DataFrame:
    """(uid, start, end): byte ranges that repeated strings cover, overlapping ones among them, each once; a written table.
    All other steps are gone from the shared folder by then."""
    with steps(keyed.sparkSession):
        matched = _matched(keyed, batches, length)
        whole, mixed = _resolve(matched, "spans", length)
        mixed = materialize(mixed, "mixed")
        sets = materialize(_of_texts(marked(keyed, mixed)[0], mixed, BLOCKS, partial(_cut_set, length=length)), "sets")
        whole_sets, mixed_sets = _resolve(sets, "set-spans", length)
        mixed_sets = materialize(mixed_sets, "mixed-sets")
        strings = materialize(_of_texts(marked(keyed, mixed_sets)[0], mixed_sets, STRINGS, partial(_one_by_one, length=length)), "strings")
        repeated = materialize(strings.groupBy("string").agg(F.count("*").alias("copies")).where("copies > 1").select("string"), "repeated")
        single = strings.where("asked").join(repeated, "string").select("uid", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
        return materialize(whole.unionByName(whole_sets).unionByName(single).distinct(), "intervals", outlives=True)


def merge_intervals(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[fresh], reach[np.r_[fresh[1:] - 1, len(start) - 1]]


def _cut(text: pa.Scalar, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """What is left of the text's bytes, where the removed runs start and end."""
    data = text.as_buffer().to_pybytes()
    a, b = merge_intervals(start, end)
    kept = b"".join(data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True))
    return kept, a, b


def _with_intervals(keyed: DataFrame, batches: int, length: int) -> tuple[DataFrame, DataFrame]:
    """Documents that may lose bytes, with their ranges (null where a clash of marks brought them), and the others."""
    intervals = repeated_intervals(keyed, batches, length)
    touched, clean = marked(keyed, intervals)
    per_doc = intervals.groupBy("uid").agg(F.collect_list("start").alias("start"), F.collect_list("end").alias("end"))
    return touched.join(per_doc, "uid", "left").select(*keyed.columns, "start", "end"), clean


def _ranges(batch: pa.RecordBatch, i: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray] | None:
    if not batch.column(start)[i].is_valid:
        return None
    return tuple(batch.column(k)[i].values.to_numpy().astype(np.int64) for k in (start, end))


def cut(docs: DataFrame, batches: int = BATCHES, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, the removed spans in order (start and end in bytes), the bytes kept."""
    keyed = keyed_texts(docs).withColumnRenamed("doc", "doc_id")
    touched, clean = _with_intervals(keyed.select("uid", "doc_id", "text"), batches, length)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.empty(0, np.int64)
        for whole in batches_:
            for lo, hi in pieces(whole.column(1), OUT_BYTES):
                batch = whole.slice(lo, hi - lo)
                sizes, texts, starts, ends = [], [], [], []
                for i in range(batch.num_rows):
                    ranges, text = _ranges(batch, i, 2, 3), batch.column(1)[i]
                    kept, start, end = _cut(text, *ranges) if ranges else (text.as_buffer().to_pybytes(), nothing, nothing)
                    sizes.append(len(text.as_buffer()))
                    texts.append(kept)
                    starts.append(start)
                    ends.append(end)
                offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in starts])].astype(np.int32))
                runs = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ends)], names=["start", "end"])
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, runs), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept"])

    gone = touched.select("doc_id", "text", "start", "end").mapInArrow(run, CUT)
    none = F.expr(f"cast(array() as {SPANS})").alias("spans")
    same = clean.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none, F.col("text").cast("binary").alias("kept"))
    return gone.unionByName(same)


def dedup(docs: DataFrame, batches: int = BATCHES, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return cut(docs, batches, length).selectExpr(*DIGESTS)


def apply_dedup(docs: DataFrame, batches: int = BATCHES, length: int = LENGTH) -> DataFrame:
    """The documents with repeated bytes cut out of their texts; bytes of a character that a cut divides go
    too. Documents that had text and have none left go; n_chars, where there is one, is counted anew."""
    aside, place, back = set_aside(docs)
    keyed = aside.withColumn("uid", uid(place["doc_id"], place["text"]))
    intervals = repeated_intervals(keyed_texts(docs), batches, length)
    touched, clean = marked(keyed, intervals)
    per_doc = intervals.groupBy("uid").agg(F.collect_list("start").alias("start"), F.collect_list("end").alias("end"))
    own = aside.columns
    text_at, start_at, end_at = own.index(place["text"]), len(own), len(own) + 1

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            texts, keep = [], []
            for i in range(batch.num_rows):
                ranges = _ranges(batch, i, start_at, end_at)
                text = _cut(batch.column(text_at)[i], *ranges)[0].decode("utf-8", "ignore") if ranges else batch.column(text_at)[i].as_py()
                texts.append(text)
                keep.append(not ranges or bool(text.strip()))
            columns = [pa.array(texts, pa.string()) if k == text_at else batch.column(k) for k in range(len(own))]
            yield pa.RecordBatch.from_arrays(columns, names=own).filter(pa.array(keep, pa.bool_()))

    cut = touched.join(per_doc, "uid", "left").select(*own, "start", "end").mapInArrow(run, aside.schema)
    out = cut.unionByName(clean.select(*own))
    if "n_chars" in place:
        out = out.withColumn(place["n_chars"], F.length(place["text"]).cast("long"))
    return back(out)
