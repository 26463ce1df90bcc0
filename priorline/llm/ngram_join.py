"""Self-join of documents on the Jaccard likeness of their word n-grams, with Bayesian candidate pruning.

Words are runs of characters other than ASCII white space; a document's set has its five-word shingles, or
the whole text as one shingle where it has fewer words. Documents with equal sets are copies: one set
stands for all of them, and what follows sees each set once.

1. Candidates: MinHash values, in bands of ROWS; sets that agree in a band meet. Two sets of likeness 0.8
   miss each other in all bands with a chance of 5e-8.
2. Pruning: of sets that meet, MinHash values are compared STEP at a time; a pair is dropped when the
   posterior probability that its likeness reaches the threshold, given the matches so far and a uniform
   prior, falls below TOLERANCE. Of the pairs left only a spanning forest is written, so rows grow with
   sets, not with pairs.
3. Components of these forests are the groups in which links can be. Each group's sets are sent to it
   once, pairs are pruned again in the same way, and the rest is verified exactly.
4. What comes out is each set's number of linked documents and a spanning forest of the links, whose
   components are the classes.

A group of more than BLOCK sets is cut into blocks by hash, and each pair of blocks is a task's piece of
work, so no group is gathered whole anywhere; a piece's memory is bounded by BLOCK texts.

Defined cases: null and empty texts have no shingle, link to nothing and are classes of their own; ties
go to the least doc_id; rows that repeat are copies; a null doc_id is one like any other and comes back
null; texts count whole; an empty table gives no rows; further columns are ignored by ``join`` and kept
by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import pieces, release_memory, set_aside
from priorline.llm.components import components
from priorline.llm.prints import Prints, keyed_texts, marked, mix, uid
from priorline.session import materialize, steps

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 32, 4, 32, 1e-6
BLOCK, AT_ONCE, COLUMNS = 256, 500_000, 4_096

_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_TIMES = _RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_MULTIPLIERS = _RNG.integers(1 << 60, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

SIGNED = "uid binary, doc long, sid long, n int, signature binary, bands array<long>"
FOREST = "a long, b long"
LINKED = "sid long, links long, root long"


def shingle_sets(texts: pa.Array, n_words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted hashes (uint64) of its shingles, each once."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return []
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    if offsets[-1] == offsets[0]:
        return [np.empty(0, np.uint64)] * len(texts)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | edge[:-1]))
    end = np.flatnonzero(word & (np.r_[~word[1:], True] | edge[1:])) + 1
    hashes = mix(Prints(data, 0).of(begin, end) + (end - begin).astype(np.uint64))
    bounds = np.searchsorted(begin, offsets)
    found = []
    n = max(0, len(hashes) - n_words + 1)
    whole = np.zeros(n, np.uint64)
    for k in range(n_words):
        whole += hashes[k : k + n] * _MULTIPLIERS[k]
    whole = mix(whole)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n_words:
            found.append(np.unique(whole[a : b - n_words + 1]))
        elif b > a:
            found.append(mix(np.array([(hashes[a:b] * _MULTIPLIERS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            found.append(np.empty(0, np.uint64))
    return found


def minhash(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS values (uint32) of a non-empty set."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(_XOR), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        least = np.minimum(least, ((low[at : at + 4096, None] ^ _XOR) * _TIMES).min(0))
    return least


def _set_id(shingles: np.ndarray) -> int:
    """64 bits that depend on the set alone."""
    total = int(shingles.sum(dtype=np.uint64)) + 3 * int(mix(shingles).sum(dtype=np.uint64)) + len(shingles)
    return int(mix(np.array([total & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])


def _signed_rows(keyed: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in SIGNED.replace("array<long>", "").split(", ")]
    types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    number = np.arange(BANDS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(2), AT_ONCE):
                sids, sizes, signatures, bands = [], [], [], []
                for s in shingle_sets(batch.column(2).slice(a, b - a)):
                    sizes.append(len(s))
                    if not len(s):
                        sids.append(0)
                        signatures.append(b"")
                        bands.append([])
                        continue
                    sids.append(_set_id(s))
                    values = minhash(s)
                    signatures.append((values >> np.uint32(24)).astype(np.uint8).tobytes())
                    rows = values.reshape(BANDS, ROWS).astype(np.uint64)
                    key = number
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0x100000001B3) + rows[:, r])
                    bands.append(key.view(np.int64))
                columns = (batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), sids, sizes, signatures, bands)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        release_memory()

    return keyed.mapInArrow(run, SIGNED)


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each multiple of STEP values compared the least number of matches that keeps a pair: with fewer,
    the posterior probability of reaching the threshold is below the tolerance. Values of 8 bits also
    match by chance."""
    likeness = np.linspace(0, 1, 20_001)
    match = np.clip(likeness + (1 - likeness) / 256, 1e-12, 1 - 1e-12)
    found = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(match) + (n - m) * np.log1p(-match)
            posterior = np.exp(log - log.max())
            if posterior[likeness >= threshold].sum() / posterior.sum() >= tolerance:
                found.append(m)
                break
    return tuple(found)


def prune(left: np.ndarray, right: np.ndarray, need: tuple[int, ...]) -> np.ndarray:
    """Which pairs of rows of two signature matrices survive the incremental comparison."""
    alive = np.ones((len(left), len(right)), bool)
    i, j = np.nonzero(alive)
    matches = np.zeros(len(i), np.int32)
    for k, least in enumerate(need):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (left[i, part] == right[j, part]).sum(1)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    out = np.zeros((len(left), len(right)), bool)
    out[i, j] = True
    return out


def forest(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric adjacency matrix the least node of its component."""
    root = np.full(len(linked), -1)
    for k in range(len(linked)):
        if root[k] < 0:
            root[k] = k
            edge = linked[k] & (root < 0)
            while edge.any():
                root[edge] = k
                edge = linked[edge].any(0) & (root < 0)
    return root


def _bipartite(linked: np.ndarray) -> np.ndarray:
    """An adjacency matrix of both sides' nodes for links between two blocks."""
    a, b = linked.shape
    out = np.zeros((a + b, a + b), bool)
    out[:a, a:], out[a:, :a] = linked, linked.T
    return out


def _blocks(members: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``members`` (key, sid, ..) dealt to pieces of work: each member once for each block its own block is
    compared with, with columns low and high (the two blocks) and upper (whether it is of the high one)."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int")
    dealt = members.join(sizes, key).withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*members.columns, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("upper"))


def _grouped(rows: DataFrame, key: str, schema: str, work: Callable[[pa.Table], dict[str, list]]) -> DataFrame:
    """Runs ``work`` on the rows of each (key, low, high), which stand together in sorted partitions."""
    at = [rows.columns.index(c) for c in (key, "low", "high")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        done: dict[str, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if done and len(next(iter(done.values()))):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in done.values()], names=list(done))
            done.clear()

        def close() -> None:
            if held and sum(x.num_rows for x in held) > 1:
                for name, values in work(pa.Table.from_batches(held)).items():
                    done.setdefault(name, []).extend(values)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in at], 1)
            cuts = np.r_[0, np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1, len(marks)].tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                group = tuple(marks[a].tolist())
                if group != last:
                    close()
                    last = group
                held.append(batch.slice(a, b - a))
            if done and len(next(iter(done.values()))) > 50_000:
                yield from flush()
        close()
        yield from flush()
        release_memory()

    return rows.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high", "upper", "sid").mapInArrow(run, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _sides(table: pa.Table) -> tuple[int, bool]:
    """Where the high block's rows begin, and whether the piece is one block with itself."""
    same = table.column("low")[0].as_py() == table.column("high")[0].as_py()
    upper = table.column("upper").to_numpy()
    return (len(upper) if same else int(np.argmax(upper)) if upper.any() else len(upper)), same


def _candidate_work(threshold: float) -> Callable[[pa.Table], dict[str, list]]:
    def work(table: pa.Table) -> dict[str, list]:
        need = least_matches(threshold)
        cut, same = _sides(table)
        signatures, sids = _matrix(table.column("signature")), table.column("sid").to_numpy()
        if same:
            linked = prune(signatures, signatures, need)
        elif 0 < cut < len(sids):
            linked = _bipartite(prune(signatures[:cut], signatures[cut:], need))
        else:
            return {"a": [], "b": []}
        root = forest(linked)
        child = root != np.arange(len(root))
        return {"a": sids[root[child]].tolist(), "b": sids[child].tolist()}

    return work


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, as a product of 0/1 matrices by pieces of the columns."""
    every = np.unique(np.concatenate([*left, *right]))
    out = np.zeros((len(left), len(right)), np.float64)
    places = [[np.searchsorted(every, s) for s in side] for side in (left, right)]
    for at in range(0, len(every), COLUMNS):
        both = []
        for side in places:
            m = np.zeros((len(side), min(COLUMNS, len(every) - at)), np.float32)
            for k, p in enumerate(side):
                a, b = np.searchsorted(p, (at, at + COLUMNS))
                m[k, p[a:b] - at] = 1
            both.append(m)
        out += both[0] @ both[1].T
    return out


def _verify_work(threshold: float) -> Callable[[pa.Table], dict[str, list]]:
    def work(table: pa.Table) -> dict[str, list]:
        need = least_matches(threshold)
        cut, same = _sides(table)
        sids, copies = table.column("sid").to_numpy(), table.column("copies").to_numpy()
        signatures = _matrix(table.column("signature"))
        sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.float64)
        if not same and not 0 < cut < len(sids):
            return {"sid": [], "links": [], "root": []}
        lo, hi = (slice(None), slice(None)) if same else (slice(0, cut), slice(cut, None))
        maybe = prune(signatures[lo], signatures[hi], need)
        if same:
            np.fill_diagonal(maybe, False)
        rows, columns = (np.flatnonzero(maybe.any(k)) for k in (1, 0))
        if len(rows):  # only sets with a pair left are compared
            left, right = rows, columns if same else columns + cut
            common = intersections([sets[k] for k in left], [sets[k] for k in right])
            maybe[np.ix_(rows, columns)] &= common >= threshold * (sizes[left][:, None] + sizes[right][None, :] - common) - 1e-9
        linked = maybe if same else _bipartite(maybe)
        links = linked.astype(np.float64) @ copies.astype(np.float64)
        root, has = forest(linked), linked.any(1)
        return {"sid": sids[has].tolist(), "links": links[has].astype(np.int64).tolist(), "root": sids[root[has]].tolist()}

    return work


def _set_rows(texts: DataFrame) -> DataFrame:
    """(sid, copies, label, signature, shingles) from (sid, copies, label, signature, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(4), AT_ONCE):
                part = batch.slice(a, b - a)
                packed = pa.array([s.astype("<u8").tobytes() for s in shingle_sets(part.column(4))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], packed], names=["sid", "copies", "label", "signature", "shingles"])
        release_memory()

    chosen = texts.select("sid", "copies", "label", "signature", "text")
    return chosen.mapInArrow(run, "sid long, copies long, label long, signature binary, shingles binary")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its class), n_links (documents of likeness at
    least ``threshold``, itself not counted), n_copies (documents with its set, itself counted)."""
    return _join(docs, threshold).select(F.col("doc").alias("doc_id"), "class_id", "n_links", "n_copies")


def _join(docs: DataFrame, threshold: float) -> DataFrame:
    keyed = keyed_texts(docs)
    signed = materialize(_signed_rows(keyed), "signed")
    some = signed.where("n > 0")
    # One row for each set: its least document, its copies.
    first = F.min(F.struct("doc", "uid")).alias("one")
    sets = materialize(some.groupBy("sid").agg(F.count("*").alias("copies"), first).select("sid", "copies", "one.*"), "sets")
    banded = signed.join(sets.select("sid", "uid"), ["sid", "uid"]).select("sid", F.explode("bands").alias("band")).distinct()
    banded = materialize(banded, "bands")
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = banded.join(sizes.select("band"), "band", "left_semi")
    signatures = some.groupBy("sid").agg(F.first("signature").alias("signature"))
    signatures = materialize(signatures.join(members.select("sid").distinct(), "sid"), "signatures")
    met = _blocks(members.join(signatures, "sid").select("band", "sid", "signature"), "band", sizes)
    edges = materialize(_grouped(met, "band", FOREST, _candidate_work(threshold)).distinct(), "candidates")
    groups = materialize(components(edges), "groups")
    # Texts of the sets that have candidates go to their groups, once for each block.
    chosen = sets.join(groups, sets["sid"] == groups["node"]).join(signatures, "sid").select("sid", "copies", "label", "signature", "uid")
    chosen = materialize(chosen, "chosen")
    texts = marked(keyed, chosen)[0].join(chosen, "uid").dropDuplicates(["sid"])
    filled = materialize(_set_rows(texts), "shingles")
    pieces_ = _blocks(filled, "label", groups.groupBy("label").agg(F.count("*").alias("size")))
    linked = materialize(_grouped(pieces_, "label", LINKED, _verify_work(threshold)), "linked")
    classes = components(linked.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    per_set = linked.groupBy("sid").agg(F.sum("links").alias("links"))
    named = sets.join(classes, sets["sid"] == classes["node"], "left").join(per_set, "sid", "left")
    named = materialize(named.select("sid", "copies", "doc", F.coalesce("label", "sid").alias("label"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    least = named.groupBy("label").agg(F.min(F.struct("doc")).alias("first")).select("label", F.col("first.doc").alias("class_id"))  # null is least
    named = named.join(least, "label").select("sid", "copies", "label", "class_id", "links")
    out = some.select("uid", "doc", "sid").join(named, "sid").select("uid", "doc", "label", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    bare = signed.where("n = 0").select("uid", "doc", F.lit(None).cast("long").alias("label"), F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(bare)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with the columns of ``docs``: the one with the least doc_id, of rows that
    share that id one. Documents without a shingle all stay."""
    aside, at, back = set_aside(docs)
    with steps(docs.sparkSession):
        found = materialize(_join(docs, threshold), "found", outlives=True)
    least = F.min(F.struct("doc", "uid")).alias("one")
    named = found.groupBy("label").agg(least, F.count("*").alias("size")).where("size > 1").select("label", F.col("one.uid").alias("stays"))
    gone = materialize(found.join(named, "label").select("uid", (F.col("uid") == F.col("stays")).alias("names")).distinct(), "gone")
    doubtful, clear = marked(aside.withColumn("uid", uid(at["doc_id"], at["text"])), gone)
    joined = doubtful.join(gone, "uid", "left")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(at["text"]))
    kept = joined.withColumn("rank", rank).where("names is null or (names and rank = 1)")
    return back(kept.select(*aside.columns).unionByName(clear.select(*aside.columns)))
