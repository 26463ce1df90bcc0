"""Hash chains and digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorline.operators.folds import ordered_fold
from priorline.sources.store import Store, table_digest

GENESIS = "0" * 64


def chain(rows: DataFrame, by: str, order: list[str], body: Column, heads: DataFrame | None = None) -> DataFrame:
    """Links each key's rows: event_hash = sha256(previous event_hash | body hash), in order; behind the key's head
    where ``heads`` (by, seq, event_hash) has one."""

    def step(state: list, row: tuple) -> tuple:
        key, digest, seq, head, *rest = row
        if not state:
            state += [head or GENESIS, 0 if seq is None else seq + 1]
        previous, state[0] = state[0], hashlib.sha256(f"{state[0]}|{digest}".encode()).hexdigest()
        state[1] += 1
        return key, rest[-1], state[1] - 1, digest, previous, state[0]

    chosen = rows.select(by, F.sha2(body, 256).alias("_digest"), *order)
    none = {"_seq": F.lit(None).cast("long"), "_head": F.lit(None).cast("string")}
    chosen = chosen.withColumns(none) if heads is None else chosen.join(heads.select(by, F.col("seq").alias("_seq"), F.col("event_hash").alias("_head")), by, "left")
    chosen = chosen.select(by, "_digest", "_seq", "_head", *order)
    last = rows.schema[order[-1]].dataType.simpleString()
    return ordered_fold(chosen, by=[by], order=order, start=list, step=step, schema=f"{by} long, event {last}, seq long, body_hash string, prev_hash string, event_hash string")


class StaleHead(ValueError):
    """The ledger has moved on since the head that a writer expects."""


class StoredChain:
    """Chains, one for each ``by``, in a folder: batches of links, the heads after each of them, and a commit file that comes
    last. What has no commit is a torn tail: the next append logs its digest and takes it away. A batch is told by its id, and
    one that was committed changes nothing when it comes again."""

    def __init__(self, spark: SparkSession, path: str, by: str) -> None:
        self._spark, self._by, self.store = spark, by, Store(spark, path)

    def commits(self) -> list[dict]:
        return [json.loads(self.store.text(f"commits/{name}")) for name in self.store.names("commits")]

    @property
    def head(self) -> str:
        """The head of the ledger as a whole: a chain of its batches' digests."""
        said = self.commits()
        return said[-1]["head"] if said else GENESIS

    def links(self) -> DataFrame:
        """The links of all committed batches."""
        paths = [f"{self.store.root}/links/{c['number']:08d}" for c in self.commits()]
        if not paths:
            raise FileNotFoundError(f"no batch was appended to {self.store.root}")
        return self._spark.read.parquet(*paths)

    def heads(self) -> DataFrame | None:
        """Each key's last sequence number and hash."""
        said = self.commits()
        return self._spark.read.parquet(f"{self.store.root}/heads/{said[-1]['number']:08d}") if said else None

    def _cut(self, last: int) -> None:
        for folder in ("links", "heads"):
            for name in self.store.names(folder):
                if int(name) > last:
                    listed = json.dumps(sorted(self.store.sizes(f"{folder}/{name}").items()))
                    cut = {"folder": f"{folder}/{name}", "digest": hashlib.sha256(listed.encode()).hexdigest()}
                    self.store.create(f"cuts/{len(self.store.names('cuts')):08d}.json", json.dumps(cut))
                    self.store.remove(f"{folder}/{name}")

    def append(self, rows: DataFrame, batch_id: str, order: list[str], body: Column, expected: str | None = None, expected_heads: DataFrame | None = None) -> str:
        """Appends a batch behind each key's head, in ``order``, and gives the ledger's new head. ``expected`` is the head
        of the ledger, ``expected_heads`` (by, event_hash) the heads of keys, that the batch was made for; a StaleHead
        if there are others by now."""
        said = self.commits()
        if any(c["id"] == batch_id for c in said):
            return self.head
        last, head = (said[-1]["number"], said[-1]["head"]) if said else (0, GENESIS)
        if expected not in (None, head):
            raise StaleHead(f"the head is {head}, not {expected}")
        before = self.heads()
        if expected_heads is not None:
            mine = before.select(self._by, F.col("event_hash").alias("_now")) if before is not None else expected_heads.select(self._by, F.lit(None).cast("string").alias("_now")).limit(0)
            stale = expected_heads.join(mine, self._by, "left").where(F.coalesce("_now", F.lit(GENESIS)) != F.col("event_hash"))
            if not stale.isEmpty():
                raise StaleHead("a key's head has moved on")
        self._cut(last)
        number = last + 1
        path = f"{self.store.root}/links/{number:08d}"
        chain(rows, self._by, order, body, before).write.parquet(path)
        new = self._spark.read.parquet(path)
        ends = new.groupBy(self._by).agg(F.max("seq").alias("seq"), F.max_by("event_hash", "seq").alias("event_hash"))
        every = ends if before is None else ends.unionByName(before.join(ends, self._by, "left_anti"))
        every.write.parquet(f"{self.store.root}/heads/{number:08d}")
        told = table_digest(new).head()
        head = hashlib.sha256(f"{head}|{batch_id}|{told.rows}|{told.digest}".encode()).hexdigest()
        self.store.create(f"commits/{number:08d}.json", json.dumps({"number": number, "id": batch_id, "links": told.rows, "digest": told.digest, "head": head}))
        return head


def audit(links: DataFrame, by: str) -> DataFrame:
    """Per key: links, breaks (wrong sequence, wrong previous hash, wrong own hash) and the head."""
    before = Window.partitionBy(by).orderBy("seq")
    own = F.sha2(F.concat_ws("|", "prev_hash", "body_hash"), 256)
    checked = links.withColumns({
        "_prev": F.coalesce(F.lag("event_hash").over(before), F.lit(GENESIS)),
        "_seq": F.coalesce(F.lag("seq").over(before) + 1, F.lit(0)),
    })
    wrong = (F.col("_prev") != F.col("prev_hash")) | (F.col("_seq") != F.col("seq")) | (own != F.col("event_hash"))
    return checked.groupBy(by).agg(F.count(F.lit(1)).alias("links"), F.count_if(wrong).alias("breaks"), F.max_by("event_hash", "seq").alias("head"))


def block_digests(rows: DataFrame, key: str, body: Column, size: int = 1_000) -> DataFrame:
    """An order-sensitive digest of each block of ``size`` consecutive keys, over the rows' own digests."""
    each = rows.select(F.floor(F.col(key) / size).cast("long").alias("block"), key, F.sha2(body, 256).alias("_d"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(key, "_d"))), lambda x: x["_d"])
    return each.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(ordered, ""), 256).alias("digest"))
