"""Several tables published as one version, and small files beside them, through Hadoop's file systems."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Store:
    """Small text files under ``root``, wherever that lies. A name is created once and never written again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self._conf), path

    def names(self, folder: str) -> list[str]:
        fs, path = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def sizes(self, folder: str) -> dict[str, int]:
        """The files anywhere below a folder and their bytes."""
        fs, path = self._at(folder)
        found, out = fs.listFiles(path, True), {}
        while found.hasNext():
            x = found.next()
            out[x.getPath().getName()] = x.getLen()
        return out

    def text(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def claim(self, name: str) -> None:
        """Creates an empty file; an error if it is there already, also if another writer was faster."""
        fs, path = self._at(name)
        fs.create(path, False).close()

    def create(self, name: str, text: str) -> None:
        """Writes a file whole under another name first, so that nobody ever sees a part of it."""
        fs, path = self._at(name)
        if fs.exists(path):
            raise FileExistsError(name)
        _, part = self._at(f".{uuid.uuid4().hex}.part")
        stream = fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs.mkdirs(path.getParent())
        if not fs.rename(part, path):
            raise FileExistsError(name)

    def remove(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)


def table_digest(df: DataFrame) -> DataFrame:
    """One row, rows and digest, which no order of the rows changes: the sum of their 64-bit hashes."""
    named = sorted(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*named), {"ignoreNullFields": "false"})).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def current_version(spark: SparkSession, root: str) -> int:
    """The last version that was published whole, 0 for none."""
    return max((int(x.removesuffix(".json")) for x in Store(spark, root).names("manifests")), default=0)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: int) -> int:
    """Publishes ``tables`` as one new version and gives its number. They are written to folders of their own and read
    back; the manifest, with their rows, digests and schemas, comes last, and readers see nothing of a version without
    one: a publication that dies leaves the old version as it was. ``expected`` is the version that the writer started from;
    if another is current by now, or a second writer claims the same number, this is an error."""
    store = Store(spark, root)
    if (now := current_version(spark, root)) != expected:
        raise ValueError(f"version {now} is current, not {expected}")
    number = 1 + max([now, *(int(x) for x in store.names("claims"))])
    store.claim(f"claims/{number:08d}")
    told = {}
    for name, df in tables.items():
        path = f"{store.root}/versions/{number:08d}/{name}"
        df.write.mode("errorifexists").parquet(path)
        row = table_digest(spark.read.schema(df.schema).parquet(path)).head()
        told[name] = {"rows": row.rows, "digest": row.digest, "schema": json.loads(df.schema.json())}
    if current_version(spark, root) != expected:
        raise ValueError("another version was published meanwhile")
    store.create(f"manifests/{number:08d}.json", json.dumps({"version": number, "tables": told}, sort_keys=True))
    return number


def published(spark: SparkSession, root: str, name: str, version: int | None = None, verify: bool = False) -> DataFrame:
    """A table of the current or a given version; with ``verify`` its rows and digest have to be the manifest's."""
    number = version or current_version(spark, root)
    if not number:
        raise FileNotFoundError(f"nothing is published under {root}")
    told = json.loads(Store(spark, root).text(f"manifests/{number:08d}.json"))["tables"][name]
    df = spark.read.schema(StructType.fromJson(told["schema"])).parquet(f"{root.rstrip('/')}/versions/{number:08d}/{name}")
    if verify:
        row = table_digest(df).head()
        if (row.rows, row.digest) != (told["rows"], told["digest"]):
            raise ValueError(f"{name} of version {number} isn't what was published")
    return df
