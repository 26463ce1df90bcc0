"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: What a session for this library sets; a cluster's own settings win where it has any.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Seconds from one release of finished shuffles to the next.
RELEASE_SECONDS = 2.0


def build_session(app: str = "priorline", **conf: str) -> SparkSession:
    """A session with DEFAULTS, then ``conf`` (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets one of
    its own; on a cluster, whose executors would each write to their own disk, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="priorline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The folders written within each open block of ``steps``, the innermost last.
_open_steps: ContextVar[tuple[list[str], ...]] = ContextVar("open_steps", default=())


@contextmanager
def steps(spark: SparkSession) -> Iterator[list[str]]:
    """What ``materialize`` writes within the block goes when the block ends, by an error too; what is written with
    ``outlives`` belongs to the block around it. Nothing that is computed later may read what goes."""
    own: list[str] = []
    token = _open_steps.set((*_open_steps.get(), own))
    try:
        yield own
    finally:
        _open_steps.reset(token)
        for path in own:
            remove(spark, path)


def materialize(df: DataFrame, name: str = "step", partition_by: tuple[str, ...] = (), outlives: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, so a lost executor costs the
    reader nothing. A block of ``steps`` takes it away again, or ``remove``."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    owners = _open_steps.get()[: -1 if outlives else None]
    if owners:
        owners[-1].append(path)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    _release_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


_released = [0.0]


def _release_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects the plans that made them. Long jobs of many steps would otherwise hold
    the disk until it happens to, so it is asked to, but not again within RELEASE_SECONDS."""
    now = time.monotonic()
    if now - _released[0] > RELEASE_SECONDS:
        spark.sparkContext._jvm.System.gc()
        _released[0] = now


def remove(spark: SparkSession, path: str) -> None:
    """Takes a written folder away, once nothing reads it any more; only within the shared folder."""
    if not path.startswith(work_dir(spark) + "/"):
        raise ValueError(f"{path} is not in the shared folder")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
