"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bounds that stand in a plan as a literal; more ranges are told in two steps.
LITERAL_BOUNDS = 512


def range_bucket(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` with the column range, which numbers ranges of the integer ``key``, about ``buckets`` of them: upwards,
    in steps of more than one where there are many, -1 for null. Only the keys are read to place the bounds. Beyond
    LITERAL_BOUNDS, coarse ranges are told first, and the bounds within each are broadcast, 8 bytes for each range."""
    wide = max(1, min(buckets, LITERAL_BOUNDS))
    row = df.select(F.percentile_approx(key, [i / wide for i in range(1, wide)] or [0.5], 20 * wide).alias("b")).head()
    coarse = _over(F.array(*[F.lit(b).cast("long") for b in sorted(set(row.b or []))]), F.col(key))
    if buckets <= LITERAL_BOUNDS:
        return df.withColumn("range", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(coarse).cast("long"))
    fine = -(-buckets // wide)
    share = [i / fine for i in range(1, fine)]
    keyed = df.select(F.col(key).alias("_key"), coarse.alias("_coarse")).where("_key is not null")
    bounds = materialize(keyed.groupBy("_coarse").agg(F.array_distinct(F.percentile_approx("_key", share, 20 * fine)).alias("_bounds")), "bounds")
    found = df.withColumn("_coarse", coarse).join(F.broadcast(bounds), "_coarse", "left")
    number = F.col("_coarse") * (fine + 1) + F.coalesce(_over(F.col("_bounds"), F.col(key)), F.lit(0))
    return found.withColumn("range", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(number).cast("long")).drop("_coarse", "_bounds")


def _over(bounds: Column, key: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= key))


def pieces(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary column with at most ``most`` bytes each, a single row aside."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += int(n)
    if at < len(sizes):
        yield at, len(sizes)


def release_memory() -> None:
    """Gives memory that a Python worker no longer uses back to the system. Workers outlive tasks and stages, and
    pools of freed blocks would otherwise add up from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns under names that no operator uses, the new name of each, and the way back;
    columns of a caller can't clash with those that an operator adds."""
    names = docs.columns
    own = [f"own_{i}" for i in range(len(names))]
    return docs.toDF(*own), dict(zip(names, own, strict=True)), lambda df: df.select(*own).toDF(*names)
