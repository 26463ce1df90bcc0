"""Joins that check what they join: positions, coverage, priorities, sets and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.session import materialize


def positional_join(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The k-th left row of a key with its k-th right row, where both sides have as many; and a note for each
    key where they don't."""
    number = lambda order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    l, r = left.withColumn("_k", number(left_order)), right.withColumn("_k", number(right_order))
    counts = l.groupBy(*by).agg(F.count(F.lit(1)).alias("n_left")).join(r.groupBy(*by).agg(F.count(F.lit(1)).alias("n_right")), by, "full_outer")
    counts = counts.select(*by, F.coalesce("n_left", F.lit(0)).cast("long").alias("n_left"), F.coalesce("n_right", F.lit(0)).cast("long").alias("n_right"))
    even = counts.where("n_left = n_right").select(*by)
    return l.join(r, [*by, "_k"]).join(even, by, "left_semi").drop("_k"), counts.where("n_left <> n_right")


def cover(cohort: DataFrame, forecasts: DataFrame, key: str, value: str, reason: str = "missing forecast") -> tuple[DataFrame, DataFrame]:
    """Every cohort row with its forecast or the reason for none; and the forecasts of no cohort row."""
    found = cohort.join(forecasts.select(key, value), key, "left")
    return found.withColumn("failure", F.when(F.col(value).isNull(), F.lit(reason))), forecasts.join(cohort, key, "left_anti")


def priority_lookup(rows: DataFrame, tables: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """``value`` from the first of ``tables`` (dimension, its key columns) that has a row's key."""
    out = rows
    for k, (dimension, keys) in enumerate(tables):
        named = dimension.select(*keys, F.col(value).alias(f"_{k}"))
        out = out.join(named, keys, "left")
    return out.withColumn(value, F.coalesce(*[F.col(f"_{k}") for k in range(len(tables))])).drop(*[f"_{k}" for k in range(len(tables))])


def numbered(rows: DataFrame, key: str, name: str = "k", ranges: int = 64) -> DataFrame:
    """``rows`` with dense numbers from 1 in the order of ``key``: sorted ranges are numbered by themselves, after the
    count of all ranges before, one row for each. Rows of one key may lie in two ranges, in any order."""
    placed = materialize(rows.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "numbered")
    own = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_least"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(own.select("_range", "_least", before.alias("_before"))), "_range").withColumn(name, F.col("_before") + F.col("_row") - F.col("_least") + 1).drop("_range", "_row", "_least", "_before")


def divides(rows: DataFrame, group: str, member: str, required: DataFrame) -> DataFrame:
    """Relational division: per group how many of the required members it has, and whether all."""
    wanted = required.agg(F.count_distinct(member).alias("n_required"))
    have = rows.join(required.select(member).distinct(), member, "left_semi").groupBy(group).agg(F.count_distinct(member).alias("n_found"))
    return have.crossJoin(F.broadcast(wanted)).withColumn("complete", F.col("n_found") == F.col("n_required"))  # one row is broadcast


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_of_orbit(rows: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """The earliest row of each unordered pair (a, b)."""
    window = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(window)).where("_k = 1").drop("_k")
