"""As-of joins: each left row gets the latest right row that was known at its moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, *, by: list[str], left_time: str, right_time: str, take: list[str], tie: list[str], bucket_seconds: int = 86_400
) -> DataFrame:
    """``left`` with the columns ``take`` of the last row of ``right`` with equal ``by`` and a time at most the left
    row's; of equal times the largest by ``tie``. Rows are dealt by key and time bucket, so that a hot key is many
    tasks: a window within buckets, then the last row of each bucket carried over to later ones. A left row with a null key
    or time gets nulls; right rows with either are nothing that was known."""
    wanted = list(dict.fromkeys([right_time, *take]))
    payload, tie_of = F.struct(*wanted), F.struct(*tie)
    kinds = right.select(payload.alias("payload"), tie_of.alias("tie")).schema
    none = {name: F.lit(None).cast(kinds[name].dataType) for name in ("payload", "tie")}
    whole = left.select(F.struct("*").alias("row")).schema["row"].dataType

    def side(rows: DataFrame, time: str, number: int, tie_column: Column, found: Column, row: Column) -> DataFrame:
        columns = {"_time": F.unix_micros(time), "_side": F.lit(number), "_tie": tie_column, "_right": found, "_left": row}
        return rows.select(*by, *[c.alias(name) for name, c in columns.items()])

    told = lambda time: F.col(time).isNotNull() & F.forall(F.array(*[F.col(c).isNotNull() for c in by]), lambda x: x)
    known = side(right.where(told(right_time)), right_time, 0, tie_of, payload, F.lit(None).cast(whole))
    asking = side(left.where(told(left_time)), left_time, 1, none["tie"], none["payload"], F.struct("*"))
    both = known.unionByName(asking).withColumn("_bucket", F.floor(F.col("_time") / (bucket_seconds * 1_000_000)))
    order = F.struct("_time", "_side", "_tie")
    within = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_near", F.last("_right", ignorenulls=True).over(within)).where("_left is not null")
    # The buckets' ends are aggregated before they are shuffled, and read no column of the left rows but key and time.
    last = F.max_by("_right", F.when(F.col("_side") == 0, order)).alias("_end")
    ends = both.groupBy(*by, "_bucket").agg(last)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    found = F.coalesce("_near", "_before")
    matched = seen.join(carried, [*by, "_bucket"], "left").select("_left.*", *[found[c].alias(c) for c in wanted])
    payload_kind = kinds["payload"].dataType
    return matched.unionByName(left.where(~told(left_time)).select("*", *[F.lit(None).cast(payload_kind[c].dataType).alias(c) for c in wanted]))


def asof_ahead(rows: DataFrame, *, by: list[str], time: str, ahead: dict[str, int], take: list[str], tie: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """``rows`` with a struct of the columns ``take`` for each name of ``ahead``: those of the last of the rows with equal ``by``
    that is at most so many seconds, 0 or more, later than the row itself; of equal times the largest by ``tie``. What each row
    sees is itself or later, so rows are dealt by key and time bucket, with those of the next buckets that lie within reach: one
    sort, in which every frame only grows. A row with a null key or time gets nulls."""
    if min(ahead.values()) < 0:
        raise ValueError("a row can't look back")
    width = bucket_seconds * 1_000_000
    at, reach = F.unix_micros(time), max(ahead.values()) * 1_000_000
    kinds = rows.select(F.struct(*take).alias("x")).schema["x"].dataType
    told = F.forall(F.array(*[F.col(c).isNotNull() for c in (*by, time)]), lambda x: x)
    own = F.floor(at / width)
    near = F.explode(F.sequence(F.floor((at - reach) / width), own)).alias("_bucket")
    dealt = rows.where(told).select("*", at.alias("_at"), own.alias("_own"), F.struct(at.alias("at"), F.struct(*tie).alias("tie"), F.struct(*take).alias("x")).alias("_known"), near)
    frame = Window.partitionBy(*by, "_bucket").orderBy("_at")
    seen = [F.max("_known").over(frame.rangeBetween(Window.unboundedPreceding, s * 1_000_000))["x"].alias(name) for name, s in ahead.items()]
    found = dealt.select(*rows.columns, "_own", "_bucket", *seen).where("_own = _bucket").drop("_own", "_bucket")
    return found.unionByName(rows.where(~told).select("*", *[F.lit(None).cast(kinds).alias(name) for name in ahead]))


def latest_unambiguous(rows: DataFrame, *, by: list[str], clocks: list[str], pick: Column) -> DataFrame:
    """Per key the rows with the largest clocks: how many share them, and ``pick`` where it is one alone."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in clocks]))
    top = rows.withColumn("_rank", rank).where("_rank = 1")
    return top.groupBy(*by).agg(F.count("*").alias("n_latest"), F.when(F.count("*") == 1, F.max(pick)).alias("picked"))
