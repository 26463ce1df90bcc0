"""Features from strictly earlier rows of a team's season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST = 10


def day_number(day: str) -> Column:
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))


def prior_days(by: list[str], day: str, first: int | None = None):
    """Rows of earlier dates only, at most ``first`` days back: rows of one date never see each other."""
    back = Window.unboundedPreceding if first is None else -first
    return Window.partitionBy(*by).orderBy(day_number(day)).rangeBetween(back, -1)


def count_between(by: list[str], at: Column, first: int, last: int) -> Column:
    """How many rows lie from ``first`` to ``last`` of the row's own ``at``: the running count up to ``last`` less the one
    before ``first``. Each row enters a running count once; a frame that slides is summed anew at every step, which takes
    the rows times those of a frame."""
    up_to = lambda end: F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy(at).rangeBetween(Window.unboundedPreceding, end))
    return up_to(last) - up_to(first - 1)


def _with_days(rows: DataFrame, days: DataFrame, by: list[str], day: str) -> DataFrame:
    """``rows`` with the further columns of ``days``, a row for each key and date, null ones too."""
    keys = [*by, day]
    named = days.withColumnsRenamed({c: f"_{c}" for c in keys})
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]).drop(*[f"_{c}" for c in keys])


def _load_days(rows: DataFrame, by: list[str], day: str, away: str) -> DataFrame:
    """For each key and date, counted before any window: what ``load_features`` tells of its rows, which all see the same."""
    days = rows.groupBy(*by, day).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(away).cast("long")).alias("_away"))
    last = F.max(day_number(day)).over(prior_days(by, day))
    gap = day_number(day) - last
    week = prior_days(by, day, 7)
    return days.select(
        *by, day,
        F.coalesce(gap - 1, F.lit(0)).cast("long").alias("rest_days"),
        F.coalesce(gap == 1, F.lit(False)).alias("back_to_back"),
        F.coalesce(F.sum("_n").over(week), F.lit(0)).alias("games_7d"),
        F.coalesce(F.sum("_away").over(week), F.lit(0)).cast("long").alias("road_7d"),
    )


def load_features(rows: DataFrame, *, by: list[str], day: str, away: str) -> DataFrame:
    """rest_days, back_to_back, games and road games of the last seven days. Windows run over dates, not over rows."""
    return _with_days(rows, _load_days(rows, by, day, away), by, day)


def last_rows(by: list[str], day: str, order: str, n: int = LAST):
    """The ``n`` rows before, of whatever date; ``of_day`` makes of them those of earlier dates."""
    return Window.partitionBy(*by).orderBy(day, order).rowsBetween(-n, -1)


def of_day(rows: DataFrame, name: str, by: list[str], day: str, order: str) -> DataFrame:
    """Column ``name`` of a date's first row on all rows of the date: what it knows are the rows before it, which are
    all of earlier dates. Rows lie by ``by`` already, so nothing is shuffled again."""
    return rows.withColumn(name, F.first(name).over(Window.partitionBy(*by, day).orderBy(order)))


def _form_days(rows: DataFrame, by: list[str], day: str, order: str, won: str, margin: str) -> DataFrame:
    """For each key and date what ``form_features`` tells of its rows, which all see the same. No later date sees more than a
    date's last LAST rows, so no others are in a window; they go before rows are shuffled."""
    back = F.row_number().over(Window.partitionBy(*by, day).orderBy(F.desc(order)))
    few = rows.select(*by, day, order, F.col(won).cast("double").alias("_won"), F.col(margin).cast("double").alias("_margin"), back.alias("_back")).where(F.col("_back") <= LAST)
    ten, first = last_rows(by, day, order), F.row_number().over(Window.partitionBy(*by, day).orderBy(order))
    seen = few.select(*by, day, F.count(F.lit(1)).over(ten).alias("n_last"), F.avg("_won").over(ten).alias("_won"), F.avg("_margin").over(ten).alias("_margin"), first.alias("_first"))
    return seen.where("_first = 1").select(*by, day, "n_last", F.coalesce("_won", F.lit(0.5)).alias("win_rate"), F.coalesce("_margin", F.lit(0.0)).alias("mean_margin"))


def form_features(rows: DataFrame, *, by: list[str], day: str, order: str, won: str, margin: str) -> DataFrame:
    """Means of the last LAST results before the row's date, 0.5 and 0 where there is none. Windows run over a date's last LAST
    rows, not over all."""
    return _with_days(rows, _form_days(rows, by, day, order, won, margin), by, day)


def day_features(rows: DataFrame, *, by: list[str], day: str, order: str, away: str, won: str, margin: str) -> DataFrame:
    """A row for each key and date: what ``load_features`` and ``form_features`` tell of its rows."""
    return _with_days(_load_days(rows, by, day, away), _form_days(rows, by, day, order, won, margin), by, day)
