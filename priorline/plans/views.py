"""The given tables in the roles of games, reports and lines, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.functions.calendar import season
from priorline.functions.probability import elo_probability

TEAMS, STATUSES = 30, {"view": "Available", "click": "Probable", "signup": "Questionable", "purchase": "Doubtful", "error": "Out"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    home, points = F.col("o_custkey") % TEAMS, F.floor("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("game_id"),
        day.alias("game_date"),
        season(day).cast("int").alias("season"),
        home.cast("int").alias("home"),
        ((home + 1 + F.col("o_orderkey") % (TEAMS - 1)) % TEAMS).cast("int").alias("away"),
        (80 + points % 50).cast("int").alias("hs"),
        (80 + (points + 1 + F.col("o_orderkey") % 49) % 50).cast("int").alias("as_"),
    )


def team_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each game, one a team."""
    g = games(spark, sf_dir)
    side = lambda team, opp, pf, pa, away: F.struct(F.col(team).alias("team"), F.col(opp).alias("opp"), F.col(pf).alias("pf"), F.col(pa).alias("pa"), F.lit(away).alias("is_away"))
    both = F.explode(F.array(side("home", "away", "hs", "as_", 0), side("away", "home", "as_", "hs", 1)))
    return g.select("game_id", "game_date", "season", both.alias("s")).select("game_id", "game_date", "season", "s.*")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with their outcome, a baseline by venue Elo and a forecast near it."""
    g = games(spark, sf_dir)
    rating = lambda c: (1400 + F.col(c) * 37 % 200).cast("double")
    base = elo_probability(rating("home"), rating("away"), 60.0)
    nudge = (F.col("game_id") * 7919 % 1000).cast("double") / 10000.0 - 0.05
    return g.select("*", (F.col("hs") > F.col("as_")).alias("won"), base.alias("base_p"), F.greatest(F.least(base + nudge, F.lit(0.99)), F.lit(0.01)).alias("p"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status reports: player, team, moment, status and minutes."""
    e = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])[F.col("event_type")]
    return e.select("event_id", F.col("ts").cast("timestamp").alias("report_time"), F.col("user_id").alias("player"), (F.col("user_id") % TEAMS).cast("int").alias("team"), status.alias("status"), F.col("value").alias("minutes"))


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's team plays six hours later."""
    tipoff = (F.col("report_time") + F.expr("interval 6 hours")).alias("tipoff")
    return reports(spark, sf_dir).select(F.col("event_id").alias("tip_id"), "team", "player", tipoff)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player lines of games: a supplier's lines of an order."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("player")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("minutes"), F.sum((F.round(F.col("l_discount") * 100) - F.round(F.col("l_tax") * 100)).cast("long")).alias("plus_minus")
    )


SQL = """
games as (
  select o_orderkey game_id, cast(o_orderdate as date) game_date,
         cast(year(o_orderdate) + case when month(o_orderdate) >= 7 then 1 else 0 end as int) season,
         cast(o_custkey % 30 as int) home, cast((o_custkey % 30 + 1 + o_orderkey % 29) % 30 as int) away,
         cast(80 + floor(o_totalprice)::bigint % 50 as int) hs, cast(80 + (floor(o_totalprice)::bigint + 1 + o_orderkey % 49) % 50 as int) as_
  from orders),
team_games as (
  select game_id, game_date, season, home team, away opp, hs pf, as_ pa, 0 is_away from games
  union all select game_id, game_date, season, away, home, as_, hs, 1 from games),
rated as (
  select *, hs > as_ as won, 1.0 / (1.0 + pow(10.0::double, -((1400 + home * 37 % 200)::double + 60.0 - (1400 + away * 37 % 200)::double) / 400.0)) as base_p from games),
forecasts as (
  select *, greatest(least(base_p + ((game_id * 7919 % 1000)::double / 10000.0::double - 0.05::double), 0.99::double), 0.01::double) as p from rated),
reports as (
  select event_id, ts report_time, user_id player, cast(user_id % 30 as int) team, value as minutes,
         case event_type when 'view' then 'Available' when 'click' then 'Probable' when 'signup' then 'Questionable' when 'purchase' then 'Doubtful' when 'error' then 'Out' end status
  from events),
tips as (select event_id tip_id, team, player, report_time + interval 6 hour tipoff from reports),
lines as (
  select l_orderkey game_id, l_suppkey player, sum(l_quantity::bigint)::bigint as minutes,
         sum((round(l_discount * 100) - round(l_tax * 100))::bigint)::bigint plus_minus
  from lineitem group by 1, 2)
"""
