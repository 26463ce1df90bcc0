"""Row shapes and rules: domains, scales, clocks, classes, batches and changes of a schedule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from priorline.functions import calendar, probability
from priorline.operators import fits
from priorline.plans import views
from priorline.plans.registry import Registry

SHAPES = Registry()
query = SHAPES.query
EAST = "America/New_York"
#: Name, least and most value, whether only 0 and 1 are allowed.
DOMAINS = (("gap", -25.0, 25.0, False), ("margin", -40.0, 40.0, False), ("p", 0.25, 0.75, False), ("won", 0.0, 1.0, True), ("venue", 0.0, 1.0, True))


@query(
    """select name, count(*) n, count(*) filter (x < low or x > high) outside, count(*) filter (indicator and x not in (0.0, 1.0)) no_indicator from facts join domains using (name) group by 1""",
    """domains as (select * from (values ('gap', -25.0::double, 25.0::double, false), ('margin', -40.0, 40.0, false), ('p', 0.25, 0.75, false), ('won', 0.0, 1.0, true), ('venue', 0.0, 1.0, true)) t(name, low, high, indicator)),
       facts as (select unnest(['gap', 'margin', 'p', 'won', 'venue']) name,
                        unnest([(home - away)::double, (hs - as_)::double, p, won::int::double, case when game_id % 19 = 0 then 0.5 when game_id % 2 = 0 then 1.0 else 0.0 end::double]) x from forecasts)""",
)
def feature_domain(spark, sf_dir):
    """Features against a table of their ranges, and of those that are 0 or 1 only."""
    k = F.col("game_id")
    venue = F.when(k % 19 == 0, 0.5).when(k % 2 == 0, 1.0).otherwise(0.0)
    values = {"gap": (F.col("home") - F.col("away")).cast("double"), "margin": (F.col("hs") - F.col("as_")).cast("double"), "p": F.col("p"), "won": F.col("won").cast("double"), "venue": venue}
    facts = views.forecasts(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("x")) for n, c in values.items()])).alias("f")).select("f.*")
    spec = spark.createDataFrame(DOMAINS, "name string, low double, high double, indicator boolean")  # a row for each feature
    x = F.col("x")
    return facts.join(F.broadcast(spec), "name").groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((x < F.col("low")) | (x > F.col("high"))).alias("outside"), F.count_if(F.col("indicator") & ~x.isin(0.0, 1.0)).alias("no_indicator")
    )


@query(
    "select game_id, round((home - away) / g, 6) gap, round((hs - as_) / m, 6) margin from games, (select sqrt(avg((home - away)::double * (home - away))) g, sqrt(avg((hs - as_)::double * (hs - as_))) m from games where season < 1999)"
)
def scaled_features(spark, sf_dir):
    """Features divided by their root mean squares over the training seasons."""
    g = views.games(spark, sf_dir).select("game_id", "season", (F.col("home") - F.col("away")).cast("double").alias("gap"), (F.col("hs") - F.col("as_")).cast("double").alias("margin"))
    scales = fits.rms_scales(g.where("season < 1999"), ["gap", "margin"]).select(F.col("gap").alias("_gap"), F.col("margin").alias("_margin"))  # one row
    return g.crossJoin(F.broadcast(scales)).select("game_id", *[F.round(F.col(c) / F.col(f"_{c}"), 6).alias(c) for c in ("gap", "margin")])


@query("""
    select batch, count(*) n, min(game_id) as "first", max(game_id) as "last" from (
      select game_id, unnest([k // 500, (k + 250) // 500 + 100000]) batch from (select game_id, row_number() over (partition by season order by game_id) - 1 k from games)) group by 1""")
def rotating_batches(spark, sf_dir):
    """Two turns over each season's games in batches of 500, the second begun half a batch later."""
    k = F.row_number().over(Window.partitionBy("season").orderBy("game_id")) - 1
    turns = F.explode(F.array(F.floor(F.col("k") / 500), F.floor((F.col("k") + 250) / 500) + 100000)).alias("batch")
    b = views.games(spark, sf_dir).withColumn("k", k).select("game_id", turns)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("game_id").alias("first"), F.max("game_id").alias("last"))


@query("select game_date, team, count(*) n from (select game_date, home team from games union all select game_date, away from games) group by 1, 2 having count(*) > 1")
def side_uniqueness(spark, sf_dir):
    """Teams that play twice on a date, on either side."""
    sides = views.games(spark, sf_dir).select("game_date", F.explode(F.array("home", "away")).alias("team"))
    return sides.groupBy("game_date", "team").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""
    select game_id, minutes_, seconds_, timezone('UTC', timezone('America/New_York', wall)) tipoff, wall::date as local_day from (
      select game_id, (case when h = 12 then 12 else h + 12 end) * 60 + m minutes_, (game_id % 12) * 60 + game_id % 60 seconds_,
             game_date + to_minutes((case when h = 12 then 12 else h + 12 end) * 60 + m) wall from (
        select game_id, game_date, game_id % 12 + 1 h, game_id % 60 m from games))""")
def clock_parse(spark, sf_dir):
    """Printed clocks to minutes, seconds and moments: '07:30 (ET)' of a date to UTC, daylight saving heeded, and back to its date."""
    k = F.col("game_id")
    printed = F.concat(F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(" (ET)"))
    left = F.concat((k % 12).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    g = views.games(spark, sf_dir).select("game_id", "game_date", calendar.afternoon_clock(printed).cast("long").alias("minutes_"), calendar.clock_seconds(left).cast("long").alias("seconds_"))
    moment = calendar.utc_moment(F.col("game_date"), F.floor(F.col("minutes_") / 60).cast("int"), (F.col("minutes_") % 60).cast("int"), EAST)
    g = g.withColumn("tipoff", moment)
    return g.select("game_id", "minutes_", "seconds_", F.col("tipoff").cast("timestamp_ntz").alias("tipoff"), calendar.local_day(F.col("tipoff"), EAST).alias("local_day"))


@query("""
    select game_id, round(1 / (1 + exp(-(ln(base_p) - ln(1 - base_p) + 0.3 * (home - away) / 30.0::double - 0.1 * (game_id % 3)))), 6) p,
           case when -(game_id % 5 - 2) * 0.0::double = 0 then 0.0::double else -1.0 end zero from forecasts""")
def logit_scores(spark, sf_dir):
    """A baseline's probability moved by weighted features, and a zero without its sign."""
    score = probability.logit(F.col("base_p")) + 0.3 * (F.col("home") - F.col("away")) / 30.0 - 0.1 * (F.col("game_id") % 3)
    return views.forecasts(spark, sf_dir).select("game_id", F.round(probability.sigmoid(score), 6).alias("p"), probability.unsigned_zero(-(F.col("game_id") % 5 - 2) * F.lit(0.0)).alias("zero"))


@query("""
    select season, count(*) n, round(avg(pow(h - (outcome = 0)::int, 2) + pow(d - (outcome = 1)::int, 2) + pow(a - (outcome = 2)::int, 2)), 6) brier,
           round(avg(-ln(greatest(case outcome when 0 then h when 1 then d else a end, 1e-15))), 6) log_loss from (
      select season, p * 0.9 h, 0.1::double d, (1 - p) * 0.9 a, case when abs(hs - as_) <= 3 then 1 when hs > as_ then 0 else 2 end outcome from forecasts) group by 1""")
def multiclass_scores(spark, sf_dir):
    """Scores of three outcomes: home, close and away."""
    f = views.forecasts(spark, sf_dir)
    outcome = F.when(F.abs(F.col("hs") - F.col("as_")) <= 3, 1).when(F.col("hs") > F.col("as_"), 0).otherwise(2)
    f = f.select("season", F.array(F.col("p") * 0.9, F.lit(0.1), (1 - F.col("p")) * 0.9).alias("q"), outcome.alias("outcome"))
    return f.groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(probability.multiclass_brier(F.col("q"), F.col("outcome"))), 6).alias("brier"),
        F.round(F.avg(probability.multiclass_log_loss(F.col("q"), F.col("outcome"))), 6).alias("log_loss"),
    )


@query("""
    select input, count(*) attempts, min(event_id) first_attempt, count(*) = 1 single from (
      select sha256(user_id::varchar || '|' || ts::date::varchar || '|' || event_type) input, event_id from events) group by 1 having count(*) > 1""")
def attempt_markers(spark, sf_dir):
    """Inputs, told by a digest, that were tried more than once: only the first attempt counts."""
    told = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string"), "event_type"), 256).alias("input")
    e = views.table(spark, sf_dir, "events").select(told, "event_id").groupBy("input")
    return e.agg(F.count(F.lit(1)).alias("attempts"), F.min("event_id").alias("first_attempt"), (F.count(F.lit(1)) == 1).alias("single")).where("attempts > 1")


@query("""
    select game_id, row_number() over (partition by game_id order by period, seq) num, period, case kind when 0 then 'made' when 1 then 'missed' when 2 then 'free throw' when 3 then 'rebound' else 'turnover' end kind,
           player, case when player % 2 = 0 then 'home' else 'away' end side from (
      select l_orderkey game_id, (l_linenumber % 4 + 1)::int period, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate) seq,
             l_partkey % 5 kind, l_suppkey player from lineitem)""")
def play_rows(spark, sf_dir):
    """A game's events from one nested JSON document to flat rows, classified, numbered by period."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    li = views.table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(order))
    play = F.struct("seq", F.struct((F.col("l_linenumber") % 4 + 1).alias("number")).alias("period"), F.struct((F.col("l_partkey") % 5).alias("id")).alias("type"), F.col("l_suppkey").alias("athlete"))
    raw = li.groupBy(F.col("l_orderkey").alias("game_id")).agg(F.to_json(F.struct(F.collect_list(play).alias("plays"))).alias("doc"))
    kind = "plays array<struct<seq:int,period:struct<number:int>,type:struct<id:int>,athlete:long>>"
    flat = raw.select("game_id", F.explode(F.from_json("doc", kind)["plays"]).alias("x"))
    flat = flat.select("game_id", F.col("x.seq").alias("seq"), F.col("x.period.number").alias("period"), F.col("x.type.id").alias("t"), F.col("x.athlete").alias("player"))
    names = F.array(*[F.lit(n) for n in ("made", "missed", "free throw", "rebound", "turnover")])
    num = F.row_number().over(Window.partitionBy("game_id").orderBy("period", "seq")).cast("long")
    return flat.select("game_id", num.alias("num"), "period", names[F.col("t")].alias("kind"), "player", F.when(F.col("player") % 2 == 0, "home").otherwise("away").alias("side"))


@query("""
    select season, count(*) n, round(avg((game_id % 13 <> 0)::int), 6) valid, min(hs - as_) least, max(hs - as_) most, bool_and(abs(hs - as_) <= 49) bounded,
           count(*) filter (hs - as_ between -5 and 5) close from games group by 1""")
def season_validity(spark, sf_dir):
    """Per season the share of valid rows, the range of margins, whether all are in bounds, and how many are close."""
    margin = F.col("hs") - F.col("as_")
    return views.games(spark, sf_dir).groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("game_id") % 13 != 0).cast("int")), 6).alias("valid"), F.min(margin).alias("least"), F.max(margin).alias("most"),
        F.every(F.abs(margin) <= 49).alias("bounded"), F.count_if(margin.between(-5, 5)).alias("close"),
    )


@query("""
    select change, count(*) n, min(event_id) first_id from (
      select event_id, case when starts is not null and before is null and k = 1 then 'insert' when starts is not null and before is null then 'reinstate' when starts is null and before is not null then 'withdraw'
                            when starts <> before then 'amend' end change from (
        select *, lag(starts) over w before, row_number() over w k from (
          select event_id, user_id, ts, case when event_type <> 'error' then (event_id * 7 % 5)::int end starts from events) window w as (partition by user_id order by ts, event_id)))
    where change is not null group by 1""")
def schedule_changes(spark, sf_dir):
    """Polls of a schedule to its changes: what came, moved, vanished and came back."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    polls = views.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", (F.col("event_id") * 7 % 5).cast("int")).alias("starts"))
    polls = polls.withColumns({"before": F.lag("starts").over(w), "k": F.row_number().over(w)})
    now, was = F.col("starts"), F.col("before")
    change = (
        F.when(now.isNotNull() & was.isNull() & (F.col("k") == 1), "insert").when(now.isNotNull() & was.isNull(), "reinstate").when(now.isNull() & was.isNotNull(), "withdraw").when(now != was, "amend")
    )
    return polls.withColumn("change", change).where("change is not null").groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("""
    select game_id, team, round(case when before is null then 0 else (team_zone - before_zone) end, 6)::double as shift from (
      select game_id, team, before, -5 - (arena % 4) team_zone, -5 - (before % 4) before_zone from (
        select *, lag(arena) over (partition by season, team order by game_date, game_id) before from (select *, case when is_away = 0 then team else opp end arena from team_games)))""")
def zone_shift(spark, sf_dir):
    """Hours between the zones of a team's arena and of its last one, none for the first of a season."""
    t = views.team_games(spark, sf_dir).withColumn("arena", F.when(F.col("is_away") == 0, F.col("team")).otherwise(F.col("opp")))
    zone = lambda c: -5 - F.col(c) % 4
    t = t.withColumn("before", F.lag("arena").over(Window.partitionBy("season", "team").orderBy("game_date", "game_id")))
    return t.select("game_id", "team", F.coalesce(zone("arena") - zone("before"), F.lit(0)).cast("double").alias("shift"))
