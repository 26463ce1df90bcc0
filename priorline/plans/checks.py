"""Coverage, lineage and order: what has to agree between tables, and the rows that don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.functions import probability
from priorline.operators import asof, joins, ledger
from priorline.plans import views
from priorline.plans.registry import Registry

CHECKS = Registry()
query = CHECKS.query
_LOSS = "-ln(greatest(case when won then {p} else 1.0 - {p} end, 1e-15))"


def _tally(rows: DataFrame, rules: dict[str, Column], *by: str) -> DataFrame:
    """How many rows break each rule, by ``by``; rules that no row breaks don't show."""
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*by, F.explode(broken).alias("rule")).groupBy(*by, "rule").agg(F.count(F.lit(1)).alias("n"))


def _rules(rules: dict[str, str]) -> str:
    return "unnest([" + ", ".join(f"case when {c} then '{name}' end" for name, c in rules.items()) + "]) rule"


@query(
    """select team, count(*) n, count(*) filter (stored is distinct from event_id) wrong from (
         select t.tip_id, t.team, max_by(r.event_id, (r.report_time, r.event_id)) event_id,
                case when t.tip_id % 13 = 0 then max_by(r.before, (r.report_time, r.event_id)) else max_by(r.event_id, (r.report_time, r.event_id)) end stored
         from tips t left join chained r on r.team = t.team and r.report_time <= t.tipoff - interval 60 minute group by 1, 2) group by 1""",
    "chained as (select *, coalesce(lag(event_id) over (partition by team order by report_time, event_id), -1) before from reports)",
)
def asof_lineage(spark, sf_dir):
    """Stored lineage against the as-of winner: every thirteenth row has the report before it on record."""
    r = views.reports(spark, sf_dir).withColumn("before", F.coalesce(F.lag("event_id").over(Window.partitionBy("team").orderBy("report_time", "event_id")), F.lit(-1)))
    t = views.tips(spark, sf_dir).withColumn("cutoff", F.col("tipoff") - F.expr("interval 60 minutes"))
    found = asof.asof_join(t, r, by=["team"], left_time="cutoff", right_time="report_time", take=["event_id", "before"], tie=["event_id"])
    stored = F.when(F.col("tip_id") % 13 == 0, F.col("before")).otherwise(F.col("event_id"))
    return found.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.count_if(~stored.eqNullSafe(F.col("event_id"))).alias("wrong"))


@query(
    """select coalesce(c.season, f.season) season, count(*) n, count(*) filter (c.game_id = a.game_id and c.game_id = f.game_id) aligned, count(*) filter (f.game_id is null or c.game_id is null) unpaired
       from c full join a using (k) full join f on f.k = coalesce(c.k, a.k) group by 1""",
    """c as (select season, game_id, row_number() over (order by game_id) k from games), a as (select game_id, row_number() over (order by game_id) k from games),
       f as (select season, game_id, row_number() over (order by game_id) k from games where game_id % 997 <> 0)""",
)
def zip_join(spark, sf_dir):
    """Cohort, answers and forecasts side by side in order of id: positions, not ids, decide, and forecasts lack some games."""
    g = views.games(spark, sf_dir)
    c, a = joins.numbered(g.select("season", "game_id"), "game_id"), joins.numbered(g.select(F.col("game_id").alias("answer")), "answer")
    f = joins.numbered(g.where("game_id % 997 <> 0").select(F.col("season").alias("other"), F.col("game_id").alias("forecast")), "forecast")
    both = c.join(a, "k", "full_outer").join(f, "k", "full_outer")
    aligned = (F.col("game_id") == F.col("answer")) & (F.col("game_id") == F.col("forecast"))
    unpaired = F.col("forecast").isNull() | F.col("game_id").isNull()
    return both.groupBy(F.coalesce("season", "other").alias("season")).agg(F.count(F.lit(1)).alias("n"), F.count_if(aligned).alias("aligned"), F.count_if(unpaired).alias("unpaired"))


_AGREE = {"missing": "r.game_id is null", "extra": "l.game_id is null", "home": "l.home <> r.home", "score": "l.hs <> r.hs", "early": "r.resolved <= l.game_date"}


@query(
    f"select rule, count(*) n from (select {_rules(_AGREE)} from l full join r on l.game_id = r.game_id) where rule is not null group by 1",
    """l as (select * from games where game_id % 31 <> 0),
       r as (select game_id, case when game_id % 41 = 0 then away else home end home, case when game_id % 43 = 0 then hs + 1 else hs end hs,
                    game_date + (game_id % 47)::int as resolved from games where game_id % 37 <> 0)""",
)
def replay_agreement(spark, sf_dir):
    """Two records of the games, outer joined: ids on one side only, attributes that differ, results known no later than the game."""
    g = views.games(spark, sf_dir)
    left = g.where("game_id % 31 <> 0").alias("l")
    right = g.where("game_id % 37 <> 0").select(
        "game_id", F.when(F.col("game_id") % 41 == 0, F.col("away")).otherwise(F.col("home")).alias("home"),
        F.when(F.col("game_id") % 43 == 0, F.col("hs") + 1).otherwise(F.col("hs")).alias("hs"), F.date_add("game_date", (F.col("game_id") % 47).cast("int")).alias("resolved"),
    ).alias("r")
    both = left.join(right, F.col("l.game_id") == F.col("r.game_id"), "full_outer")
    return _tally(both, {name: F.expr(c) for name, c in _AGREE.items()})


@query(
    """select season, count(*) filter (a and b and c) complete, count(*) filter (not (a and b and c)) partial, sum(margin) filter (a and b and c)::bigint margin from (
         select coalesce(i.season, f.season, y.season) season, i.game_id is not null a, f.game_id is not null b, y.game_id is not null c, y.margin
         from i full join f on i.game_id = f.game_id full join y on y.game_id = coalesce(i.game_id, f.game_id)) group by 1""",
    """i as (select season, game_id from games where game_id % 53 <> 0), f as (select season, game_id from games where game_id % 59 <> 0),
       y as (select season, game_id, hs - as_ margin from games where game_id % 61 <> 0)""",
)
def three_way_sets(spark, sf_dir):
    """Inputs, features and labels: rows that all three have, and rows that one or two lack."""
    g = views.games(spark, sf_dir)
    side = lambda n, name: F.when(F.col("game_id") % n != 0, F.lit(1)).alias(name)
    parts = [g.where(side(n, "x") == 1).select("season", "game_id", F.lit(name).alias("part"), *( [(F.col("hs") - F.col("as_")).alias("margin")] if name == "labels" else [F.lit(None).cast("int").alias("margin")])) for n, name in ((53, "inputs"), (59, "features"), (61, "labels"))]
    each = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("season", "game_id").agg(F.count_distinct("part").alias("parts"), F.max("margin").alias("margin"))
    return each.groupBy("season").agg(F.count_if(F.col("parts") == 3).alias("complete"), F.count_if(F.col("parts") < 3).alias("partial"), F.sum(F.when(F.col("parts") == 3, F.col("margin"))).alias("margin"))


@query(
    f"""select season, count(*) n, round(avg({_LOSS.format(p='p')}), 6) model, round(avg({_LOSS.format(p='market')}), 6) market
        from forecasts join quoted using (game_id) group by 1""",
    """lines_ as (select game_id, (case when game_id % 2 = 0 then -(105 + game_id % 200) else 100 + game_id % 150 end)::double x,
                         (case when game_id % 2 = 1 then -(105 + game_id % 200) else 100 + game_id % 150 end)::double y from games where game_id % 4 <> 0),
       implied as (select game_id, case when x < 0 then -x / (-x + 100.0::double) else 100.0::double / (x + 100.0::double) end h,
                          case when y < 0 then -y / (-y + 100.0::double) else 100.0::double / (y + 100.0::double) end a from lines_),
       quoted as (select game_id, h / (h + a) market from implied)""",
)
def market_benchmark(spark, sf_dir):
    """Model and market on the games that have a quote."""
    line = lambda k: F.when(F.col("game_id") % 2 == k, -(105 + F.col("game_id") % 200)).otherwise(100 + F.col("game_id") % 150).cast("double")
    h, a = probability.implied_probability(line(0)), probability.implied_probability(line(1))
    quoted = views.games(spark, sf_dir).where("game_id % 4 <> 0").select("game_id", (h / (h + a)).alias("market"))
    f = views.forecasts(spark, sf_dir).join(quoted, "game_id")
    loss = lambda p: F.round(F.avg(probability.log_loss(F.col(p), F.col("won"))), 6)
    return f.groupBy("season").agg(F.count(F.lit(1)).alias("n"), loss("p").alias("model"), loss("market").alias("market"))


@query(
    """select game_id, season, sha256(home::varchar || '@' || away::varchar) as hash from games g where season >= 2001 and not exists (
         select 1 from games t where t.season < 2000 and t.hs - t.as_ > 45 and sha256(t.home::varchar || '@' || t.away::varchar)
           in (sha256(g.home::varchar || '@' || g.away::varchar), sha256(g.away::varchar || '@' || g.home::varchar)))""",
)
def unseen_prompts(spark, sf_dir):
    """Rows whose prompt is in no earlier season, in neither orientation: an anti-join on the lesser of both hashes."""
    g = views.games(spark, sf_dir)
    text = lambda a, b: F.sha2(F.concat(F.col(a).cast("string"), F.lit("@"), F.col(b).cast("string")), 256)
    keyed = g.withColumns({"hash": text("home", "away"), "orbit": F.least(text("home", "away"), text("away", "home"))})
    known = keyed.where("season < 2000 and hs - as_ > 45").select("orbit").distinct()
    return keyed.where("season >= 2001").join(known, "orbit", "left_anti").select("game_id", "season", "hash")


_BATCH = {"duplicate": "n > 1", "missing": "n = 0", "extra": "scheduled = 0", "identity": "scheduled = 1 and n > 0 and not same"}


@query(
    f"select rule, count(*) n from (select {_rules(_BATCH)} from each_) where rule is not null group by 1",
    """batches as (
         select game_id, home, away, game_date from games where game_id % 5 = 0 and game_id % 67 <> 0 union all select game_id, home, away, game_date from games where game_id % 5 in (1, 2)
         union all select game_id, case when game_id % 71 = 0 then away else home end, away, game_date from games where game_id % 5 in (2, 3, 4) and (game_id % 5 > 2 or game_id % 73 = 0)
         union all select -game_id, home, away, game_date from games where game_id % 79 = 0),
       each_ as (select coalesce(s.game_id, b.game_id) id, count(b.game_id) n, max((s.game_id is not null)::int) scheduled,
                        coalesce(bool_and(s.home = b.home and s.away = b.away and s.game_date = b.game_date), true) same
                 from games s full join batches b on s.game_id = b.game_id group by 1)""",
)
def batch_union(spark, sf_dir):
    """Forecast batches put together against the schedule: repeats, games without a forecast, forecasts without a game, other identities."""
    g = views.games(spark, sf_dir).select("game_id", "home", "away", "game_date")
    other = g.withColumn("home", F.when(F.col("game_id") % 71 == 0, F.col("away")).otherwise(F.col("home")))
    b = g.where("game_id % 5 = 0 and game_id % 67 <> 0").unionByName(g.where("game_id % 5 in (1, 2)"))
    b = b.unionByName(other.where("game_id % 5 in (2, 3, 4) and (game_id % 5 > 2 or game_id % 73 = 0)")).unionByName(g.where("game_id % 79 = 0").withColumn("game_id", -F.col("game_id")))
    same = (F.col("s.home") == F.col("b.home")) & (F.col("s.away") == F.col("b.away")) & (F.col("s.game_date") == F.col("b.game_date"))
    both = g.alias("s").join(b.alias("b"), F.col("s.game_id") == F.col("b.game_id"), "full_outer")
    each = both.groupBy(F.coalesce("s.game_id", "b.game_id").alias("id")).agg(
        F.count("b.game_id").alias("n"), F.max(F.col("s.game_id").isNotNull().cast("int")).alias("scheduled"), F.coalesce(F.every(same), F.lit(True)).alias("same")
    )
    return _tally(each, {name: F.expr(c) for name, c in _BATCH.items()})


@query(
    """select coalesce(a.season, b.season) season, a.n is not distinct from b.n and a.d is not distinct from b.d same from
         (select season, count(*) n, sum(('0x' || substr(sha256(game_id::varchar), 1, 8))::bigint)::bigint d from games group by 1) a full join
         (select season, count(*) n, sum(('0x' || substr(sha256(game_id::varchar), 1, 8))::bigint)::bigint d from forecasts where season <> 1999 or game_id % 83 <> 0 group by 1) b on a.season = b.season""")
def lineage_digests(spark, sf_dir):
    """Two artifacts of the same games by season: equal if counts and digests of their ids are."""
    part = F.conv(F.substring(F.sha2(F.col("game_id").cast("string"), 256), 1, 8), 16, 10).cast("long")
    told = lambda df, tag: df.groupBy("season").agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.sum(part).alias(f"d_{tag}"))
    b = views.forecasts(spark, sf_dir).where("season <> 1999 or game_id % 83 <> 0")
    both = told(views.games(spark, sf_dir), "a").join(told(b, "b"), "season", "full_outer")
    return both.select("season", (F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("d_a").eqNullSafe(F.col("d_b"))).alias("same"))


@query(
    """select e.team, e.day, e.slot, o.n is not null found from (select distinct team, day, unnest([0, 1, 2, 3]) slot from r) e
       left join (select team, day, slot, count(*) n from r group by 1, 2, 3) o on o.team = e.team and o.day = e.day and o.slot = e.slot where o.n is null""",
    "r as (select team, report_time::date as day, (hour(report_time) // 6)::int slot from reports)",
)
def missing_snapshots(spark, sf_dir):
    """The expected matrix of team, day and quarter of a day less the observed one."""
    r = views.reports(spark, sf_dir).select("team", F.to_date("report_time").alias("day"), F.floor(F.hour("report_time") / 6).cast("int").alias("slot"))
    expected = r.select("team", "day").distinct().select("team", "day", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot"))
    return expected.join(r.distinct(), ["team", "day", "slot"], "left_anti").withColumn("found", F.lit(False))


@query(f"""
    select arm, season, count(*) n, round(avg({_LOSS.format(p='q')}), 6) log_loss, round(avg(pow(q - won::int::double, 2.0)), 6) brier from (
      select 'base' arm, f.season, g.hs > g.as_ won, f.base_p q from forecasts f join games g on g.home = f.home and g.away = f.away and g.game_date = f.game_date
      union all select 'model', f.season, g.hs > g.as_, f.p from forecasts f join games g on g.home = f.home and g.away = f.away and g.game_date = f.game_date) group by 1, 2""")
def forecast_outcomes(spark, sf_dir):
    """Forecasts with the outcomes of their matchup and date, scored by arm."""
    f = views.forecasts(spark, sf_dir).select("season", "home", "away", "game_date", F.explode(F.array(F.struct(F.lit("base").alias("arm"), F.col("base_p").alias("q")), F.struct(F.lit("model").alias("arm"), F.col("p").alias("q")))).alias("x"))
    g = views.games(spark, sf_dir).select("home", "away", "game_date", (F.col("hs") > F.col("as_")).alias("won"))
    both = f.join(g, ["home", "away", "game_date"]).select("season", "won", "x.*")
    loss, brier = probability.log_loss(F.col("q"), F.col("won")), probability.brier(F.col("q"), F.col("won"))
    return both.groupBy("arm", "season").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 6).alias("log_loss"), F.round(F.avg(brier), 6).alias("brier"))


@query("""
    select game_id, round((p + 1 - q) / 2, 6) average, round(abs(p - (1 - q)), 6) gap from (
      select game_id, p, least(greatest(1 - p + (game_id % 7) / 100.0::double, 0.01::double), 0.99::double) q from forecasts)""")
def swap_pairs(spark, sf_dir):
    """Each question asked from both sides, its two rows paired as neighbours: the average and the gap between them."""
    f = views.forecasts(spark, sf_dir)
    other = F.least(F.greatest(1 - F.col("p") + (F.col("game_id") % 7).cast("double") / 100.0, F.lit(0.01)), F.lit(0.99))
    rows = f.select("game_id", F.explode(F.array(F.struct(F.lit(False).alias("swapped"), F.col("p").alias("q")), F.struct(F.lit(True).alias("swapped"), other.alias("q")))).alias("x")).select("game_id", "x.*")
    paired = rows.withColumn("next", F.lead("q").over(Window.partitionBy("game_id").orderBy("swapped"))).where("not swapped")
    return paired.select("game_id", F.round((F.col("q") + 1 - F.col("next")) / 2, 6).alias("average"), F.round(F.abs(F.col("q") - (1 - F.col("next"))), 6).alias("gap"))


_CHAIN = {"retrieved": "retrieved > as_of", "generated": "as_of > generated", "recorded": "generated > recorded", "deadline": "recorded >= deadline", "tipoff": "deadline >= tipoff"}
_STEPS = """ordered as (select event_id, event_type, ts - to_microseconds(event_id % 7 * 1000000) retrieved, ts as_of, ts + to_microseconds((event_id % 11 - 1) * 1000000) generated,
                   ts + to_microseconds(event_id % 13 * 1000000) recorded, ts + to_microseconds(10 * 1000000) deadline, ts + to_microseconds((5 + event_id % 17) * 1000000) tipoff from events)"""


def _ordered(spark, sf_dir) -> DataFrame:
    """Moments around an event, by fixed numbers of seconds."""
    later = lambda seconds: F.unix_micros(F.col("ts").cast("timestamp")) + seconds.cast("long") * 1_000_000
    k = F.col("event_id")
    return views.table(spark, sf_dir, "events").select(
        "event_id", "event_type", later(-(k % 7)).alias("retrieved"), later(F.lit(0)).alias("as_of"), later(k % 11 - 1).alias("generated"), later(k % 13).alias("recorded"),
        later(F.lit(10)).alias("deadline"), later(5 + k % 17).alias("tipoff"),
    )


@query(f"select event_type, rule, count(*) n from (select event_type, {_rules(_CHAIN)} from ordered) where rule is not null group by 1, 2", _STEPS)
def moment_order(spark, sf_dir):
    """Rows that break the order retrieved, as of, generated, recorded, deadline, tipoff."""
    return _tally(_ordered(spark, sf_dir), {name: F.expr(c) for name, c in _CHAIN.items()}, "event_type")


@query(
    """select batch, count(*) n, max(as_of) <= min(generated) and max(generated) <= max(recorded) and max(recorded) < min(tipoff) causal,
              (epoch_us(min(tipoff)) - epoch_us(max(as_of))) // 1000000 slack from (select *, event_id // 50 batch from ordered) group by 1""",
    _STEPS,
)
def causal_batches(spark, sf_dir):
    """Per batch: all inputs known before anything is generated, generated before sealed, sealed before the first tipoff."""
    b = _ordered(spark, sf_dir).withColumn("batch", F.floor(F.col("event_id") / 50))
    causal = (F.max("as_of") <= F.min("generated")) & (F.max("generated") <= F.max("recorded")) & (F.max("recorded") < F.min("tipoff"))
    slack = F.expr("(min(tipoff) - max(as_of)) div 1000000")
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), causal.alias("causal"), slack.alias("slack"))


@query("""
    select season, min(game_date - (game_id % 5)::int) earliest, min(game_date - (game_id % 5)::int) >= make_date(season - 1, 7, 1) committed from games group by 1""")
def commitment_deadlines(spark, sf_dir):
    """Per season the earliest moment of an input, which has to be after the season's commitment."""
    known = F.date_sub("game_date", (F.col("game_id") % 5).cast("int"))
    g = views.games(spark, sf_dir).withColumn("known", known)
    return g.groupBy("season").agg(F.min("known").alias("earliest")).withColumn("committed", F.col("earliest") >= F.make_date(F.col("season") - 1, F.lit(7), F.lit(1)))


@query(f"""
    select season, count(*) n, count(*) filter (abs(stored - p) > 1e-9) wrong, round(max(abs(stored - p)), 6) worst
    from (select *, case when game_id % 89 = 0 then p + 0.001 else p end stored from forecasts) group by 1""")
def recomputed(spark, sf_dir):
    """Stored probabilities against those computed anew."""
    f = views.forecasts(spark, sf_dir).withColumn("stored", F.when(F.col("game_id") % 89 == 0, F.col("p") + 0.001).otherwise(F.col("p")))
    gap = F.abs(F.col("stored") - F.col("p"))
    return f.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count_if(gap > 1e-9).alias("wrong"), F.round(F.max(gap), 6).alias("worst"))


@query("""
    select s.season, s.n, (select max(season) from games where season <= 1999) trained_to, s.season > (select max(season) from games where season <= 1999) later, s.answers = 0 answer_free
    from (select season, count(*) n, count(*) filter (season < 1999) answers from games group by 1) s""")
def season_bindings(spark, sf_dir):
    """Which seasons a forecast may be bound to: later than all of training, and without answers on file."""
    g = views.games(spark, sf_dir)
    last = g.where("season <= 1999").agg(F.max("season").alias("trained_to"))  # one row is broadcast
    s = g.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("season") < 1999).alias("answers"))
    return s.crossJoin(F.broadcast(last)).select("season", "n", "trained_to", (F.col("season") > F.col("trained_to")).alias("later"), (F.col("answers") == 0).alias("answer_free"))


@query("""
    select a.season, a.n, a.ids = b.ids paired, a.d = b.d equal from
      (select season, count(*) n, sum(('0x' || substr(sha256(game_id::varchar), 1, 8))::bigint)::bigint ids, sum(round(base_p * 1e6)::bigint)::bigint d from forecasts group by 1) a join
      (select season, sum(('0x' || substr(sha256(game_id::varchar), 1, 8))::bigint)::bigint ids, sum(round(p * 1e6)::bigint)::bigint d from forecasts group by 1) b using (season)""")
def arm_seals(spark, sf_dir):
    """Seals of two arms' outputs by season: over the same questions, and not the same answers."""
    ids = F.sum(F.conv(F.substring(F.sha2(F.col("game_id").cast("string"), 256), 1, 8), 16, 10).cast("long"))
    told = lambda p: F.sum(F.round(F.col(p) * 1e6).cast("long"))
    f = views.forecasts(spark, sf_dir)
    a = f.groupBy("season").agg(F.count(F.lit(1)).alias("n"), ids.alias("a_ids"), told("base_p").alias("a"))
    b = f.groupBy("season").agg(ids.alias("b_ids"), told("p").alias("b"))
    return a.join(b, "season").select("season", "n", (F.col("a_ids") == F.col("b_ids")).alias("paired"), (F.col("a") == F.col("b")).alias("equal"))


@query("""
    select source, count(*) n, min(game_id) as first_id from (
      select 'first half' source, game_id from games where month(game_date) <= 6 union all select 'second half', game_id from games where month(game_date) > 6
      union all select 'none', game_id from games where season < 0) group by 1""")
def sources_with_rows(spark, sf_dir):
    """Several sources put together; one without rows leaves no trace."""
    g = views.games(spark, sf_dir)
    part = lambda name, rule: g.where(rule).select(F.lit(name).alias("source"), "game_id")
    every = part("first half", "month(game_date) <= 6").unionByName(part("second half", "month(game_date) > 6")).unionByName(part("none", "season < 0"))
    return every.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("game_id").alias("first_id"))


_CHAIN_SQL = """body as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 seq, sha256(concat_ws('|', event_id::varchar, event_type, props)) d from events),
chain as (select user_id, event_id, seq, d, repeat('0', 64) prev, sha256(repeat('0', 64) || '|' || d) h from body where seq = 0
          union all select b.user_id, b.event_id, b.seq, b.d, c.h, sha256(c.h || '|' || b.d) from chain c join body b on b.user_id = c.user_id and b.seq = c.seq + 1)"""


@query("select user_id, count(*) links, 0::bigint breaks, max_by(h, seq) head from chain group by 1", _CHAIN_SQL)
def hash_chain_audit(spark, sf_dir):
    """A chain of each user's events, then the audit of all chains."""
    return ledger.audit(_links(spark, sf_dir), "user_id")


def _links(spark, sf_dir) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    return ledger.chain(e, "user_id", ["ts", "event_id"], F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props"))


@query(
    "select user_id, count(*) links, count(*) filter (seq = 5) breaks, max_by(h, seq) head from chain group by 1",
    _CHAIN_SQL,
)
def tampered_chain_audit(spark, sf_dir):
    """The audit where the sixth link's body was changed after the fact: one break, at that link."""
    links = _links(spark, sf_dir).withColumn("body_hash", F.when(F.col("seq") == 5, F.sha2(F.lit("changed"), 256)).otherwise(F.col("body_hash")))
    return ledger.audit(links, "user_id")


_STATES = {"outcome first": "event_type = 'purchase' and opened = 0", "second outcome": "event_type = 'purchase' and opened > 0 and closed > 0", "time goes back": "ts < before"}


@query(
    f"select rule, count(*) n from (select {_rules(_STATES)} from states) where rule is not null group by 1",
    """stamped as (select *, date_trunc('day', ts) as day from events),
       states as (select *, count(*) filter (event_type = 'view') over w opened, count(*) filter (event_type = 'purchase') over w closed, lag(ts) over (partition by user_id order by event_id) before
                  from stamped window w as (partition by user_id, day order by event_id rows between unbounded preceding and 1 preceding))""",
)
def ledger_states(spark, sf_dir):
    """Each user's day as a ledger: a view is a forecast, a purchase its resolution; one resolution a forecast, none before it, time never back."""
    e = views.table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    w = Window.partitionBy("user_id", "day").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda kind: F.count(F.when(F.col("event_type") == kind, F.lit(1))).over(w)
    states = e.withColumns({"opened": seen("view"), "closed": seen("purchase"), "before": F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))})
    return _tally(states, {name: F.expr(c) for name, c in _STATES.items()})
