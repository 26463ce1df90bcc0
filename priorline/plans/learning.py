"""Fits, gates, ratings and arms, each with SQL that takes the same steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.functions import probability
from priorline.operators import fits, folds, scoring
from priorline.plans import views
from priorline.plans.registry import Registry, rounded

LEARNING = Registry()
query = LEARNING.query
_LOSS = "-ln(greatest(case when won then {p} else 1.0 - {p} end, 1e-15))"
_LOGIT = "(ln({0}) - ln(1.0 - {0}))"
#: Rows of the fits: outcome, offset and two features.
_ROWS = f"""fit_rows as (select game_id, season, game_date, won, won::int::double y, {_LOGIT.format('base_p')} o, (home - away) / 30.0::double x1, {_LOGIT.format('p')} - {_LOGIT.format('base_p')} x2, p, base_p from forecasts)"""


def _newton(name: str, rows: str, x1: str, x2: str, offset: str = "o", l2: float = 0.01) -> str:
    """Newton steps for the weights of two columns as a common table expression ``name`` with one row (w1, w2)."""
    return f"""
{name}_steps as (
  select 0 k, 0.0::double w1, 0.0::double w2
  union all
  select k + 1, w1 - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), w2 - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) from (
    select k, w1, w2, avg((q - y) * a) + {l2} * w1 g1, avg((q - y) * b) + {l2} * w2 g2, avg(q * (1 - q) * a * a) + {l2} h11, avg(q * (1 - q) * a * b) h12, avg(q * (1 - q) * b * b) + {l2} h22
    from (select k, w1, w2, y, {x1} a, {x2} b, 1 / (1 + exp(-({offset} + w1 * ({x1}) + w2 * ({x2})))) q from {name}_steps, {rows} where k < 12) group by k, w1, w2)),
{name} as (select w1, w2 from {name}_steps where k = 12)"""


def _fit_rows(spark, sf_dir) -> DataFrame:
    f = views.forecasts(spark, sf_dir)
    logit = probability.logit
    return f.select(
        "game_id", "season", "game_date", "won", "p", "base_p", logit(F.col("base_p")).alias("o"), ((F.col("home") - F.col("away")) / 30.0).alias("gap"),
        (logit(F.col("p")) - logit(F.col("base_p"))).alias("nudge"),
    )


def _weights(spark, w: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, round(v, 8)) for k, v in w.items()], "feature string, weight double")


@query("select 'gap' feature, round(w1, 8) weight from fit union all select 'nudge', round(w2, 8) from fit", f"{_ROWS}, {_newton('fit', 'fit_rows', 'x1', 'x2')}")
def offset_logistic_fit(spark, sf_dir):
    """Weights of two features beside a baseline's logit."""
    return _weights(spark, fits.offset_logistic(_fit_rows(spark, sf_dir), ["gap", "nudge"], "won", "o"))


@query(
    "select 'slope' feature, round(w1, 8) weight from fit union all select 'intercept', round(w2, 8) from fit",
    f"{_ROWS}, early as (select * from fit_rows where season < 2000), {_newton('fit', 'early', 'o', '1.0::double', '0.0', 0.0)}",
)
def logit_recalibration(spark, sf_dir):
    """Slope and intercept of a baseline's logit on the seasons before 2000."""
    f = _fit_rows(spark, sf_dir).where("season < 2000").select("won", F.col("o").alias("slope"))
    return _weights(spark, fits.offset_logistic(f, ["slope"], "won", l2=0.0, intercept=True))


_SCALED = """scale as (select sqrt(avg(x1 * x1)) s1, sqrt(avg(x2 * x2)) s2 from fit_rows where season < 1999),
paired as (select y, o, x1 / s1 x1, x2 / s2 x2 from fit_rows, scale where season < 1999 union all select 1 - y, -o, -x1 / s1, -x2 / s2 from fit_rows, scale where season < 1999)"""


@query(
    f"""select season, count(*) n, round(avg({_LOSS.format(p='q')}), 6) fitted, round(avg({_LOSS.format(p='base_p')}), 6) base, round(max(gap), 6) as gap from (
          select season, won, base_p, (q + 1 - other) / 2 q, abs(q + other - 1) gap from (
            select season, won, base_p, 1 / (1 + exp(-(o + w1 * x1 / s1 + w2 * x2 / s2))) q, 1 / (1 + exp(-(-o - w1 * x1 / s1 - w2 * x2 / s2))) other from fit_rows, scale, fit where season >= 1999)) group by 1""",
    f"{_ROWS}, {_SCALED}, {_newton('fit', 'paired', 'x1', 'x2')}",
)
def paired_fit(spark, sf_dir):
    """Features divided by their training scales, every game from both sides, then later seasons predicted: the mean of a
    side's probability and of what the other side's leaves, whose gap is 0."""
    f = _fit_rows(spark, sf_dir)
    train = f.where("season < 1999")
    s = fits.rms_scales(train, ["gap", "nudge"]).head()
    scaled = lambda df: df.withColumns({c: F.col(c) / F.lit(s[c]) for c in ("gap", "nudge")})
    mirrored = lambda df: df.withColumns({"won": ~F.col("won"), **{c: -F.col(c) for c in ("o", "gap", "nudge")}})
    w = fits.offset_logistic(scaled(train).unionByName(mirrored(scaled(train))), ["gap", "nudge"], "won", "o")
    told = lambda k: probability.sigmoid(k * (F.col("o") + sum(F.lit(v) * F.col(c) for c, v in w.items())))
    late = scaled(f.where("season >= 1999")).withColumns({"q": told(1), "other": told(-1)})
    late = late.withColumns({"mean": (F.col("q") + 1 - F.col("other")) / 2, "apart": F.abs(F.col("q") + F.col("other") - 1)})
    loss = lambda p: F.round(F.avg(probability.log_loss(F.col(p), F.col("won"))), 6)
    return late.groupBy("season").agg(F.count(F.lit(1)).alias("n"), loss("mean").alias("fitted"), loss("base_p").alias("base"), F.round(F.max("apart"), 6).alias("gap"))


_VARIANTS = {"gap": (["gap"], "x1", "0.0::double"), "nudge": (["nudge"], "x2", "0.0::double"), "both": (["gap", "nudge"], "x1", "x2")}


@query(
    f"""select variant, season, n, loss, base, round(sum(loss * n) over (partition by variant) / sum(n) over (partition by variant), 6) pooled from (
          select variant, season, count(*) n, round(avg({_LOSS.format(p='q')}), 6) loss, round(avg({_LOSS.format(p='base_p')}), 6) base from ("""
    + " union all ".join(f"select '{v}' variant, season, won, base_p, 1 / (1 + exp(-(o + w1 * ({a}) + w2 * ({b})))) q from fit_rows, fit_{v} where season >= 1999" for v, (_, a, b) in _VARIANTS.items())
    + ") group by 1, 2)",
    ", ".join([_ROWS, "early as (select * from fit_rows where season < 1999)", *(_newton(f"fit_{v}", "early", a, b) for v, (_, a, b) in _VARIANTS.items())]),
)
def variant_grid(spark, sf_dir):
    """Variants of the features fitted on the early seasons and scored on each later one beside the baseline, with the
    mean of seasons weighted by their games."""
    f = _fit_rows(spark, sf_dir)
    names = ["gap", "nudge"]
    sides = F.array(*[F.struct(F.lit(v).alias("variant"), *[(F.col(c) if c in used else F.lit(0.0)).alias(f"_{c}") for c in names]) for v, (used, _, _) in _VARIANTS.items()])
    train = f.where("season < 1999").select("won", "o", F.explode(sides).alias("x")).select("won", "o", "x.*")
    w = {r.variant: r.w for r in fits.offset_logistic_by(train, ["variant"], [f"_{c}" for c in names], "won", "o").collect()}  # a row for each variant
    late, none = f.where("season >= 1999"), [0.0] * len(names)
    parts = [F.struct(F.lit(v).alias("variant"), probability.sigmoid(F.col("o") + sum(F.lit(x) * F.col(c) for x, c in zip(w.get(v, none), names, strict=True))).alias("q")) for v in _VARIANTS]
    each = late.select("season", "won", "base_p", F.explode(F.array(*parts)).alias("x")).select("season", "won", "base_p", "x.*")
    loss = lambda p: F.round(F.avg(probability.log_loss(F.col(p), F.col("won"))), 6)
    grid = each.groupBy("variant", "season").agg(F.count(F.lit(1)).alias("n"), loss("q").alias("loss"), loss("base_p").alias("base"))
    of = Window.partitionBy("variant")
    return grid.withColumn("pooled", F.round(F.sum(F.col("loss") * F.col("n")).over(of) / F.sum("n").over(of), 6))


_BOOT = """weeks as (select season, date_trunc('week', game_date)::date as week, sum(gain) total, count(*) n from gains group by 1, 2),
blocks as (select *, row_number() over (partition by season order by week) - 1 k, count(*) over (partition by season) m from weeks),
draws as (select season, r, ('0x' || substr(md5(season::varchar || '|' || r::varchar || '|' || k::varchar), 1, 8))::bigint % m pick from blocks, (select unnest(range(1, 10001)) r)),
means as (select d.season, d.r, sum(b.total) / sum(b.n) x from draws d join blocks b on b.season = d.season and b.k = d.pick group by 1, 2),
bound as (select season, list_sort(list(x))[500] low from means group by 1),
whole as (select season, count(*) n_blocks, sum(n)::bigint games, sum(total) / sum(n) mean from weeks group by 1)"""
_GAINS = f"gains as (select season, game_date, {_LOSS.format(p='base_p')} - {_LOSS.format(p='p')} gain from forecasts)"


@query("select season, n_blocks, round(mean, 6) mean, round(low, 6) lower_bound, low > 0 passes from whole join bound using (season)", f"{_GAINS}, {_BOOT}")
def bootstrap_gate(spark, sf_dir):
    f = views.forecasts(spark, sf_dir)
    gain = probability.log_loss(F.col("base_p"), F.col("won")) - probability.log_loss(F.col("p"), F.col("won"))
    blocks = scoring.calendar_blocks(f.withColumn("gain", gain), F.col("gain"), "season", "game_date")
    return fits.block_bootstrap(blocks, "season").select("season", "n_blocks", rounded("mean"), rounded("lower_bound"), "passes")


_MIN_GAMES, _MIN_BLOCKS = 1000, 20


@query(
    f"""select *, bool_and(passes) over () gate from (
          select comparison, season, games, n_blocks, round(mean, 6) mean, round(low, 6) lower_bound, low > 0 and games >= {_MIN_GAMES} and n_blocks >= {_MIN_BLOCKS} passes from (
            select 'base' comparison, season, games, n_blocks, mean, low from whole join bound using (season) union all
            select 'recalibrated', season, games, n_blocks, mean, low from whole2 join bound2 using (season)))""",
    ", ".join([
        _ROWS, "early as (select * from fit_rows where season < 2000)", _newton("cal", "early", "o", "1.0::double", "0.0", 0.0),
        f"""later as (select f.season, f.game_date, f.won, f.p, f.base_p, 1 / (1 + exp(-(w1 * o + w2))) cal_p from fit_rows f, cal where f.season >= 2000)""",
        f"gains as (select season, game_date, {_LOSS.format(p='base_p')} - {_LOSS.format(p='p')} gain from later)", _BOOT,
        f"gains2 as (select season, game_date, {_LOSS.format(p='cal_p')} - {_LOSS.format(p='p')} gain from later)",
        _BOOT.replace("gains", "gains2").replace("weeks", "weeks2").replace("blocks as", "blocks2 as").replace("from blocks,", "from blocks2,").replace("join blocks b", "join blocks2 b").replace("draws as", "draws2 as").replace("from draws d", "from draws2 d").replace("means as", "means2 as").replace("from means ", "from means2 ").replace("bound as", "bound2 as").replace("whole as", "whole2 as"),
    ]),
)
def full_gate(spark, sf_dir):
    """The gate over the seasons from 2000 on: the forecast against the baseline, and against the baseline recalibrated on
    the seasons before; each season needs a lower bound above 0, enough games and enough weeks, and all have to pass."""
    f = _fit_rows(spark, sf_dir)
    early = f.where("season < 2000").select("won", F.col("o").alias("slope"))
    w = fits.offset_logistic(early, ["slope"], "won", l2=0.0, intercept=True)
    late = f.where("season >= 2000").withColumn("cal_p", probability.sigmoid(F.lit(w["slope"]) * F.col("o") + F.lit(w["intercept"])))
    parts = []
    for name, other in (("base", "base_p"), ("recalibrated", "cal_p")):
        gain = probability.log_loss(F.col(other), F.col("won")) - probability.log_loss(F.col("p"), F.col("won"))
        blocks = scoring.calendar_blocks(late.withColumn("gain", gain), F.col("gain"), "season", "game_date")
        parts.append(fits.block_bootstrap(blocks, "season").withColumn("comparison", F.lit(name)))
    both = parts[0].unionByName(parts[1])
    passes = (F.col("lower_bound") > 0) & (F.col("games") >= _MIN_GAMES) & (F.col("n_blocks") >= _MIN_BLOCKS)
    both = both.select("comparison", "season", "games", "n_blocks", rounded("mean"), F.round("lower_bound", 6).alias("lower_bound"), passes.alias("passes"))
    return both.withColumn("gate", F.every("passes").over(Window.partitionBy()))  # a row for each season and comparison


@query(
    """select label, count(*) n, round(avg(oracle), 6) oracle, round(avg(mixture), 6) mixture, count(distinct best) best_arms, min(best)::int first_best from (
         select label, list_min(losses) oracle, -ln(list_avg([exp(-x) for x in losses])) mixture, list_position(losses, list_min(losses)) best from (
           select label, [ln(1 + exp(case when label % 2 = 1 then -3 * x::double else 3 * x::double end)) for x in embedding] losses from embeddings)) group by 1"""
)
def arm_losses(spark, sf_dir):
    """Each value of a vector as an arm's logit: the least loss of a row, the loss of the arms' mean, and the arm that is best."""
    e = views.table(spark, sf_dir, "embeddings")
    sign = F.when(F.col("label") % 2 == 1, F.lit(-3.0)).otherwise(F.lit(3.0))
    e = e.select("label", F.transform("embedding", lambda x: F.ln(1 + F.exp(sign * x.cast("double")))).alias("losses"))
    mean = F.aggregate("losses", F.lit(0.0), lambda a, x: a + F.exp(-x)) / F.size("losses")
    e = e.select("label", F.array_min("losses").alias("oracle"), (-F.ln(mean)).alias("mixture"), F.array_position("losses", F.array_min("losses")).alias("best"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), rounded_mean("oracle"), rounded_mean("mixture"), F.count_distinct("best").alias("best_arms"), F.min("best").cast("int").alias("first_best"))


def rounded_mean(name: str):
    return F.round(F.avg(name), 6).alias(name)


@query(
    """select bucket, arm, count(*) n, round(avg(ln(1 + exp(case when label % 2 = 1 then -3 * x::double else 3 * x::double end))), 6) loss from (
         select label, case when label = 0 then 'none' when label <= 5 then 'few' else 'many' end bucket, unnest(embedding) x, generate_subscripts(embedding, 1)::int arm from embeddings) group by 1, 2"""
)
def bucket_losses(spark, sf_dir):
    """Mean loss of each arm by context bucket: none, up to five, more."""
    bucket = F.when(F.col("label") == 0, "none").when(F.col("label") <= 5, "few").otherwise("many").alias("bucket")
    e = views.table(spark, sf_dir, "embeddings").select("label", bucket, F.posexplode("embedding").alias("at", "x"))
    sign = F.when(F.col("label") % 2 == 1, F.lit(-3.0)).otherwise(F.lit(3.0))
    loss = F.ln(1 + F.exp(sign * F.col("x").cast("double")))
    return e.groupBy("bucket", (F.col("at") + 1).alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 6).alias("loss"))


@query(
    f"""select difficulty, arm, count(*) n, round(avg({_LOSS.format(p='q')}), 6) mean_loss, round(min({_LOSS.format(p='q')}), 6) least, round(max({_LOSS.format(p='q')}), 6) most from (
          select case when greatest(p, 1 - p) < 0.6 then 'hard' when greatest(p, 1 - p) < 0.75 then 'medium' else 'easy' end difficulty, won, unnest(['base', 'model']) arm, unnest([base_p, p]) q from forecasts) group by 1, 2"""
)
def arm_difficulty(spark, sf_dir):
    """Losses of both arms by how sure the model is."""
    top = F.greatest("p", 1 - F.col("p"))
    arms = F.array(F.struct(F.lit("base").alias("arm"), F.col("base_p").alias("q")), F.struct(F.lit("model").alias("arm"), F.col("p").alias("q")))
    f = views.forecasts(spark, sf_dir).select("won", F.when(top < 0.6, "hard").when(top < 0.75, "medium").otherwise("easy").alias("difficulty"), F.explode(arms).alias("x")).select("won", "difficulty", "x.*")
    loss = probability.log_loss(F.col("q"), F.col("won"))
    return f.groupBy("difficulty", "arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 6).alias("mean_loss"), F.round(F.min(loss), 6).alias("least"), F.round(F.max(loss), 6).alias("most"))


def _elo_sql(key: str, carry: bool) -> str:
    """Elo by margin as a recursion over the k-th games of all keys: ratings before the game, then after it."""
    before = "case when s.season <> g.season then [1500 + 0.75 * (x - 1500) for x in s.after] else s.after end" if carry else "s.after"
    start = "[1500.0::double for x in range(30)]"
    venue = "case when g.neutral then 0.0 else 60.0 end" if carry else "60.0"
    frozen = "upcoming" if carry else "false"
    none, season = ("", "") if key == "season" else ("null::int season, ", "season, ")
    return f"""
stepped as (
  select {key}, 0::bigint k, null::bigint game_id, {none}null::double rh, null::double ra, null::double p, {start} after from (select distinct {key} from ordered)
  union all
  select {key}, k, game_id, {season}rh, ra, p,
         case when {frozen} then r else [case when i = home + 1 then x + shift when i = away + 1 then x - shift else x end for x, i in r] end
  from (select *, 20 * ln(abs(hs - as_) + 1) * 2.2 / (0.001 * (case when hs > as_ then edge else -edge end) + 2.2) * ((hs > as_)::int - p) shift from (
    select *, 1 / (1 + pow(10.0::double, -edge / 400.0)) p from (
      select *, rh + venue - ra edge from (select *, r[home + 1] rh, r[away + 1] ra from (
        select g.*, {venue} venue, {before} r from stepped s join ordered g on g.{key} = s.{key} and g.k = s.k + 1))))))"""


@query(
    "select season, game_id, round(rh, 6) home_rating, round(ra, 6) away_rating, round(p, 6) home_p from stepped where k > 0",
    "ordered as (select *, false neutral, false upcoming, row_number() over (partition by season order by game_date, game_id) k from games), " + _elo_sql("season", False),
)
def elo_margin_replay(spark, sf_dir):
    out = folds.margin_elo(views.games(spark, sf_dir))
    return out.select("season", "game_id", rounded("home_rating"), rounded("away_rating"), rounded("home_p"))


@query(
    "select league, season, game_id, round(rh, 6) home_rating, round(ra, 6) away_rating, round(p, 6) home_p from stepped where k > 0",
    "ordered as (select g.*, (o_custkey // 30 % 4)::int league, g.game_id % 19 = 0 neutral, g.game_id % 23 = 0 upcoming, row_number() over (partition by o_custkey // 30 % 4 order by season, game_date, game_id) k "
    "from games g join orders on o_orderkey = game_id), " + _elo_sql("league", True),
)
def elo_carry_replay(spark, sf_dir):
    """Elo that goes on from season to season, three quarters of the way from the mean; games on neutral ground have no home
    edge, upcoming ones read ratings and leave them as they are. Leagues don't meet, so each is a sequence of its own."""
    league = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), (F.floor(F.col("o_custkey") / 30) % 4).cast("int").alias("league"))
    g = views.games(spark, sf_dir).join(league, "game_id").withColumns({"neutral": F.col("game_id") % 19 == 0, "upcoming": F.col("game_id") % 23 == 0})
    out = folds.margin_elo(g, by="league", carry=0.75, neutral="neutral", upcoming="upcoming")
    return out.select("league", "season", "game_id", rounded("home_rating"), rounded("away_rating"), rounded("home_p"))


@query(
    "select season, g.game_id, round(ratings[g.team + 1], 6) team_rating, round(ratings[g.opp + 1], 6) opp_rating, round(1 / (1 + pow(10.0::double, -(ratings[g.team + 1] - ratings[g.opp + 1]) / 400.0)), 6) team_p "
    "from (select season, ratings, unnest(batch) g from stepped where k > 0)",
    """due as (select season, date_diff('day', date '1970-01-01', game_date)::bigint cutoff, game_id, home team, away opp, (hs > as_)::int::double won, date_diff('day', date '1970-01-01', game_date)::bigint + 1 + game_id % 3 resolved from games),
       batches as (select season, cutoff, row_number() over (partition by season order by cutoff) k, list({'game_id': game_id, 'team': team, 'opp': opp, 'won': won, 'resolved': resolved} order by game_id) batch from due group by season, cutoff),
       stepped as (
         select season, 0::bigint k, [1500.0::double for x in range(30)] ratings, [{'game_id': 0::bigint, 'team': 0, 'opp': 0, 'won': 0.0::double, 'resolved': 0::bigint}][:0] batch, [{'resolved': 0::bigint, 'team': 0, 'opp': 0, 'shift': 0.0::double}][:0] pending
         from (select distinct season from batches)
         union all
         select season, k, ratings, batch, list_concat(later, [{'resolved': g.resolved, 'team': g.team, 'opp': g.opp, 'shift': 20 * (g.won - 1 / (1 + pow(10.0::double, -(ratings[g.team + 1] - ratings[g.opp + 1]) / 400.0)))} for g in batch])
         from (select season, k, batch, later, [x + coalesce(list_sum([d.shift for d in now if d.team = i - 1]), 0) - coalesce(list_sum([d.shift for d in now if d.opp = i - 1]), 0) for x, i in ratings] ratings from (
           select b.season, b.k, b.batch, s.ratings, [d for d in s.pending if d.resolved <= b.cutoff] now, [d for d in s.pending if d.resolved > b.cutoff] later
           from stepped s join batches b on b.season = s.season and b.k = s.k + 1)))""",
)
def elo_batched_states(spark, sf_dir):
    """Elo whose results count a day after their game at the earliest, frozen by date."""
    g = views.games(spark, sf_dir)
    day = F.datediff("game_date", F.lit("1970-01-01").cast("date")).cast("long")
    out = folds.batched_elo(g.select("season", day.alias("cutoff"), (day + 1 + F.col("game_id") % 3).alias("resolved_at"), "game_id", F.col("home").alias("team"), F.col("away").alias("opp"), (F.col("hs") > F.col("as_")).alias("won")))
    return out.select("season", "game_id", rounded("team_rating"), rounded("opp_rating"), rounded("team_p"))


@query(
    "select player, game_id seq, round(estimate, 6) estimate, round(variance, 6) variance from stepped where k > 0",
    """ordered as (select player, game_id, plus_minus::double v, minutes::double w, row_number() over (partition by player order by game_date, game_id) k from lines join games using (game_id)),
       stepped as (
         select player, 0::bigint k, null::bigint game_id, null::double estimate, null::double variance, 0.0::double after, 25.0::double after_var from (select distinct player from ordered)
         union all
         select o.player, o.k, o.game_id, s.after, s.after_var + 1.5, case when o.w > 0 then s.after + (s.after_var + 1.5) / (s.after_var + 1.5 + 400.0 / o.w) * (o.v - s.after) else s.after end,
                case when o.w > 0 then (1 - (s.after_var + 1.5) / (s.after_var + 1.5 + 400.0 / o.w)) * (s.after_var + 1.5) else s.after_var + 1.5 end
         from stepped s join ordered o on o.player = s.player and o.k = s.k + 1)""",
)
def player_kalman(spark, sf_dir):
    ln = views.lines(spark, sf_dir).join(views.games(spark, sf_dir).select("game_id", "game_date"), "game_id")
    day = F.datediff("game_date", F.lit("1970-01-01").cast("date")).cast("long")
    out = folds.scalar_kalman(ln.select("player", day.alias("day"), F.col("game_id").alias("seq"), F.col("plus_minus").cast("double").alias("value"), F.col("minutes").cast("double").alias("weight")))
    return out.select("player", "seq", rounded("estimate"), rounded("variance"))


@query(
    "select i team, round(r - avg(r) over (), 6) rating, round(h, 6) home_advantage from solved where k = 200",
    """met as (select home i, away j, count(*)::double w, sum(hs - as_)::double v from games group by 1, 2),
       cells as (select i, j, sum(w) w from (select i, j, w from met union all select j, i, w from met) group by 1, 2),
       sides as (select i, sum(w) n, sum(v) b, sum(s) lean from (select i, w, v, w s from met union all select j, w, -v, -w from met) group by 1),
       league as (select sum(w) n, sum(v) v from met),
       solved as (
         select 0 k, i, 0.0::double r, 0.0::double h from sides
         union all
         select k, i, r - avg(r) over (), h from (
         select p.k + 1 k, s.i, (s.b - s.lean * any_value(p.h) + sum(coalesce(c.w, 0) * p.r)) / (s.n + 1) r, (any_value(l.v) - sum(q.lean * p.r)) / any_value(l.n) h
         from solved p join sides q on q.i = p.i cross join sides s cross join league l left join cells c on c.i = s.i and c.j = p.i where p.k < 200 group by p.k, s.i, s.b, s.lean, s.n))""",
)
def ridge_team_ratings(spark, sf_dir):
    g = views.games(spark, sf_dir).select("home", "away", (F.col("hs") - F.col("as_")).cast("double").alias("margin"), F.lit(1.0).alias("w"))
    return fits.ridge_ratings(g, "home", "away", "margin", "w").select("team", rounded("rating"), rounded("home_advantage"))



@query(
    "select target season, i team, round(r - avg(r) over (partition by target), 6) rating, round(h, 6) home_advantage from solved where k = 200",
    """targets as (select distinct season target from games where season - 3 >= (select min(season) from games)),
       met as (select target, home i, away j, count(*)::double w, sum(hs - as_)::double v from games join targets on season between target - 3 and target - 1 group by 1, 2, 3),
       cells as (select target, i, j, sum(w) w from (select target, i, j, w from met union all select target, j, i, w from met) group by 1, 2, 3),
       sides as (select target, i, sum(w) n, sum(v) b, sum(s) lean from (select target, i, w, v, w s from met union all select target, j, w, -v, -w from met) group by 1, 2),
       league as (select target, sum(w) n, sum(v) v from met group by 1),
       solved as (
         select 0 k, target, i, 0.0::double r, 0.0::double h from sides
         union all
         select k, target, i, r - avg(r) over (partition by target), h from (
         select p.k + 1 k, s.target, s.i, (s.b - s.lean * any_value(p.h) + sum(coalesce(c.w, 0) * p.r)) / (s.n + 1) r, (any_value(l.v) - sum(q.lean * p.r)) / any_value(l.n) h
         from solved p join sides q on q.target = p.target and q.i = p.i join sides s on s.target = p.target join league l on l.target = p.target
           left join cells c on c.target = s.target and c.i = s.i and c.j = p.i where p.k < 200 group by p.k, s.target, s.i, s.b, s.lean, s.n))""",
)
def causal_ratings(spark, sf_dir):
    """Ridge ratings of each season from the three seasons before it."""
    g = views.games(spark, sf_dir).select("season", "home", "away", (F.col("hs") - F.col("as_")).cast("double").alias("margin"), F.lit(1.0).alias("w"))
    return fits.causal_ridge_ratings(g, "season", "home", "away", "margin", "w").select("season", "team", rounded("rating"), rounded("home_advantage"))
