"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorline.functions import geo, probability, text
from priorline.functions.calendar import utc_offset_hours
from priorline.operators import asof, fits, folds, joins, ledger, rolling, scoring
from priorline.plans import views
from priorline.plans.checks import CHECKS
from priorline.plans.evidence import EVIDENCE
from priorline.plans.history import HISTORY
from priorline.plans.learning import LEARNING
from priorline.plans.lineups import LINEUPS
from priorline.plans.models import MODELS
from priorline.plans.records import RECORDS
from priorline.plans.shapes import SHAPES
from priorline.plans.season_pass import SEASON_PASS
from priorline.plans.stores import STORES
from priorline.plans.oracle import ORACLE_SQL as ORACLE_SQL
from priorline.streaming import capture, pending

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FLAGSHIP = "season_scores"
DIGITS = scoring.DIGITS
HEALTH_TERMS = ("the", "est", "die", "por", "injury", "ankle")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(name: str) -> Column:
    return F.round(F.col(name), DIGITS).alias(name)


# Scalar functions and scores.


@query
def elo_venue_probability(spark, sf_dir):
    return views.forecasts(spark, sf_dir).select("game_id", rounded("base_p"), rounded("p"))


@query
def season_scores(spark, sf_dir):
    """Forecast scores by season and over all seasons (season null)."""
    return scoring.score_summary(views.forecasts(spark, sf_dir), ["season"])


@query
def reliability_bins(spark, sf_dir):
    return scoring.reliability_bins(views.forecasts(spark, sf_dir)).select("bin", "n", rounded("mean_p"), rounded("rate"))


@query
def calibration_error(spark, sf_dir):
    return scoring.expected_calibration_error(scoring.reliability_bins(views.forecasts(spark, sf_dir))).select(rounded("ece"))


def _relative(rows: DataFrame) -> DataFrame:
    return rows.withColumn("gain", probability.log_loss(F.col("base_p"), F.col("won")) - probability.log_loss(F.col("p"), F.col("won")))


@query
def calendar_blocks(spark, sf_dir):
    blocks = scoring.calendar_blocks(_relative(views.forecasts(spark, sf_dir)), F.col("gain"), "season", "game_date")
    return blocks.select("season", "week", rounded("total"), "n")


@query
def paired_delta(spark, sf_dir):
    found = scoring.paired_delta(views.forecasts(spark, sf_dir), probability.brier(F.col("base_p"), F.col("won")) - probability.brier(F.col("p"), F.col("won")), ["season"])
    return found.select("season", "n", rounded("mean"), rounded("low"), rounded("high"))


@query
def difficulty_buckets(spark, sf_dir):
    top = F.greatest("p", 1 - F.col("p"))
    return views.forecasts(spark, sf_dir).groupBy(F.when(top < 0.6, "hard").when(top < 0.75, "medium").otherwise("easy").alias("difficulty")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(probability.brier(F.col("p"), F.col("won"))), DIGITS).alias("brier"))


@query
def perspective_sample(spark, sf_dir):
    """One of each game's two rows, by the parity of a hash of the game."""
    copy = F.conv(F.substring(F.sha2(F.col("game_id").cast("string"), 256), 1, 2), 16, 10).cast("int") % 2
    return views.team_games(spark, sf_dir).where(F.col("is_away") == copy).select("game_id", "team", "opp", "is_away")


@query
def anonymous_ids(spark, sf_dir):
    return views.games(spark, sf_dir).select("game_id", F.concat(F.lit("g-"), F.substring(F.sha2(F.concat(F.lit("v1:"), F.col("game_id").cast("string")), 256), 1, 16)).alias("question_id"))


@query
def side_swap_union(spark, sf_dir):
    """Rows and their mirror images: the outcome flips, p becomes 1 - p, the margin its negative."""
    f = views.forecasts(spark, sf_dir).select("game_id", F.lit(False).alias("swapped"), "p", "won", (F.col("hs") - F.col("as_")).alias("margin"))
    swapped = f.select("game_id", F.lit(True).alias("swapped"), (1 - F.col("p")).alias("p"), (~F.col("won")).alias("won"), (-F.col("margin")).alias("margin"))
    return f.unionByName(swapped).groupBy("swapped").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 3).alias("p"), F.count_if("won").alias("won"), F.sum("margin").alias("margin"))


@query
def moneyline_devig(spark, sf_dir):
    """Odds of both sides to probabilities without the margin."""
    line = lambda k: F.when(F.col("game_id") % 2 == k, -(105 + F.col("game_id") % 200)).otherwise(100 + F.col("game_id") % 150).cast("double")
    g = views.games(spark, sf_dir).select("game_id", probability.implied_probability(line(0)).alias("h"), probability.implied_probability(line(1)).alias("a"))
    return g.select("game_id", F.round(F.col("h") / (F.col("h") + F.col("a")), DIGITS).alias("home_p"), F.round(F.col("h") + F.col("a") - 1, DIGITS).alias("margin"))


@query
def bayes_update(spark, sf_dir):
    """A prior over home and away, updated by the log likelihoods of the score difference."""
    f = views.forecasts(spark, sf_dir)
    edge = (F.col("hs") - F.col("as_")).cast("double") / 20.0
    post = probability.bayes_update(F.array("base_p", 1 - F.col("base_p")), F.array(edge, -edge))
    return f.select("game_id", F.round(post[0], DIGITS).alias("home_p"), probability.argmax_label(F.array(F.lit("home"), F.lit("away")), post).alias("predicted"))


@query
def rms_scales(spark, sf_dir):
    t = views.games(spark, sf_dir).select((F.col("hs") - F.col("as_")).cast("double").alias("margin"), (F.col("home") - F.col("away")).cast("double").alias("gap"), F.lit(0.0).alias("none"))
    return fits.rms_scales(t, ["margin", "gap", "none"]).select(rounded("margin"), rounded("gap"), "none")


@query
def feature_pivot(spark, sf_dir):
    """(game, side, feature, value) records to one vector of differences a game."""
    t = views.team_games(spark, sf_dir).select("game_id", "is_away", F.explode(F.create_map(F.lit("pf"), F.col("pf"), F.lit("pa"), F.col("pa"))).alias("feature", "value"))
    return t.groupBy("game_id").pivot("feature", ["pa", "pf"]).agg(F.sum(F.when(F.col("is_away") == 0, F.col("value")).otherwise(-F.col("value"))))


# As-of joins.


@query
def asof_report(spark, sf_dir):
    """The team's last report an hour before tipoff, or earlier."""
    t = views.tips(spark, sf_dir).withColumn("cutoff", F.col("tipoff") - F.expr("interval 60 minutes"))
    found = asof.asof_join(t, views.reports(spark, sf_dir), by=["team"], left_time="cutoff", right_time="report_time", take=["event_id", "status"], tie=["event_id"])
    return found.select("tip_id", "team", "event_id", "status")


@query
def asof_containing(spark, sf_dir):
    """The last report before the cutoff that lists the player."""
    t = views.tips(spark, sf_dir).withColumn("cutoff", F.col("tipoff") - F.expr("interval 60 minutes"))
    found = asof.asof_join(t, views.reports(spark, sf_dir), by=["team", "player"], left_time="cutoff", right_time="report_time", take=["event_id", "status"], tie=["event_id"])
    return found.select("tip_id", "player", "event_id", "status")


@query
def asof_horizons(spark, sf_dir):
    """Four horizons before each tipoff, and how many have a report of the player in the week before."""
    hours = F.explode(F.array(*[F.lit(m) for m in (360, 120, 60, 15)])).alias("horizon")
    t = views.tips(spark, sf_dir).select("*", hours).withColumn("cutoff", F.timestamp_micros(F.unix_micros("tipoff") - F.col("horizon").cast("long") * 60_000_000))
    found = asof.asof_join(t, views.reports(spark, sf_dir), by=["player"], left_time="cutoff", right_time="report_time", take=["event_id"], tie=["event_id"])
    fresh = F.unix_micros("report_time") >= F.unix_micros("cutoff") - 7 * 86_400_000_000
    return found.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.count_if(fresh).alias("fresh"), F.count_if(F.col("event_id").isNull()).alias("missing"), F.sum("event_id").alias("ids"))


@query
def asof_ambiguous(spark, sf_dir):
    """Each player's latest report by the hour, where it is one alone."""
    r = views.reports(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "report_time")).withColumn("day", F.to_date("report_time"))
    found = asof.latest_unambiguous(r, by=["team", "day"], clocks=["hour"], pick=F.col("event_id"))
    return found.select("team", "day", "n_latest", "picked")


@query
def revision_deltas(spark, sf_dir):
    """Changes between a player's consecutive reports: up, down, minutes since the last."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("Available", "Probable", "Questionable", "Doubtful", "Out")]), F.col("status")).cast("int")
    w = Window.partitionBy("player").orderBy("report_time", "event_id")
    r = views.reports(spark, sf_dir).withColumn("rank", rank)
    r = r.withColumns({"step": F.col("rank") - F.lag("rank").over(w), "gap": (F.unix_micros("report_time") - F.unix_micros(F.lag("report_time").over(w))) / 60e6})
    return r.groupBy("player").agg(F.sum(F.greatest("step", F.lit(0))).alias("down"), F.sum(F.greatest(-F.col("step"), F.lit(0))).alias("up"), F.count_if(F.col("step") != 0).alias("changes"), F.round(F.max("gap"), 3).alias("longest_gap"))


@query
def final_snapshot_schedule(spark, sf_dir):
    """The last report of each team and day."""
    w = Window.partitionBy("team", F.to_date("report_time")).orderBy(F.col("report_time").desc(), F.col("event_id").desc())
    return views.reports(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("team", F.to_date("report_time").alias("day"), "event_id", "player")


@query
def status_rates(spark, sf_dir):
    """Share of listed players, by status, who have a later report within two days."""
    w = Window.partitionBy("player").orderBy("report_time", "event_id")
    r = views.reports(spark, sf_dir).withColumn("next", F.lead("report_time").over(w))
    soon = F.coalesce(F.unix_micros("next") - F.unix_micros("report_time") <= 2 * 86_400_000_000, F.lit(False))
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(soon.cast("double")), DIGITS).alias("rate"))


@query
def late_captures(spark, sf_dir):
    """Reports by how late they are known: late ones are kept, and not eligible at the cutoff."""
    lag = F.col("event_id") * 37 % 180
    r = views.reports(spark, sf_dir).withColumn("eligible", lag <= 60)
    return r.groupBy("team", "eligible").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("minutes"), 3).alias("minutes"))


# Joins, sets and constraints.


@query
def positional_join(spark, sf_dir):
    """The k-th game of a matchup with its k-th scheduled day, where both have as many."""
    g = views.games(spark, sf_dir)
    schedule = g.where("game_id % 23 <> 0").select("home", "away", F.col("game_date").alias("day"))
    found, _ = joins.positional_join(g.select("home", "away", "game_id"), schedule, ["home", "away"], ["game_id"], ["day"])
    return found.select("game_id", "home", "away", "day")


@query
def join_notes(spark, sf_dir):
    g = views.games(spark, sf_dir)
    schedule = g.where("game_id % 23 <> 0").select("home", "away", F.col("game_date").alias("day"))
    return joins.positional_join(g.select("home", "away", "game_id"), schedule, ["home", "away"], ["game_id"], ["day"])[1]


@query
def coverage_failures(spark, sf_dir):
    f = views.forecasts(spark, sf_dir)
    found, _ = joins.cover(f.select("game_id", "season", "won", "base_p"), f.where("game_id % 17 <> 0").select("game_id", "p"), "game_id", "p")
    scored = F.coalesce(probability.log_loss(F.col("p"), F.col("won")), -F.ln(F.lit(probability.FLOOR)))
    return found.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count("failure").alias("failures"), F.round(F.avg(scored), DIGITS).alias("log_loss"))


@query
def lagged_season_value(spark, sf_dir):
    """Each game with both teams' weighted values of the season before, where both are known."""
    t = views.team_games(spark, sf_dir).groupBy("season", "team").agg((F.sum(F.col("pf").cast("double") * F.col("pa")) / F.sum("pa")).alias("value"))
    g = views.games(spark, sf_dir).withColumn("before", F.col("season") - 1)
    # One row a team and season: broadcast, as the league bounds it.
    side = lambda name: F.broadcast(t.select(F.col("season").alias("before"), F.col("team").alias(name), F.col("value").alias(f"{name}_value")))
    both = g.join(side("home"), ["before", "home"]).join(side("away"), ["before", "away"])
    return both.select("game_id", F.round(F.col("home_value") - F.col("away_value"), DIGITS).alias("difference"))


@query
def priority_lookup(spark, sf_dir):
    """A customer's region by nation, or else by a key of the region."""
    c = views.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("n_nationkey"), (F.col("c_custkey") % 7).cast("int").alias("r_regionkey"))
    n = F.broadcast(views.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("place")))
    r = F.broadcast(views.table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("place")))
    found = joins.priority_lookup(c, [(n, ["n_nationkey"]), (r, ["r_regionkey"])], "place")
    return found.select("c_custkey", F.coalesce("place", F.lit("none")).alias("place"))


@query
def season_division(spark, sf_dir):
    """Which seasons have all teams."""
    t = views.team_games(spark, sf_dir)
    found = joins.divides(t.select("season", "team"), "season", "team", t.where("season = 1997").select("team"))
    return found.select("season", "n_found", "n_required", "complete")


@query
def duplicate_lines(spark, sf_dir):
    return joins.duplicate_keys(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def orbit_first(spark, sf_dir):
    """The first game of each unordered matchup."""
    found = joins.first_of_orbit(views.games(spark, sf_dir), "home", "away", ["game_date", "game_id"])
    return found.select(F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"), "game_id", "game_date")


@query
def unordered_pairs(spark, sf_dir):
    pairs = views.games(spark, sf_dir).select("game_date", F.array_sort(F.array("home", "away")).alias("pair"))
    return joins.duplicate_keys(pairs, ["game_date", "pair"]).select("game_date", F.col("pair")[0].alias("a"), F.col("pair")[1].alias("b"), "n")


@query
def calibration_precedes(spark, sf_dir):
    """Rows of later seasons whose matchup has been in no earlier one: an anti-join on the unordered pair."""
    g = views.games(spark, sf_dir).select("game_id", "season", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"), (F.col("hs") - F.col("as_")).alias("margin"))
    return g.where("season >= 2000").join(g.where("season < 2000 and margin > 40"), ["a", "b"], "left_anti").select("game_id", "season", "a", "b")


@query
def season_boundaries(spark, sf_dir):
    """Per season first and last day, and whether it starts after the one before ends."""
    s = views.games(spark, sf_dir).groupBy("season").agg(F.min("game_date").alias("first"), F.max("game_date").alias("last"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("clean", F.coalesce(F.col("first") > F.lag("last").over(Window.orderBy("season")), F.lit(True)))


@query
def event_properties(spark, sf_dir):
    """Nested JSON to columns."""
    k = F.from_json("props", "k long")["k"]
    return views.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


@query
def probability_domain(spark, sf_dir):
    """Rows that break a declared range, by rule."""
    f = views.forecasts(spark, sf_dir)
    rules = {"p_low": F.col("p") < 0.2, "p_high": F.col("p") > 0.8, "same_team": F.col("home") == F.col("away"), "tie": F.col("hs") == F.col("as_")}
    return f.select(F.explode(F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]), lambda x: x.isNotNull())).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# Windows over strictly earlier rows.


@query
def rolling_load(spark, sf_dir):
    t = rolling.load_features(views.team_games(spark, sf_dir), by=["season", "team"], day="game_date", away="is_away")
    return t.select("game_id", "team", "rest_days", "back_to_back", "games_7d", "road_7d")


@query
def rolling_form(spark, sf_dir):
    t = views.team_games(spark, sf_dir).withColumns({"won": F.when(F.col("pf") > F.col("pa"), 1).otherwise(0), "margin": F.col("pf") - F.col("pa")})
    # Daily groups hold all games of a team's day; frames end the day before.
    daily = rolling.form_features(t, by=["season", "team"], day="game_date", order="game_id", won="won", margin="margin")
    return daily.select("game_id", "team", "n_last", rounded("win_rate"), rounded("mean_margin"))


@query
def travel_miles(spark, sf_dir):
    """Miles from a team's last arena to the next, in order of day and game; arenas by key."""
    t = views.team_games(spark, sf_dir).withColumn("arena", F.when(F.col("is_away") == 0, F.col("team")).otherwise(F.col("opp")))
    place = lambda c: ((25 + c % 6 * 4).cast("double"), (-120 + c % 10 * 5).cast("double"))
    w = Window.partitionBy("season", "team").orderBy("game_date", "game_id")
    t = t.withColumn("before", F.lag("arena").over(w))
    miles = geo.great_circle_miles(*place(F.col("before")), *place(F.col("arena")))
    return t.groupBy("season", "team").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce(miles, F.lit(0.0))), 2).alias("miles"))


@query
def net_rating(spark, sf_dir):
    """Points over the last ten games of earlier dates, per hundred scored by both."""
    t = views.team_games(spark, sf_dir)
    ten = rolling.last_rows(["season", "team"], "game_date", "game_id")
    rate = F.sum(F.col("pf") - F.col("pa")).over(ten) * 100.0 / F.sum(F.col("pf") + F.col("pa")).over(ten)
    net = rolling.of_day(t.withColumn("net", rate), "net", ["season", "team"], "game_date", "game_id")
    return net.select("game_id", "team", F.round(F.coalesce("net", F.lit(0.0)), DIGITS).alias("net"))


@query
def lineup_continuity(spark, sf_dir):
    """How many players the two games before a date share, by home team: nothing of the game itself is known."""
    li = views.lines(spark, sf_dir).groupBy("game_id").agg(F.array_sort(F.collect_set("player")).alias("players"))
    g = views.games(spark, sf_dir).select("game_id", "home", "game_date", "season").join(li, "game_id")
    w = Window.partitionBy("season", "home").orderBy("game_date", "game_id")
    both = F.size(F.array_intersect(F.lag("players", 1).over(w), F.lag("players", 2).over(w))).cast("long")
    shared = g.withColumns({"shared": both, "last": F.size(F.lag("players", 1).over(w)).cast("long")})
    for name in ("shared", "last"):
        shared = rolling.of_day(shared, name, ["season", "home"], "game_date", "game_id")
    return shared.select("game_id", *[F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long").alias(c) for c in ("shared", "last")])


@query
def player_rolling(spark, sf_dir):
    """A player's minutes-weighted plus-minus over the last ten games of earlier dates."""
    ln = views.lines(spark, sf_dir).join(views.games(spark, sf_dir).select("game_id", "game_date"), "game_id")
    ten = rolling.last_rows(["player"], "game_date", "game_id")
    ln = ln.withColumn("value", F.sum("plus_minus").over(ten) * 100.0 / F.sum("minutes").over(ten))
    found = rolling.of_day(ln, "value", ["player"], "game_date", "game_id")
    return found.select("game_id", "player", F.round(F.coalesce("value", F.lit(0.0)), DIGITS).alias("value"))


@query
def expected_minutes(spark, sf_dir):
    """Median minutes of a player's last ten games."""
    ln = views.lines(spark, sf_dir).join(views.games(spark, sf_dir).select("game_id", "game_date"), "game_id")
    w = Window.partitionBy("player").orderBy(F.col("game_date").desc(), F.col("game_id").desc())
    return ln.withColumn("k", F.row_number().over(w)).where("k <= 10").groupBy("player").agg(F.count(F.lit(1)).alias("n"), F.median("minutes").alias("minutes"))


@query
def snapshot_coverage(spark, sf_dir):
    """A grid of days and six slots with the share that has a report."""
    r = views.reports(spark, sf_dir).select(F.to_date("report_time").alias("day"), F.floor(F.hour("report_time") / 4).cast("int").alias("slot"), "team")
    have = r.distinct().groupBy("day", "slot").agg(F.count(F.lit(1)).alias("teams"))
    grid = r.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("slot"))
    return grid.join(have, ["day", "slot"], "left").groupBy("day").agg(F.count("teams").alias("slots"), F.coalesce(F.sum("teams"), F.lit(0)).alias("teams"))


@query
def zone_offsets(spark, sf_dir):
    """Hours between UTC and two zones at each report's moment, by day."""
    r = views.reports(spark, sf_dir).select(F.to_date("report_time").alias("day"), utc_offset_hours(F.col("report_time"), F.lit("America/New_York")).alias("east"), utc_offset_hours(F.col("report_time"), F.lit("America/Los_Angeles")).alias("west"))
    return r.groupBy("day").agg(F.min("east").alias("east"), F.max("west").alias("west"), F.max(F.col("east") - F.col("west")).alias("change"))


# Text.


@query
def health_terms(spark, sf_dir):
    d = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.flagged_terms(F.coalesce("text", F.lit("")), HEALTH_TERMS).alias("terms"))
    return d.select("conv_id", "turn", F.array_join("terms", ",").alias("terms"), F.size("terms").cast("long").alias("n"))


@query
def stated_probability(spark, sf_dir):
    """Answers rendered with a probability, and parsed again from what follows the thinking."""
    f = views.forecasts(spark, sf_dir)
    said = F.concat(F.lit("probability: 0.9 is too much</think> My Probability: "), F.format_string("%.4f", "p"))
    return f.select("game_id", text.stated_probability(said).alias("stated"))


@query
def prompt_text(spark, sf_dir):
    """Fixed-format prompts and a digest of each."""
    f = views.forecasts(spark, sf_dir)
    prompt = F.format_string("Team %02d at team %02d, margin %+d, prior %.4f", "away", "home", F.col("hs") - F.col("as_"), "base_p")
    return f.select("game_id", F.sha2(prompt, 256).alias("digest"))


# Arrays of arms.


@query
def arm_mixture(spark, sf_dir):
    """Softmax weights over the values of a vector: the least and largest weight by label."""
    e = views.table(spark, sf_dir, "embeddings").select("label", probability.softmax(F.transform("embedding", lambda x: x.cast("double") * 10)).alias("w"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.array_max("w")), 5).alias("top"), F.round(F.avg(F.array_min("w")), 5).alias("least"))


# Folds, fits, chains.


@query
def block_digests(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return ledger.block_digests(e, "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props"))


# Streams over what is there.


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = views.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


@query
def stream_running_totals(spark, sf_dir):
    """Running totals from keyed state; the last row of each user."""
    out = pending.run_available(pending.running_totals(_event_stream(spark, sf_dir)), "running", "update")
    last = out.groupBy("user_id").agg(F.max("n_events").alias("n_events"), F.max("last_event").alias("last_event"), F.round(F.max_by("total_value", "n_events"), 3).alias("total_value"))
    return last


@query
def stream_window_counts(spark, sf_dir):
    """Hourly counts in append mode: of windows that ended two hours before the last event or earlier."""
    out = pending.run_available(pending.windowed_counts(_event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))), "windows", "append")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query
def stream_due_captures(spark, sf_dir):
    """Every event polls its user's evening start; the first poll within half an hour of each timer captures, as polls are sparse here."""
    s = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    polls = s.select(F.col("user_id").alias("key"), F.col("event_id").alias("poll_id"), F.unix_micros("ts").alias("polled"), (F.unix_micros(F.date_trunc("day", "ts")) + 20 * 3_600_000_000).alias("starts"))
    out = pending.run_available(capture.due_captures(polls, 30), "captures", "append")
    return out.select("key", "timer", "poll_id", F.timestamp_micros("starts").cast("date").alias("day"))


# Audits, journals and reports.


@query
def venue_balance(spark, sf_dir):
    """Home and away wins by season, and whether the rarer has 45% at least."""
    g = views.games(spark, sf_dir).groupBy("season").agg(F.count_if(F.col("hs") > F.col("as_")).alias("home_wins"), F.count_if(F.col("hs") < F.col("as_")).alias("away_wins"))
    return g.withColumn("balanced", F.least("home_wins", "away_wins") >= 0.45 * (F.col("home_wins") + F.col("away_wins")))


@query
def centred_rewards(spark, sf_dir):
    """Values less their user's mean, by type."""
    means = views.table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean"))
    e = views.table(spark, sf_dir, "events").join(means, "user_id").withColumn("x", F.col("value") - F.col("mean"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.var_pop("x"), 4).alias("variance"))


@query
def canary_slice(spark, sf_dir):
    """The second 64 questions by their anonymous ids, each in both orientations."""
    q = anonymous_ids(spark, sf_dir).orderBy("question_id").offset(64).limit(64)
    return q.select("question_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("swapped"))


@query
def journal_replay(spark, sf_dir):
    """A view opens an attempt; a purchase as the user's next event completes it, anything else ends it as a failure."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = views.table(spark, sf_dir, "events").withColumn("next", F.lead("event_type").over(w)).where("event_type = 'view'")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("started"), F.count_if(F.col("next") == "purchase").alias("completed"), F.count_if(F.col("next").isNull()).alias("torn"))


@query
def artifact_contract(spark, sf_dir):
    """Rows, distinct ids and a digest of the ids of each season."""
    part = F.conv(F.substring(F.sha2(F.col("game_id").cast("string"), 256), 1, 8), 16, 10).cast("long")
    return views.games(spark, sf_dir).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("game_id").alias("ids"), F.min("game_id").alias("first"), F.max("game_id").alias("last"), F.sum(part).alias("digest"))


@query
def tips_in_week(spark, sf_dir):
    """A team's tipoffs in the seven days before each, to the microsecond."""
    week = rolling.count_between(["team"], F.unix_micros("tipoff"), -7 * 86_400_000_000, -1)
    return views.tips(spark, sf_dir).select("tip_id", "team", week.alias("n"))


@query
def upsert_by_day(spark, sf_dir):
    """One row for each team and day: of several the one reported last."""
    order = F.struct("report_time", "event_id")
    r = views.reports(spark, sf_dir).groupBy("team", F.to_date("report_time").alias("as_of"))
    return r.agg(F.max_by("event_id", order).alias("event_id"), F.max_by("minutes", order).alias("minutes"), F.count(F.lit(1)).alias("versions"))


@query
def due_work(spark, sf_dir):
    """The twenty tipoffs due first after the middle of the month, by cutoff: a top-k report."""
    t = views.tips(spark, sf_dir).where(F.col("tipoff") >= F.lit("2024-01-15").cast("timestamp"))
    return t.orderBy("tipoff", "tip_id").limit(20).select("tip_id", "team")


#: Names that these queries had while the plain ones took a part of their rows.
WHOLE = ("asof_report", "asof_containing", "asof_horizons", "tips_in_week", "due_work", "prompt_text", "arm_mixture")
QUERIES |= {f"{name}_whole": QUERIES[name] for name in WHOLE}
ORACLE_SQL |= {f"{name}_whole": ORACLE_SQL[name] for name in WHOLE}
for part in (HISTORY, CHECKS, EVIDENCE, LEARNING, LINEUPS, MODELS, RECORDS, SEASON_PASS, SHAPES, STORES):
    QUERIES |= part.queries
    ORACLE_SQL |= part.sql
