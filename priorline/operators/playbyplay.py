"""Play-by-play events to team totals, player lines and constant-lineup stints.

Events: game_id, num, kind (1 made, 2 missed, 3 free throw, 4 rebound, 5 turnover, 6 foul, 8 substitution), period,
clock (M:SS left), home_text, away_text, score ('away - home'), and three (player, team) pairs p1, t1 .. p3, t3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.functions.calendar import clock_seconds
from priorline.operators.folds import ordered_fold
from priorline.session import materialize

REGULAR, OVERTIME, ON_COURT, SLACK = 720, 300, 5, 5
STINTS = (
    "game_id long, reason string, kind string, stint int, team string, players array<long>, opponents array<long>, player long, "
    "seconds int, points int, against int, plus_minus int, possessions double"
)


def team_totals(events: DataFrame) -> DataFrame:
    """Field goals, free throws, turnovers and offensive rebounds (by the side that missed last) of each game
    and team, and possessions: by windows, with no Python."""
    text = F.concat_ws(" ", "home_text", "away_text")
    missed = (F.col("kind") == 2) | ((F.col("kind") == 3) & text.contains("MISS"))
    # A make or a rebound ends a miss: it leaves an empty mark that the next rebound finds.
    mark = F.when(missed, F.col("t1")).when(F.col("kind").isin(1, 4), F.lit(""))
    before = Window.partitionBy("game_id").orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("_open", F.last(mark, ignorenulls=True).over(before))
    own = (F.col("kind") == 4) & (F.col("_open") == F.col("t1")) & (F.col("t1") != "")
    totals = seen.where("t1 <> ''").groupBy("game_id", F.col("t1").alias("team")).agg(
        F.count_if(F.col("kind").isin(1, 2)).alias("fga"), F.count_if(F.col("kind") == 3).alias("fta"), F.count_if(own).alias("oreb"), F.count_if(F.col("kind") == 5).alias("tov")
    )
    return totals.withColumn("possessions", F.col("fga") + 0.44 * F.col("fta") - F.col("oreb") + F.col("tov"))


def sides(events: DataFrame) -> DataFrame:
    """Each game's home and away team: the team that acts in most events with a text of that side, the earlier of equals."""
    found = []
    for side in ("home", "away"):
        votes = events.where((F.col("t1") != "") & (F.trim(F.coalesce(f"{side}_text", F.lit(""))) != "")).groupBy("game_id", "t1")
        counted = votes.agg(F.count(F.lit(1)).alias("n"), F.min("num").alias("first"))
        found.append(counted.groupBy("game_id").agg(F.max_by("t1", F.struct("n", -F.col("first"))).alias(side)))
    return found[0].join(found[1], "game_id")


def period_starters(events: DataFrame) -> DataFrame:
    """Per game, period and team: ``likely``, the players who may have begun it, the likeliest first, ``came``, those
    whom a substitution brought in first, and ``acts``, how often each player acts."""
    pairs = F.explode(F.array(*[F.struct(F.col(f"p{k}").alias("player"), F.col(f"t{k}").alias("team")) for k in (1, 2, 3)])).alias("x")
    acts = events.select("game_id", "period", pairs).select("game_id", "period", "x.*").where("player <> 0 and team <> ''").groupBy("game_id", "period", "team", "player").agg(F.count(F.lit(1)).alias("n"))
    ways = F.explode(F.array(F.struct(F.col("p1").alias("player"), F.lit("out").alias("way")), F.struct(F.col("p2").alias("player"), F.lit("in").alias("way")))).alias("x")
    marks = events.where("kind = 8").select("game_id", "period", "num", ways).select("game_id", "period", "num", "x.*").groupBy("game_id", "period", "player").agg(F.min_by("way", "num").alias("way"))
    rank = F.struct((F.coalesce("way", F.lit("")) != "out").alias("stays"), "n", "player")
    joined = acts.join(marks, ["game_id", "period", "player"], "left").withColumn("came", F.coalesce(F.col("way") == "in", F.lit(False)))
    per = joined.groupBy("game_id", "period", "team").agg(
        F.sort_array(F.collect_list(F.when(~F.col("came"), rank)), asc=False).alias("likely"),
        F.collect_list(F.when(F.col("came"), F.col("player"))).alias("came"),
        F.map_from_entries(F.collect_list(F.struct("player", F.col("n").cast("long")))).alias("acts"),
    )
    return per.withColumn("likely", F.transform("likely", lambda x: x["player"]))


def lineups(events: DataFrame) -> DataFrame:
    """(game_id, team, period, num, players): a team's five from the event ``num`` on, -1 for the start of a period. What is
    folded is one row for each period and substitution; all else is derived from these rows by windows and joins."""
    none = {"likely": "array<long>", "came": "array<long>", "acts": "map<long,long>"}
    subs = events.where("kind = 8").select("game_id", F.col("t1").alias("team"), "period", "num", F.col("p1").alias("leaves"), F.col("p2").alias("enters"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    starts = period_starters(events).select("game_id", "team", "period", F.lit(-1).cast("long").alias("num"), F.lit(None).cast("long").alias("leaves"), F.lit(None).cast("long").alias("enters"), *none)

    def step(five: dict, row: tuple) -> tuple:
        game, team, period, num, leaves, enters, likely, came, acts = row
        now = five.get("now", [])
        if num < 0:
            five["acts"] = dict(acts)
            new = set(likely[:ON_COURT])
            new |= set([p for p in now if p not in new and p not in came][: ON_COURT - len(new)])
        else:
            unseen = leaves not in now and len(now) >= ON_COURT
            quietest = min(now, key=lambda p: (five["acts"].get(p, 0), p)) if unseen else leaves
            new = {p for p in now if p != quietest} | {enters}
        five["now"] = sorted(new)
        return game, team, period, num, five["now"]

    return ordered_fold(starts.unionByName(subs), by=["game_id", "team"], order=["period", "num"], start=dict, step=step, schema="game_id long, team string, period int, num long, players array<long>")


def spells(events: DataFrame, named: DataFrame) -> DataFrame:
    """Constant lineups in order: game_id, period, num, seconds, both fives, and what each side scored and used meanwhile."""
    left = F.when(F.col("period") <= 4, REGULAR).otherwise(OVERTIME)
    at = events.where("kind = 8").select("game_id", "num", clock_seconds(F.trim("clock")).alias("left"))
    changes = lineups(events).join(named, "game_id").join(at, ["game_id", "num"], "left").withColumn("left", F.coalesce("left", left))
    ordered = Window.partitionBy("game_id", "period").orderBy("num", "team")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    five = lambda side: F.last(F.when(F.col("team") == F.col(side), F.col("players")), ignorenulls=True).over(so_far).alias(f"{side}_five")
    both = changes.select("*", five("home"), five("away"), (F.lead("num").over(ordered) == F.col("num")).alias("half"))
    both = both.where("not coalesce(half, false)").withColumn("seconds", F.col("left") - F.coalesce(F.lead("left").over(ordered), F.lit(0)))
    text = F.concat_ws(" ", "home_text", "away_text")
    missed = (F.col("kind") == 2) | ((F.col("kind") == 3) & text.contains("MISS"))
    mark = F.when(missed, F.col("t1")).when(F.col("kind").isin(1, 4), F.lit(""))
    game = Window.partitionBy("game_id").orderBy("num")
    scores = F.when(F.trim(F.coalesce("score", F.lit(""))) != "", F.split("score", "-"))
    e = events.select("*", F.last(mark, ignorenulls=True).over(game.rowsBetween(Window.unboundedPreceding, -1)).alias("open"), scores[1].cast("int").alias("h"), scores[0].cast("int").alias("a"))
    gain = lambda c: F.coalesce(F.col(c) - F.coalesce(F.last(c, ignorenulls=True).over(game.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    own = F.when((F.col("kind") == 4) & (F.col("open") == F.col("t1")), -1.0).when(F.col("kind").isin(1, 2, 5), 1.0).when(F.col("kind") == 3, 0.44).otherwise(0.0)
    e = e.where("kind <> 8").select("game_id", "period", "num", gain("h").alias("home_points"), gain("a").alias("away_points"), "t1", own.alias("used"))
    starts = both.select("game_id", "period", "num", F.col("num").alias("spell"))
    placed = starts.unionByName(e, allowMissingColumns=True).withColumn("spell", F.last("spell", ignorenulls=True).over(Window.partitionBy("game_id", "period").orderBy("num")))
    told = placed.where("t1 is not null").join(named, "game_id").groupBy("game_id", "period", "spell").agg(
        F.sum("home_points").alias("home_points"), F.sum("away_points").alias("away_points"),
        *[F.sum(F.when(F.col("t1") == F.col(side), F.col("used"))).alias(f"{side}_used") for side in ("home", "away")],
    )
    kept = both.select("game_id", "home", "away", "period", F.col("num").alias("spell"), "seconds", "home_five", "away_five")
    return kept.join(told, ["game_id", "period", "spell"], "left").fillna(0, ["home_points", "away_points", "home_used", "away_used"])


def _sides(s: DataFrame, *more: Column) -> DataFrame:
    """Two rows for each spell, one a side: team, players, opponents, points, against, used."""
    side = lambda a, b: F.struct(F.col(a).alias("team"), F.col(f"{a}_five").alias("players"), F.col(f"{b}_five").alias("opponents"), F.col(f"{a}_points").alias("points"), F.col(f"{b}_points").alias("against"), F.col(f"{a}_used").alias("possessions"))
    return s.select("game_id", "period", "spell", "seconds", *more, F.explode(F.array(side("home", "away"), side("away", "home"))).alias("x")).select("game_id", "period", "spell", "seconds", *more, "x.*")


def rejected(events: DataFrame, named: DataFrame, s: DataFrame) -> DataFrame:
    """(game_id, reason) of games that don't add up: a side unknown, a lineup that isn't five, no result, other seconds."""
    each = _sides(s)
    short = each.where((F.col("spell") < 0) & ((F.size("players") != ON_COURT) | F.col("players").isNull())).select("game_id", F.lit("2 not five players at the start of a period").alias("reason"))
    unknown = events.select("game_id").distinct().join(named, "game_id", "left_anti").select("game_id", F.lit("1 a side is unknown").alias("reason"))
    totals = each.groupBy("game_id", "team").agg(F.sum("points").alias("points"), F.sum(F.col("seconds") * F.size("players")).alias("seconds"), F.max("period").alias("periods"))
    final = totals.groupBy("game_id").agg(F.min("points").alias("least"), F.max("points").alias("most")).where("least <= 0 or least = most")
    due = ON_COURT * (4 * REGULAR + OVERTIME * F.greatest(F.lit(0), F.col("periods") - 4))
    odd = totals.where(F.abs(F.col("seconds") - due) > SLACK)
    reasons = unknown.unionByName(short).unionByName(final.select("game_id", F.lit("3 the final score is no result").alias("reason"))).unionByName(odd.select("game_id", F.lit("4 other seconds than a game has").alias("reason")))
    return reasons.groupBy("game_id").agg(F.substring(F.min("reason"), 3, 80).alias("reason"))


def _followed(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The events, the spells of all games and the rejected games. The events are written first: some ten steps read them,
    and each would otherwise derive them anew."""
    events = materialize(events, "events")
    named = materialize(sides(events), "sides")
    s = materialize(spells(events, named), "spells")
    return events, s, materialize(rejected(events, named, s), "rejected")


def verdicts(events: DataFrame) -> DataFrame:
    """(game_id, reason) of every game, the reason null where it adds up."""
    events, _, bad = _followed(events)
    return events.select("game_id").distinct().join(bad, "game_id", "left")


def lines_and_stints(events: DataFrame) -> DataFrame:
    """Lines (seconds, plus-minus), stints (lineups, points, possessions) and rejected games with the reason."""
    _, s, bad = _followed(events)
    good = _sides(s.join(bad, "game_id", "left_anti"))
    lines = good.withColumn("player", F.explode("players")).groupBy("game_id", "player", "team").agg(F.sum("seconds").cast("int").alias("seconds"), F.sum(F.col("points") - F.col("against")).cast("int").alias("plus_minus"))
    number = F.dense_rank().over(Window.partitionBy("game_id").orderBy("period", "spell")) - 1
    stints = good.where("seconds > 0").withColumn("stint", number.cast("int")).select("game_id", "stint", "team", "players", "opponents", "seconds", F.col("points").cast("int").alias("points"), F.col("against").cast("int").alias("against"), "possessions")
    parts = [lines.withColumn("kind", F.lit("line")), stints.withColumn("kind", F.lit("stint")), bad.withColumn("kind", F.lit("reject"))]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return every.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in STINTS.split(", ")])
