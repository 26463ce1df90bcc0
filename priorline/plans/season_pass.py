"""All of a side's features before each game in one pass over the seasons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from priorline.functions import geo
from priorline.operators import rolling
from priorline.plans import views
from priorline.plans.oracle import _MILES
from priorline.plans.registry import Registry

SEASON_PASS = Registry()
query = SEASON_PASS.query
TEAM = ["season", "team"]
#: What continuity is before a team's third game, and a schedule's strength before its second.
OPENER_CONTINUITY, OPENER_STRENGTH = 1.0, 1500.0

_PASS = """
sided as (select game_id, cast(player % 2 as int) is_away, list({'player': player, 'minutes': minutes} order by player) played from lines group by 1, 2),
base as (select t.*, case when t.is_away = 0 then team else opp end arena, (1400 + opp * 37 % 200)::double elo, s.played from team_games t left join sided s using (game_id, is_away)),
seen as (
  select *, coalesce(game_date - max(game_date) over prior - 1, 0)::bigint rest, coalesce(game_date - max(game_date) over prior = 1, false) b2b, count(*) over week g7, coalesce(sum(is_away) over week, 0)::bigint r7,
         {'a': lag(arena) over w, 'k': row_number() over w - 1, 'p1': coalesce(lag(played) over w, []), 'p2': coalesce(lag(played, 2) over w, []),
          'ten': coalesce(flatten(list(coalesce(played, [])) over (partition by season, team order by game_date, game_id rows between 11 preceding and 2 preceding)), []),
          'net': sum(pf - pa) over ten * 100.0::double / sum(pf + pa) over ten, 'elo': avg(elo) over ten} s
  from base
  window w as (partition by season, team order by game_date, game_id), ten as (partition by season, team order by game_date, game_id rows between 10 preceding and 1 preceding),
         prior as (partition by season, team order by game_date range between unbounded preceding and interval 1 day preceding),
         week as (partition by season, team order by game_date range between interval 7 day preceding and interval 1 day preceding)),
known as (select * exclude (s, elo), unnest(first_value(s) over (partition by season, team, game_date order by game_id)) from seen),
placed as (select *, arena b, (25 + a % 6 * 4)::double lat_a, (-120 + a % 10 * 5)::double lon_a, (25 + arena % 6 * 4)::double lat_b, (-120 + arena % 10 * 5)::double lon_b,
                  list_sum([x.minutes for x in p1]) m from known)"""


@query(
    f"""select game_id, team, rest rest_days, b2b back_to_back, g7 games_7d, r7 road_7d, round(coalesce({_MILES}, 0), 4) miles, coalesce(a % 4 - b % 4, 0)::bigint zones,
               round(case when k < 2 or coalesce(m, 0) = 0 then 1.0 else coalesce(list_sum([x.minutes for x in p1 if list_contains([y.player for y in ten], x.player)]), 0)::double / m end, 6) roster,
               round(case when k < 2 or len(p1) = 0 then 1.0 else len(list_intersect([x.player for x in p1], [x.player for x in p2]))::double / len(p1) end, 6) lineup,
               round(coalesce(net, 0), 6) net, round(case when coalesce(m, 0) = 0 then 0 else list_sum([x.minutes * (x.player * 37 % 200 - 100) for x in p1])::double / (10 * m) end, 6) as player_value,
               round(coalesce(elo, 1500), 6) strength from placed""",
    _PASS,
)
def season_pass(spark, sf_dir):
    """Eleven features of each side from games of earlier dates in its season: rest, second day running, games and road games
    of the week, miles and hours from the last arena, continuity of the roster and of the lineup, net rating, the last
    game's value by minutes, and the strength of the last ten opponents. Beside the lines of games, rows are shuffled once, by team and season; all windows
    stand on that, and what one row needs of the games before is at most twelve games' lines."""
    side = (F.col("player") % 2).cast("int").alias("is_away")
    played = F.array_sort(F.collect_list(F.struct("player", "minutes"))).alias("played")
    t = views.team_games(spark, sf_dir).join(views.lines(spark, sf_dir).groupBy("game_id", side).agg(played), ["game_id", "is_away"], "left")
    t = t.withColumns({
        "played": F.coalesce("played", F.expr("cast(array() as array<struct<player: bigint, minutes: bigint>>)")),
        "arena": F.when(F.col("is_away") == 0, F.col("team")).otherwise(F.col("opp")),
        "elo": (1400 + F.col("opp") * 37 % 200).cast("double"),
    })
    t = rolling.load_features(t, by=TEAM, day="game_date", away="is_away")
    order, ten = Window.partitionBy(*TEAM).orderBy("game_date", "game_id"), rolling.last_rows(TEAM, "game_date", "game_id")
    before = F.struct(
        F.lag("arena").over(order).alias("arena"),
        (F.row_number().over(order) - 1).alias("games"),
        F.lag("played").over(order).alias("last"),
        F.lag("played", 2).over(order).alias("earlier"),
        F.flatten(F.collect_list("played").over(order.rowsBetween(-rolling.LAST - 1, -2))).alias("window"),
        (F.sum(F.col("pf") - F.col("pa")).over(ten) * 100.0 / F.sum(F.col("pf") + F.col("pa")).over(ten)).alias("net"),
        F.avg("elo").over(ten).alias("elo"),
    )
    t = rolling.of_day(t.withColumn("before", before).drop("played"), "before", TEAM, "game_date", "game_id")
    b = F.col("before")
    players = lambda lines: F.transform(lines, lambda x: x["player"])
    added = lambda lines, f: F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + f(x).cast("long"))
    minutes, few = added(b["last"], lambda x: x["minutes"]), b["games"] < 2
    none = few | (F.coalesce(minutes, F.lit(0)) == 0)
    shared = added(F.filter(b["last"], lambda x: F.array_contains(players(b["window"]), x["player"])), lambda x: x["minutes"])
    same = F.size(F.array_intersect(players(b["last"]), players(b["earlier"]))).cast("double") / F.size(b["last"])
    worth = added(b["last"], lambda x: x["minutes"] * (x["player"] * 37 % 200 - 100)).cast("double") / (10 * minutes)
    place = lambda c: ((25 + c % 6 * 4).cast("double"), (-120 + c % 10 * 5).cast("double"))
    miles = geo.great_circle_miles(*place(b["arena"]), *place(F.col("arena")))
    return t.select(
        "game_id", "team", "rest_days", "back_to_back", "games_7d", "road_7d",
        F.round(F.coalesce(miles, F.lit(0.0)), 4).alias("miles"),
        F.coalesce(b["arena"] % 4 - F.col("arena") % 4, F.lit(0)).cast("long").alias("zones"),
        F.round(F.when(none, OPENER_CONTINUITY).otherwise(shared.cast("double") / minutes), 6).alias("roster"),
        F.round(F.when(few | (F.size(b["last"]) == 0), OPENER_CONTINUITY).otherwise(same), 6).alias("lineup"),
        F.round(F.coalesce(b["net"], F.lit(0.0)), 6).alias("net"),
        F.round(F.when(F.coalesce(minutes, F.lit(0)) == 0, 0.0).otherwise(worth), 6).alias("player_value"),
        F.round(F.coalesce(b["elo"], F.lit(OPENER_STRENGTH)), 6).alias("strength"),
    )
