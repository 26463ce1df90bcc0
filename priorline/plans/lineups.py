"""Games of plays with lineups, in the given tables' lines: stints, player lines, rejects and lineup ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorline.operators import playbyplay, ridge
from priorline.plans import views
from priorline.plans.registry import Registry

LINEUPS = Registry()
query = LINEUPS.query

#: Orders that make one game, seasons.
ORDERS, SEASONS = 64, 6


def plays(spark, sf_dir) -> DataFrame:
    """Events of the games that 64 neighbouring orders make: a line is a play, its supplier the player, its part the
    kind. A team changes one of its five starters for one of three others at most once a period."""
    li = views.table(spark, sf_dir, "lineitem")
    game = F.expr(f"l_orderkey div {ORDERS}")
    li = li.withColumn("game_id", game)
    order = Window.partitionBy("game_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    numbered = li.select("game_id", "l_suppkey", "l_partkey", F.row_number().over(order).cast("long").alias("num"), F.count(F.lit(1)).over(Window.partitionBy("game_id")).alias("n"))
    home = F.col("game_id") % views.TEAMS
    away = (home + 1 + F.col("game_id") % (views.TEAMS - 1)) % views.TEAMS
    numbered = numbered.withColumns({"period": F.expr("cast((num - 1) * 4 div n + 1 as int)"), "at_home": F.col("l_suppkey") % 2 == 0, "who": F.expr("l_suppkey div 2"), "k": F.col("l_partkey") % 20})
    numbered = numbered.withColumn("team", F.when(F.col("at_home"), home).otherwise(away))
    kind = F.expr("cast(case when k < 7 then 1 when k < 13 then 2 when k < 15 then 3 when k < 17 then 4 when k < 18 then 5 when k < 19 then 6 when row_number() over (partition by game_id, period, team, k order by num) = 1 then 8 else 6 end as int)")
    left = F.expr("cast(720 - 720 * (row_number() over (partition by game_id, period order by num)) div (count(*) over (partition by game_id, period) + 1) as int)")
    e = numbered.withColumns({"kind": kind, "left_s": left}).withColumn("missed", (F.col("kind") == 3) & (F.col("who") % 2 == 1))
    worth = F.when(F.col("kind") == 1, 2).when((F.col("kind") == 3) & ~F.col("missed"), 1).otherwise(0)
    so_far = Window.partitionBy("game_id").orderBy("num")
    score = lambda at_home: F.sum(F.when(F.col("at_home") == at_home, worth).otherwise(0)).over(so_far)
    e = e.withColumns({"score": F.when(worth > 0, F.concat(score(False).cast("string"), F.lit(" - "), score(True).cast("string"))).otherwise("")})
    bench = F.col("kind") == 8
    base = (F.col("team") + 1) * 100
    word = F.when(F.col("missed"), "MISS").otherwise("x")
    side = F.col("team").cast("string")
    return e.select(
        "game_id", "num", "kind", "period", F.format_string("%d:%02d", F.expr("left_s div 60"), F.col("left_s") % 60).alias("clock"),
        F.when(F.col("at_home"), word).otherwise("").alias("home_text"), F.when(F.col("at_home"), "").otherwise(word).alias("away_text"), "score",
        (base + F.col("who") % 5).alias("p1"), side.alias("t1"),
        F.when(bench, base + 5 + F.expr("l_partkey div 20") % 3).otherwise(0).alias("p2"), F.when(bench, side).otherwise("").alias("t2"),
        F.lit(0).cast("long").alias("p3"), F.lit("").alias("t3"),
    )


_PLAYS = f"""
numbered as (
  select l_orderkey // {ORDERS} game_id, l_suppkey // 2 who, l_suppkey % 2 = 0 at_home, l_partkey % 20 k, l_partkey,
         row_number() over (partition by l_orderkey // {ORDERS} order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate) num, count(*) over (partition by l_orderkey // {ORDERS}) n from lineitem),
kinds as (
  select *, case when k < 7 then 1 when k < 13 then 2 when k < 15 then 3 when k < 17 then 4 when k < 18 then 5 when k < 19 then 6 when row_number() over (partition by game_id, period, team, k order by num) = 1 then 8 else 6 end kind from (
    select *, ((num - 1) * 4 // n + 1)::int period, case when at_home then game_id % 30 else (game_id % 30 + 1 + game_id % 29) % 30 end team from numbered)),
plays as (
  select game_id, num, kind, period, team::varchar t1, at_home, kind = 3 and who % 2 = 1 missed, (team + 1) * 100 + who % 5 p1,
         case when kind = 8 then (team + 1) * 100 + 5 + l_partkey // 20 % 3 end p2,
         (720 - 720 * row_number() over (partition by game_id, period order by num) // (count(*) over (partition by game_id, period) + 1))::int left_s,
         case when kind = 1 then 2 when kind = 3 and who % 2 = 0 then 1 else 0 end worth from kinds),
named as (
  select h.game_id, home, away from (select game_id, max_by(t1, (n, -first)) home from (select game_id, t1, count(*) n, min(num) first from plays where at_home group by 1, 2) group by 1) h
  join (select game_id, max_by(t1, (n, -first)) away from (select game_id, t1, count(*) n, min(num) first from plays where not at_home group by 1, 2) group by 1) a using (game_id)),
acts as (select game_id, period, t1 team, player, count(*) n from (select game_id, period, t1, p1 player from plays union all select game_id, period, t1, p2 from plays where kind = 8) group by 1, 2, 3, 4),
marks as (select game_id, period, player, min_by(way, num) way from (select game_id, period, num, p1 player, 'out' way from plays where kind = 8 union all select game_id, period, num, p2, 'in' from plays where kind = 8) group by 1, 2, 3),
starters as (
  select game_id, period, team, coalesce(list(player order by (coalesce(way, '') <> 'out')::int desc, n desc, player desc) filter (where coalesce(way, '') <> 'in'), []) likely,
         coalesce(list(player) filter (where way = 'in'), []) came, map_from_entries(list(row(player, n))) acts
  from acts left join marks using (game_id, period, player) group by 1, 2, 3),
changes as (
  select *, row_number() over (partition by game_id, team order by period, num) k from (
    select game_id, team, period, -1::bigint num, null::bigint leaves, null::bigint enters, likely, came, acts from starters
    union all select game_id, t1, period, num, p1, p2, null, null, null from plays where kind = 8)),
five as (
  select game_id, team, 0::bigint k, 0 period, 0::bigint num, []::bigint[] players, map_from_entries([row(0::bigint, 0::bigint)]) acts from (select distinct game_id, team from changes)
  union all
  select game_id, team, k, period, num, list_sort(case when num < 0 then list_concat(likely[:5], list_filter(players, lambda p: not list_contains(likely[:5], p) and not list_contains(came, p))[:greatest(5 - len(likely[:5]), 0)])
         else list_distinct(list_append(list_filter(players, lambda p: p <> quietest), enters)) end), seen from (
    select c.game_id, c.team, c.k, c.period, c.num, c.likely, c.came, c.enters, f.players, coalesce(c.acts, f.acts) seen,
           case when not list_contains(f.players, c.leaves) and len(f.players) >= 5 then list_sort(list_transform(f.players, lambda p: {{'n': coalesce(f.acts[p], 0), 'p': p}}))[1].p else c.leaves end quietest
    from five f join changes c on c.game_id = f.game_id and c.team = f.team and c.k = f.k + 1)),
placed as (
  select f.game_id, f.team, f.period, f.num, f.players, n.home, n.away, coalesce(p.left_s, 720) left_s from five f join named n using (game_id) left join plays p on p.game_id = f.game_id and p.num = f.num and p.kind = 8 where f.k > 0),
both_sides as (
  select *, last_value(case when team = home then players end ignore nulls) over (partition by game_id, period order by num, team rows between unbounded preceding and current row) home_five,
         last_value(case when team = away then players end ignore nulls) over (partition by game_id, period order by num, team rows between unbounded preceding and current row) away_five,
         coalesce(lead(num) over (partition by game_id, period order by num, team) = num, false) half from placed),
spans as (select game_id, home, away, period, num spell, left_s - coalesce(lead(left_s) over (partition by game_id, period order by num, team), 0) as seconds, home_five, away_five from both_sides where not half),
marked as (
  select *, last_value(mark ignore nulls) over (partition by game_id order by num rows between unbounded preceding and 1 preceding) open_ from (
    select *, case when kind = 2 or missed then t1 when kind in (1, 4) then '' end mark from plays)),
used as (
  select m.game_id, m.period, s.spell, sum(case when at_home then worth else 0 end) home_points, sum(case when at_home then 0 else worth end) away_points,
         sum(case when t1 = home then used end) home_used, sum(case when t1 = away then used end) away_used
  from (select *, case when kind = 4 and open_ = t1 then -1.0 when kind in (1, 2, 5) then 1.0 when kind = 3 then 0.44 else 0.0 end::double used from marked where kind <> 8) m
  asof join (select game_id, period, spell from spans) s on s.game_id = m.game_id and s.period = m.period and s.spell <= m.num join named n on n.game_id = m.game_id group by 1, 2, 3),
spells as (
  select s.*, coalesce(home_points, 0) home_points, coalesce(away_points, 0) away_points, coalesce(home_used, 0) home_used, coalesce(away_used, 0) away_used from spans s left join used using (game_id, period, spell)),
each_side as (
  select game_id, period, spell, seconds, home team, home_five players, away_five opponents, home_points points, away_points against, home_used possessions from spells
  union all select game_id, period, spell, seconds, away, away_five, home_five, away_points, home_points, away_used from spells),
side_sums as (select game_id, team, sum(points) points, sum(seconds * len(players)) as seconds, max(period) periods from each_side group by 1, 2),
reasons as (
  select game_id, '1 a side is unknown' reason from plays where game_id not in (select game_id from named)
  union all select game_id, '2 not five players at the start of a period' from each_side where spell < 0 and (players is null or len(players) <> 5)
  union all select game_id, '3 the final score is no result' from side_sums group by game_id having min(points) <= 0 or min(points) = max(points)
  union all select game_id, '4 other seconds than a game has' from side_sums where abs(seconds - 5 * (4 * 720 + 300 * greatest(0, periods - 4))) > 5),
rejects as (select game_id, min(reason)[3:] reason from reasons group by 1),
good as (select * from each_side where game_id not in (select game_id from rejects))"""


@query(
    """select 'line' kind, game_id, null::int stint, team, null::varchar players, null::varchar opponents, player, sum(seconds)::int as seconds, null::int points, null::int against, sum(points - against)::int plus_minus, null::double possessions, null::varchar reason
       from (select *, unnest(players) player from good) group by game_id, player, team
       union all
       select 'stint', game_id, stint, team, array_to_string(players, ' '), array_to_string(opponents, ' '), null, seconds::int, points::int, against::int, null, round(possessions, 6), null
       from (select *, (dense_rank() over (partition by game_id order by period, spell) - 1)::int stint from good) where seconds > 0
       union all
       select 'reject', game_id, null, null, null, null, null, null, null, null, null, null, reason from rejects""",
    _PLAYS,
)
def lineup_stints(spark, sf_dir):
    """Lineups followed through substitutions: player lines, constant-lineup stints of both sides, and games that don't add
    up with the reason."""
    out = playbyplay.lines_and_stints(plays(spark, sf_dir))
    told = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return out.select("kind", "game_id", "stint", "team", told("players"), told("opponents"), "player", "seconds", "points", "against", "plus_minus", F.round("possessions", 6).alias("possessions"), "reason")


@query("select reason, count(*) games from (select coalesce(reason, 'none') reason from (select distinct game_id from plays) left join rejects using (game_id)) group by 1", _PLAYS)
def lineup_rejects(spark, sf_dir):
    """How many games follow, and how many don't, by reason."""
    out = playbyplay.verdicts(plays(spark, sf_dir))
    return out.groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("games"))


def stints_by_season(spark, sf_dir) -> DataFrame:
    """One row for each stint, from the home side's view, with the season that its game's number tells."""
    s = playbyplay.lines_and_stints(plays(spark, sf_dir)).where("kind = 'stint'")
    s = s.withColumn("home", F.col("team") == (F.col("game_id") % views.TEAMS).cast("string"))
    side = lambda c, at_home: F.max(F.when(F.col("home") == at_home, F.col(c)))
    return s.groupBy("game_id", "stint").agg(
        side("players", True).alias("home"), side("players", False).alias("away"), side("points", True).alias("home_points"), side("points", False).alias("away_points"), F.avg("possessions").alias("possessions")
    ).withColumn("season", (F.col("game_id") % SEASONS + 2000).cast("int"))


@query(
    """select target season, i player, round(x, 4) rating, round(h, 4) home_advantage from solved s join (select target, x h from solved where i = -1 and k = (select max(k) from solved)) using (target) where i <> -1 and k = (select max(k) from solved)""",
    _PLAYS + f""",
stints as (
  select (g.game_id % {SEASONS} + 2000)::int season, players home, opponents away, possessions w, 100.0 * (points - against) / possessions m from (
    select e.game_id, e.players, e.opponents, e.points, e.against, (e.possessions + o.possessions) / 2 possessions from good e join good o on o.game_id = e.game_id and o.period = e.period and o.spell = e.spell and o.team <> e.team
      join named n on n.game_id = e.game_id and n.home = e.team where e.seconds > 0) g where possessions >= 0.5),
entries as (
  select target, id, w, m, unnest(list_concat(list_transform(home, lambda p: {{'i': p, 's': 1.0::double}}), list_transform(away, lambda p: {{'i': p, 's': -1.0::double}}), [{{'i': -1::bigint, 's': 1.0::double}}])) e from (
    select t.target, row_number() over () id, s.* from stints s join (select distinct (game_id % {SEASONS} + 2000)::int target from good) t on s.season between t.target - 3 and t.target - 1)),
rights as (select target, e.i i, sum(w * e.s * m) b from entries group by 1, 2),
penalty as (select target, 1.0::double * sum(w) / (select count(*) from rights r where r.target = d.target and r.i <> -1) l from (select distinct target, id, w from entries) d group by target),
cells as (
  select target, i, j, a + case when i = j and i <> -1 then l else 0 end a from (
    select x.target, x.e.i i, y.e.i j, sum(x.w * x.e.s * y.e.s) a from entries x join entries y on y.target = x.target and y.id = x.id group by 1, 2, 3) join penalty using (target)),
solved as (
  select 0 k, target, i, a d, 0.0::double x, b r, b / a p, sum(b * b / a) over (partition by target) first_, sum(b * b / a) over (partition by target) left_ from rights join (select target, i, a from cells where i = j) using (target, i)
  union all
  select k + 1, target, i, d, x + alpha * p, r2, case when alpha > 0 then r2 / d + after_ / left_ * p else p end, first_, after_ from (
    select *, sum(r2 * r2 / d) over (partition by target) after_ from (
      select *, r - alpha * q r2 from (
        select *, case when left_ > 1e-20 * first_ and pq > 0 then left_ / pq else 0 end alpha from (
          select *, sum(p * q) over (partition by target) pq from (
            select s.k, s.target, s.i, s.d, s.x, s.r, s.p, s.first_, s.left_, sum(c.a * o.p) q from solved s join cells c on c.target = s.target and c.i = s.i join solved o on o.target = c.target and o.i = c.j
            where s.k < 120 group by all))))))""",
)
def lineup_ridge(spark, sf_dir):
    """Players' ratings per 100 possessions for each season, from the stints of the three seasons before it alone."""
    out = ridge.lineup_ratings(stints_by_season(spark, sf_dir), "season", l2=1.0)
    return out.select("season", "player", F.round("rating", 4).alias("rating"), F.round("home_advantage", 4).alias("home_advantage"))
