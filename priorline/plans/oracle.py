"""SQL that gives the same rows as the query of the same name."""

from __future__ import annotations

from priorline.plans.views import SQL as _VIEWS

_LOSS = "-ln(greatest(case when won then {p} else 1.0 - {p} end, 1e-15))"
_BRIER = "pow({p} - won::int::double, 2.0)"


def _sql(body: str, more: str = "") -> str:
    return f"with {_VIEWS.strip()}{', ' + more.strip() if more else ''} {body.strip()}"


_ASOF = """
select t.tip_id, t.{key}, max_by(r.event_id, (r.report_time, r.event_id)) event_id, max_by(r.status, (r.report_time, r.event_id)) status
from tips t left join reports r on {on} and r.report_time <= t.tipoff - interval 60 minute group by 1, 2"""
_MILES = "2 * 3958.7613 * asin(least(sqrt(pow(sin(radians(lat_b - lat_a) / 2), 2) + cos(radians(lat_a)) * cos(radians(lat_b)) * pow(sin(radians(lon_b - lon_a) / 2), 2)), 1.0))"

ORACLE_SQL = {
    "elo_venue_probability": _sql("select game_id, round(base_p, 6) base_p, round(p, 6) p from forecasts"),
    "season_scores": _sql(f"""
        select season, count(*) n, round(avg({_BRIER.format(p='p')}), 6) brier, round(avg({_LOSS.format(p='p')}), 6) log_loss,
               round(avg(((p >= 0.5) = won)::int::double), 6) accuracy from forecasts group by rollup (season)"""),
    "reliability_bins": _sql("""
        select least(floor(p * 10), 9)::int bin, count(*) n, round(avg(p), 6) mean_p, round(avg(won::int::double), 6) rate from forecasts group by 1"""),
    "calibration_error": _sql("""
        select round(sum(n * abs(mean_p - rate)) / sum(n), 6) ece from (
          select least(floor(p * 10), 9) bin, count(*) n, avg(p) mean_p, avg(won::int::double) rate from forecasts group by 1)"""),
    "calendar_blocks": _sql(f"""
        select season, date_trunc('week', game_date)::date as week, round(sum({_LOSS.format(p='base_p')} - {_LOSS.format(p='p')}), 6) total, count(*) n
        from forecasts group by 1, 2"""),
    "paired_delta": _sql(f"""
        select season, count(d) n, round(avg(d), 6) mean, round(avg(d) - 1.959963984540054 * sqrt(var_samp(d) / count(d)), 6) low,
               round(avg(d) + 1.959963984540054 * sqrt(var_samp(d) / count(d)), 6) high
        from (select season, {_BRIER.format(p='base_p')} - {_BRIER.format(p='p')} d from forecasts) group by 1"""),
    "difficulty_buckets": _sql(f"""
        select case when greatest(p, 1 - p) < 0.6 then 'hard' when greatest(p, 1 - p) < 0.75 then 'medium' else 'easy' end difficulty,
               count(*) n, round(avg({_BRIER.format(p='p')}), 6) brier from forecasts group by 1"""),
    "perspective_sample": _sql("""
        select game_id, team, opp, is_away from team_games
        where is_away = (position(substr(sha256(game_id::varchar), 2, 1) in '0123456789abcdef') - 1) % 2"""),
    "anonymous_ids": _sql("select game_id, 'g-' || substr(sha256('v1:' || game_id::varchar), 1, 16) question_id from games"),
    "side_swap_union": _sql("""
        select swapped, count(*) n, round(sum(p), 3) p, count(*) filter (won) won, sum(margin)::bigint margin from (
          select false swapped, p, won, hs - as_ margin from forecasts union all select true, 1 - p, not won, as_ - hs from forecasts) group by 1"""),
    "moneyline_devig": _sql(
        "select game_id, round(h / (h + a), 6) home_p, round(h + a - 1, 6) margin from implied",
        """lines_ as (select game_id, (case when game_id % 2 = 0 then -(105 + game_id % 200) else 100 + game_id % 150 end)::double x,
                             (case when game_id % 2 = 1 then -(105 + game_id % 200) else 100 + game_id % 150 end)::double y from games),
           implied as (select game_id, case when x < 0 then -x / (-x + 100.0::double) else 100.0::double / (x + 100.0::double) end h,
                              case when y < 0 then -y / (-y + 100.0::double) else 100.0::double / (y + 100.0::double) end a from lines_)""",
    ),
    "bayes_update": _sql("""
        select game_id, round(wh / (wh + wa), 6) home_p, case when wh >= wa then 'home' else 'away' end predicted from (
          select game_id, base_p * exp((hs - as_)::double / 20) wh, (1 - base_p) * exp(-(hs - as_)::double / 20) wa from forecasts)"""),
    "rms_scales": _sql("select round(sqrt(avg(pow((hs - as_)::double, 2))), 6) margin, round(sqrt(avg(pow((home - away)::double, 2))), 6) gap, 1.0::double none from games"),
    "feature_pivot": _sql("""
        select game_id, sum(case when is_away = 0 then pa else -pa end)::bigint pa, sum(case when is_away = 0 then pf else -pf end)::bigint pf from team_games group by 1"""),
    "asof_report": _sql(_ASOF.format(key="team", on="r.team = t.team")),
    "asof_containing": _sql(_ASOF.format(key="player", on="r.team = t.team and r.player = t.player")),
    "asof_horizons": _sql(
        """select horizon, count(*) n, count(*) filter (report_time >= cutoff - interval 7 day) fresh, count(*) filter (event_id is null) missing, sum(event_id)::bigint ids
           from found group by 1""",
        """due as (select t.*, h.horizon, tipoff - h.horizon * interval 1 minute cutoff from tips t, (select unnest([360, 120, 60, 15])::int horizon) h),
           found as (select d.tip_id, d.horizon, d.cutoff, max(r.report_time) report_time, max_by(r.event_id, (r.report_time, r.event_id)) event_id
                     from due d left join reports r on r.player = d.player and r.report_time <= d.cutoff group by 1, 2, 3)""",
    ),
    "asof_ambiguous": _sql("""
        select team, day, count(*) n_latest, case when count(*) = 1 then max(event_id) end picked from (
          select *, report_time::date as day, rank() over (partition by team, report_time::date order by date_trunc('hour', report_time) desc) k from reports)
        where k = 1 group by 1, 2"""),
    "revision_deltas": _sql(
        """select player, sum(greatest(step, 0))::bigint down, sum(greatest(-step, 0))::bigint up, count(*) filter (step <> 0) changes, round(max(gap), 3) longest_gap
           from stepped group by 1""",
        """ranked as (select *, list_position(['Available', 'Probable', 'Questionable', 'Doubtful', 'Out'], status)::int rank from reports),
           stepped as (select player, rank - lag(rank) over w step, (epoch_us(report_time) - epoch_us(lag(report_time) over w)) / 60e6 gap
                       from ranked window w as (partition by player order by report_time, event_id))""",
    ),
    "final_snapshot_schedule": _sql("""
        select team, report_time::date as day, event_id, player from reports
        qualify row_number() over (partition by team, report_time::date order by report_time desc, event_id desc) = 1"""),
    "status_rates": _sql("""
        select status, count(*) n, round(avg(coalesce(epoch_us(nxt) - epoch_us(report_time) <= 172800000000, false)::int::double), 6) rate
        from (select *, lead(report_time) over (partition by player order by report_time, event_id) nxt from reports) group by 1"""),
    "late_captures": _sql("select team, event_id * 37 % 180 <= 60 eligible, count(*) n, round(sum(minutes), 3) as minutes from reports group by 1, 2"),
    "positional_join": _sql(
        """select g.game_id, g.home, g.away, s.day from g join s using (home, away, k)
           where (select count(*) from g x where x.home = g.home and x.away = g.away) = (select count(*) from s x where x.home = g.home and x.away = g.away)""",
        """g as (select home, away, game_id, row_number() over (partition by home, away order by game_id) k from games),
           s as (select home, away, game_date as day, row_number() over (partition by home, away order by game_date) k from games where game_id % 23 <> 0)""",
    ),
    "join_notes": _sql("""
        select home, away, count(*) n_left, count(*) filter (game_id % 23 <> 0) n_right from games group by 1, 2 having n_left <> n_right"""),
    "coverage_failures": _sql(f"""
        select season, count(*) n, count(*) filter (game_id % 17 = 0) failures,
               round(avg(case when game_id % 17 = 0 then -ln(1e-15::double) else {_LOSS.format(p='p')} end), 6) log_loss from forecasts group by 1"""),
    "lagged_season_value": _sql(
        """select g.game_id, round(h.value - a.value, 6) difference from games g
           join v h on h.season = g.season - 1 and h.team = g.home join v a on a.season = g.season - 1 and a.team = g.away""",
        "v as (select season, team, sum(pf::double * pa) / sum(pa) as value from team_games group by 1, 2)",
    ),
    "priority_lookup": """
        select c_custkey, coalesce(n_name, r_name, 'none') place from customer
        left join nation on n_nationkey = case when c_nationkey % 3 <> 0 then c_nationkey end left join region on r_regionkey = c_custkey % 7""",
    "season_division": _sql("""
        select season, count(distinct team) n_found, (select count(distinct team) from team_games where season = 1997) n_required,
               count(distinct team) = (select count(distinct team) from team_games where season = 1997) complete
        from team_games where team in (select team from team_games where season = 1997) group by 1"""),
    "duplicate_lines": "select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1",
    "orbit_first": _sql("""
        select least(home, away) a, greatest(home, away) b, game_id, game_date from games
        qualify row_number() over (partition by least(home, away), greatest(home, away) order by game_date, game_id) = 1"""),
    "unordered_pairs": _sql("select game_date, least(home, away) a, greatest(home, away) b, count(*) n from games group by 1, 2, 3 having count(*) > 1"),
    "calibration_precedes": _sql("""
        select game_id, season, least(home, away) a, greatest(home, away) b from games g where season >= 2000 and not exists (
          select 1 from games e where e.season < 2000 and e.hs - e.as_ > 40 and least(e.home, e.away) = least(g.home, g.away) and greatest(e.home, e.away) = greatest(g.home, g.away))"""),
    "season_boundaries": _sql("""
        select *, coalesce("first" > lag("last") over (order by season), true) clean from (
          select season, min(game_date) as "first", max(game_date) as "last", count(*) n from games group by 1)"""),
    "event_properties": "select event_type, count(k) n, sum(k)::bigint total, max(k) top from (select event_type, (props->>'k')::bigint k from events) group by 1",
    "probability_domain": _sql("""
        select rule, count(*) n from (select unnest([case when p < 0.2 then 'p_low' end, case when p > 0.8 then 'p_high' end,
          case when home = away then 'same_team' end, case when hs = as_ then 'tie' end]) rule from forecasts) where rule is not null group by 1"""),
    "rolling_load": _sql("""
        select game_id, team, coalesce(game_date - max(game_date) over prior - 1, 0)::bigint rest_days,
               coalesce(game_date - max(game_date) over prior = 1, false) back_to_back, count(*) over week games_7d, coalesce(sum(is_away) over week, 0)::bigint road_7d
        from team_games window
          prior as (partition by season, team order by game_date range between unbounded preceding and interval 1 day preceding),
          week as (partition by season, team order by game_date range between interval 7 day preceding and interval 1 day preceding)"""),
    "rolling_form": _sql(
        """select t.game_id, t.team, len(l) n_last, round(case when len(l) > 0 then list_avg([x.won for x in l]) else 0.5 end, 6) win_rate,
                  round(case when len(l) > 0 then list_avg([x.margin for x in l]) else 0 end, 6) mean_margin
           from team_games t join held using (season, team, game_date)""",
        """days as (select season, team, game_date, list({'game_id': game_id, 'won': (pf > pa)::int, 'margin': pf - pa} order by game_id) held from team_games group by 1, 2, 3),
           held as (select season, team, game_date, coalesce(flatten(list(held) over (partition by season, team order by game_date rows between 10 preceding and 1 preceding))[-10:], []) l from days)""",
    ),
    "travel_miles": _sql(
        f"select season, team, count(*) n, round(sum(coalesce({_MILES}, 0)), 2) miles from places group by 1, 2",
        """legs as (select season, team, game_date, game_id, case when is_away = 0 then team else opp end b,
                           lag(case when is_away = 0 then team else opp end) over (partition by season, team order by game_date, game_id) a from team_games),
           places as (select season, team, (25 + a % 6 * 4)::double lat_a, (-120 + a % 10 * 5)::double lon_a, (25 + b % 6 * 4)::double lat_b, (-120 + b % 10 * 5)::double lon_b from legs)""",
    ),
    "net_rating": _sql("""
        select game_id, team, round(coalesce(first_value(x) over (partition by season, team, game_date order by game_id), 0), 6) net from (
          select *, sum(pf - pa) over w * 100.0::double / sum(pf + pa) over w x from team_games
          window w as (partition by season, team order by game_date, game_id rows between 10 preceding and 1 preceding))"""),
    "lineup_continuity": _sql(
        """select game_id, first_value(both_) over w shared, first_value(n) over w as "last" from (
             select *, coalesce(len(list_intersect(lag(players, 1) over w, lag(players, 2) over w)), 0)::bigint both_, coalesce(len(lag(players, 1) over w), 0)::bigint n
             from g window w as (partition by season, home order by game_date, game_id))
           window w as (partition by season, home, game_date order by game_id)""",
        "g as (select game_id, any_value(home) home, any_value(game_date) game_date, any_value(season) season, list(distinct player) players from lines join games using (game_id) group by 1)",
    ),
    "player_rolling": _sql("""
        select game_id, player, round(coalesce(first_value(x) over (partition by player, game_date order by game_id), 0), 6) as value from (
          select *, sum(plus_minus) over w * 100.0::double / sum(minutes) over w x from lines join games using (game_id)
          window w as (partition by player order by game_date, game_id rows between 10 preceding and 1 preceding))"""),
    "expected_minutes": _sql("""
        select player, count(*) n, median(minutes)::double as minutes from (
          select *, row_number() over (partition by player order by game_date desc, game_id desc) k from lines join games using (game_id)) where k <= 10 group by 1"""),
    "snapshot_coverage": _sql(
        """select day, count(teams) slots, coalesce(sum(teams), 0)::bigint teams from (select distinct day, unnest([0, 1, 2, 3, 4, 5]) slot from r) left join
           (select day, slot, count(distinct team) teams from r group by 1, 2) using (day, slot) group by 1""",
        "r as (select report_time::date as day, (hour(report_time) // 4)::int slot, team from reports)",
    ),
    "health_terms": r"""
        select conv_id, turn, array_to_string(list_sort(t), ',') terms, len(t)::bigint n from (
          select conv_id, turn, list_intersect(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')), ['the', 'est', 'die', 'por', 'injury', 'ankle']) t from conversations)""",
    "stated_probability": _sql("select game_id, printf('%.4f', p)::double stated from forecasts"),
    "prompt_text": _sql("""
        select game_id, sha256(printf('Team %02d at team %02d, margin %+d, prior %.4f', away, home, hs - as_, base_p)) digest from forecasts"""),
    "arm_mixture": """
        select label, count(*) n, round(avg(list_max(w)), 5) top, round(avg(list_min(w)), 5) least from (
          select label, [x / list_sum(e) for x in e] w from (select label, [exp(x::double * 10) for x in embedding] e from embeddings)) group by 1""",
    "block_digests": """
        select block, count(*) n, sha256(string_agg(d, '' order by event_id)) digest from (
          select event_id // 1000 block, event_id, sha256(concat_ws('|', event_id::varchar, event_type, props)) d from events) group by 1""",
    "stream_running_totals": "select user_id, count(*) n_events, max(event_id) last_event, round(sum(value), 3) total_value from events group by 1",
    "stream_due_captures": """
        select user_id as key, timer, event_id poll_id, ts::date as day from (
          select *, row_number() over (partition by user_id, timer, ts::date order by ts, event_id) k from (
            select e.*, t.timer, date_trunc('day', ts) + interval 20 hour starts, t.m
            from events e, (values ('T-6h', 360), ('T-60', 60), ('T-15', 15)) t(timer, m))
          where ts <= starts and abs(epoch_us(ts) - (epoch_us(starts) - m::bigint * 60000000)) <= 1800000000) where k = 1""",
    "venue_balance": _sql("""
        select *, least(home_wins, away_wins) >= 0.45 * (home_wins + away_wins) balanced from (
          select season, count(*) filter (hs > as_) home_wins, count(*) filter (hs < as_) away_wins from games group by 1)"""),
    "centred_rewards": """
        select event_type, count(*) n, round(avg(x), 4) mean, round(var_pop(x), 4) variance from (
          select event_type, value - avg(value) over (partition by user_id) x from events) group by 1""",
    "canary_slice": _sql("""
        select question_id, unnest([false, true]) swapped from (
          select 'g-' || substr(sha256('v1:' || game_id::varchar), 1, 16) question_id from games order by 1 limit 64 offset 64)"""),
    "journal_replay": """
        select user_id, count(*) started, count(*) filter (nxt = 'purchase') completed, count(*) filter (nxt is null) torn from (
          select *, lead(event_type) over (partition by user_id order by ts, event_id) nxt from events) where event_type = 'view' group by 1""",
    "artifact_contract": _sql("""
        select season, count(*) n, count(distinct game_id) ids, min(game_id) as "first", max(game_id) as "last",
               sum(('0x' || substr(sha256(game_id::varchar), 1, 8))::bigint)::bigint digest from games group by 1"""),
    "tips_in_week": _sql("""
        select tip_id, team, count(*) over (partition by team order by tipoff range between interval 7 day preceding and interval 1 microsecond preceding) n from tips"""),
    "upsert_by_day": _sql("""
        select team, report_time::date as_of, max_by(event_id, (report_time, event_id)) event_id, max_by(minutes, (report_time, event_id)) as minutes, count(*) versions
        from reports group by 1, 2"""),
    "due_work": _sql("select tip_id, team from tips where tipoff >= timestamp '2024-01-15' order by tipoff, tip_id limit 20"),
    "stream_window_counts": """
        select date_trunc('hour', ts) as start, event_type, count(*) n from events
        where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 2 hour group by 1, 2""",
    "zone_offsets": _sql("""
        select day, min(east) east, max(west) west, max(east - west) change from (
          select report_time::date as day, epoch(timezone('America/New_York', timezone('UTC', report_time)) - report_time) / 3600.0::double east,
                 epoch(timezone('America/Los_Angeles', timezone('UTC', report_time)) - report_time) / 3600.0::double west from reports) group by 1"""),
}
