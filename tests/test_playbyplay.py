"""Play-by-play on hand-made games."""

from priorline.operators import playbyplay

SCHEMA = "game_id long, num long, kind int, period int, clock string, home_text string, away_text string, score string, p1 long, t1 string, p2 long, t2 string, p3 long, t3 string"
HOME, AWAY = [101, 102, 103, 104, 105], [201, 202, 203, 204, 205]


def event(game, num, kind, period, clock, team, player, score="", other=0):
    return (game, num, kind, period, clock, "x" if team == "HOM" else "", "x" if team == "AWY" else "", score, player, team, other, team if other else "", 0, "")


def quiet(game, period):
    n = period * 1000
    return [event(game, n + k, 6, period, "11:00", t, p) for k, (t, p) in enumerate([("HOM", p) for p in HOME] + [("AWY", p) for p in AWAY])]


def simple(game):
    out = [e for period in (1, 2, 3, 4) for e in quiet(game, period)]
    out += [event(game, 1090, 1, 1, "10:00", "HOM", 101, "0 - 2"), event(game, 4090, 1, 4, "00:00", "AWY", 201, "2 - 2"), event(game, 4091, 1, 4, "00:00", "HOM", 102, "2 - 5")]
    return out


def test_simple_game_with_a_substitution_and_a_reject(spark):
    sub = [event(2, 1091, 8, 1, "06:00", "HOM", 105, other=106), event(2, 2091, 2, 2, "05:00", "AWY", 202), event(2, 2092, 4, 2, "04:58", "AWY", 203)]
    rows = spark.createDataFrame(simple(1) + simple(2) + sub + [event(3, 1, 6, 1, "11:00", "HOM", 101)], SCHEMA)
    out = playbyplay.lines_and_stints(rows).collect()
    assert [r.game_id for r in out if r.reason] == [3]
    lines = {(r.game_id, r.player): (r.seconds, r.plus_minus) for r in out if r.kind == "line"}
    assert sum(s for (g, p), (s, _) in lines.items() if g == 1 and p < 200) == 14400
    assert lines[2, 105][0] == 360 + 3 * 720 and lines[2, 106][0] == 360
    assert lines[1, 101][1] == 3 and lines[1, 201][1] == -3
    stints = [r for r in out if r.kind == "stint" and r.game_id == 2 and r.team == "HOM"]
    assert [r.seconds for r in stints] == [360, 360, 720, 720, 720] and sum(r.points for r in stints) == 5
    totals = {(r.game_id, r.team): r for r in playbyplay.team_totals(rows).collect()}
    assert (totals[2, "AWY"].fga, totals[2, "AWY"].oreb, totals[2, "AWY"].possessions) == (2, 1, 1.0)
