"""Mixtures, fits by key and lineup ratings against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorline.operators import fits, folds, mixture, ridge


def arm_rows(spark, n=400):
    rng = random.Random(2)
    rows = []
    for k in range(n):
        x = rng.gauss(0, 2)
        truth = 1 / (1 + math.exp(-x))
        good, bad = min(max(truth, 0.02), 0.98), rng.uniform(0.1, 0.9)
        a, b = (good, bad) if k % 2 else (bad, good)  # the context tells which arm is right
        rows.append((k, 1.0, float(k % 2), a, b, rng.random() < truth))
    return rows, spark.createDataFrame(rows, "k long, one double, odd double, a double, b double, won boolean")


def loss_of(theta, rows, scales, l2=0.01):
    x = np.array([[r[1], r[2]] for r in rows]) / scales
    z = x @ theta
    w = np.exp(z - z.max(1, keepdims=True))
    w /= w.sum(1, keepdims=True)
    p = (w * np.array([[r[3], r[4]] for r in rows])).sum(1)
    won = np.array([r[5] for r in rows])
    return -np.log(np.where(won, p, 1 - p)).mean() + l2 / 2 * (theta**2).sum()


def test_mixture_is_at_its_optimum_and_beats_each_arm(spark):
    rows, df = arm_rows(spark)
    found = mixture.fit_mixture(df, ["one", "odd"], ["a", "b"], "won")
    theta, scales = np.array(found.theta), np.array(found.scales)
    assert scales == pytest.approx([1.0, math.sqrt(0.5)])
    for i in range(2):
        for j in range(2):
            step = np.zeros((2, 2))
            step[i, j] = 1e-5
            slope = (loss_of(theta + step, rows, scales) - loss_of(theta - step, rows, scales)) / 2e-5
            assert abs(slope) < 1e-7
    losses = {r.name: r.loss for r in mixture.mixture_losses(df, found, "won").collect()}
    assert losses["oracle"] < losses["mixture"] < min(losses["a"], losses["b"])
    weights = df.select(found.weights().alias("w"), "odd").collect()
    assert all(abs(sum(r.w) - 1) < 1e-12 for r in weights) and all((r.w[0] > 0.5) == (r.odd == 1) for r in weights)
    mean = {(r.bucket, r.arm): r.weight for r in mixture.mean_weights(df, found, F.col("odd").cast("string")).collect()}
    assert mean["1.0", "a"] + mean["1.0", "b"] == pytest.approx(1)


def test_mixture_takes_no_arm_outside_its_range(spark):
    df = spark.createDataFrame([(1.0, 0.5, 1.0, True)], "one double, a double, b double, won boolean")
    with pytest.raises(ValueError):
        mixture.fit_mixture(df, ["one"], ["a", "b"], "won")
    with pytest.raises(ValueError):
        mixture.fit_mixture(df.limit(0), ["one"], ["a", "b"], "won")
    some = spark.createDataFrame([(None, 0.5, 0.7, True), (1.0, 0.5, 0.7, False)], "one double, a double, b double, won boolean")
    assert mixture.fit_mixture(some, ["one"], ["a", "b"], "won").scales == [pytest.approx(math.sqrt(0.5))]


def test_fits_by_key_equal_fits_one_by_one(spark):
    rng = random.Random(5)
    rows = []
    for k in range(900):
        key, x, z, o = k % 3, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 0.5)
        rows.append((key, x, 0.0 if key == 2 else z, o, rng.random() < 1 / (1 + math.exp(-(o + (key - 1) * x + 0.5 * z)))))
    df = spark.createDataFrame(rows, "key int, x double, z double, o double, won boolean")
    got = {r.key: r.w for r in fits.offset_logistic_by(df, ["key"], ["x", "z"], "won", "o").collect()}
    assert set(got) == {0, 1, 2} and got[2][1] == 0
    for key, w in got.items():
        one = fits.offset_logistic(df.where(F.col("key") == key), ["x", "z"], "won", "o")
        assert w == pytest.approx([one["x"], one["z"]], abs=1e-9)
    assert fits.offset_logistic_by(df.limit(0), ["key"], ["x"], "won").count() == 0


def stints(seed=3, players=9):
    rng = random.Random(seed)
    rows = []
    for season in (2000, 2001, 2002, 2003):
        for _ in range(120):
            five = rng.sample(range(1, 2 * players + 1), 10)
            rows.append((season, five[:5], five[5:], rng.randrange(0, 30), rng.randrange(0, 30), rng.choice([0.2, 3.0, 7.44, 12.0])))
    return rows


STINTS = "season int, home array<long>, away array<long>, home_points int, away_points int, possessions double"


def dense(rows, target, l2=0.01):
    used = [r for r in rows if target - 3 <= r[0] < target and r[5] >= 0.5]
    names = sorted({p for r in used for p in (*r[1], *r[2])})
    x = np.zeros((len(used), len(names) + 1))
    for k, (_, home, away, *_) in enumerate(used):
        for p in home:
            x[k, names.index(p)] += 1
        for p in away:
            x[k, names.index(p)] -= 1
        x[k, -1] = 1
    w = np.array([r[5] for r in used])
    y = 100 * np.array([r[3] - r[4] for r in used]) / w
    a = x.T @ (x * w[:, None])
    a[range(len(names)), range(len(names))] += l2 * w.sum() / len(names)
    found = np.linalg.solve(a, x.T @ (w * y))
    return {(target, p): (found[k], found[-1]) for k, p in enumerate(names)}


def test_lineup_ratings_equal_a_dense_solve(spark):
    rows = stints()
    got = {(r.season, r.player): (r.rating, r.home_advantage) for r in ridge.lineup_ratings(spark.createDataFrame(rows, STINTS), "season").collect()}
    want = {k: v for season in (2001, 2002, 2003) for k, v in dense(rows, season).items()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_steps_over_tables_equal_steps_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(ridge, "MOST_CELLS", 0)
    rows = [r for r in stints(players=6) if r[0] < 2002]
    got = {(r.season, r.player): r.rating for r in ridge.lineup_ratings(spark.createDataFrame(rows, STINTS), "season", l2=5.0).collect()}
    want = dense(rows, 2001, 5.0)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k][0], abs=1e-5) for k in want)


def test_late_results_change_later_ratings_only(spark):
    games = spark.createDataFrame([(1, 10, 10, 1, 1, 2), (1, 11, 11, 2, 1, 3), (1, 14, 14, 3, 1, 2), (1, 20, 20, 4, 1, 2)], "season int, cutoff long, ended long, game_id long, team int, opp int")
    on_time, late = [(1, 10, True), (2, 11, True)], [(1, 12, True), (1, 9, False), (2, 11, True)]
    rated = lambda s: {r.game_id: r.team_rating for r in folds.resolved_elo(games, spark.createDataFrame(s, "game_id long, taken long, won boolean")).collect()}
    a, b = rated(on_time), rated(late)
    assert a[2] > 1500 and b[2] == 1500  # the snapshot before the end tells nothing, the late one comes after game 2
    assert a[1] == b[1] == 1500 and b[3] > 1510 and a[4] == a[3] and b[4] == b[3]  # games 3 and 4 are never resolved


def test_season_pass_equals_a_loop_over_games(spark):
    """Each team's games replayed one date at a time: what a date's games know is what was recorded before it."""
    from collections import defaultdict
    from itertools import groupby

    from priorline.plans import season_pass, views

    sf = "/root/testdata/sf0.001"
    lines = defaultdict(list)
    for r in views.lines(spark, sf).collect():
        lines[r.game_id, r.player % 2].append((r.player, r.minutes))
    found = {(r.game_id, r.team): r for r in season_pass.season_pass(spark, sf).collect()}
    rows = sorted(views.team_games(spark, sf).collect(), key=lambda r: (r.season, r.team, r.game_date, r.game_id))
    assert len(found) == len(rows) > 1000
    for _, team in groupby(rows, key=lambda r: (r.season, r.team)):
        past = []
        for day, games in groupby(team, key=lambda r: r.game_date):
            games = list(games)
            ten, week = past[-10:], [g for g in past if 1 <= (day - g.game_date).days <= 7]
            last = lines[past[-1].game_id, past[-1].is_away] if past else []
            minutes = sum(m for _, m in last)
            window = {p for g in past[-11:-1] for p, _ in lines[g.game_id, g.is_away]}
            earlier = {p for p, _ in lines[past[-2].game_id, past[-2].is_away]} if len(past) > 1 else set()
            for g in games:
                r = found[g.game_id, g.team]
                assert (r.games_7d, r.road_7d) == (len(week), sum(x.is_away for x in week))
                assert r.rest_days == ((day - past[-1].game_date).days - 1 if past else 0)
                assert r.back_to_back == bool(past and (day - past[-1].game_date).days == 1)
                assert r.roster == pytest.approx(sum(m for p, m in last if p in window) / minutes if len(past) > 1 and minutes else 1.0, abs=1e-6)
                assert r.lineup == pytest.approx(len({p for p, _ in last} & earlier) / len(last) if len(past) > 1 and last else 1.0, abs=1e-6)
                assert r.net == pytest.approx(sum(x.pf - x.pa for x in ten) * 100 / sum(x.pf + x.pa for x in ten) if ten else 0.0, abs=1e-6)
                assert r.player_value == pytest.approx(sum(m * (p * 37 % 200 - 100) / 10 for p, m in last) / minutes if minutes else 0.0, abs=1e-6)
                assert r.strength == pytest.approx(sum(1400 + x.opp * 37 % 200 for x in ten) / len(ten) if ten else 1500.0, abs=1e-6)
            past += games
