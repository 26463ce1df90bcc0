"""Operators against hand-made rows, brute force and invariants; each query against its SQL."""

import datetime as dt
import hashlib
import math
import os
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from priorline.functions import calendar, geo, probability, text
from priorline.operators import asof, fits, folds, joins, ledger, rolling, scoring
from priorline.plans import catalogue
from priorline.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 2e-6 * max(1, abs(a))
    return str(a) == str(b) or (a in (None,) and b in (None,))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted(([r[k] for k in order] for r in cursor.fetchall()), key=lambda r: str([x for x in r if not isinstance(x, float)]))
    got = sorted(([x for x in r] for r in df.collect()), key=lambda r: str([x for x in r if not isinstance(x, float)]))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(map(same, a, b)), (a, b)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_scalars(spark):
    assert value(spark, probability.elo_probability(F.lit(1500.0), F.lit(1500.0), 60.0)) == pytest.approx(1 / (1 + 10 ** (-60 / 400)))
    assert value(spark, probability.implied_probability(F.lit(-150.0))) == pytest.approx(0.6)
    assert value(spark, probability.implied_probability(F.lit(-100.0))) == pytest.approx(0.5)
    assert value(spark, probability.sigmoid(F.lit(-800.0))) == 0.0
    assert value(spark, calendar.season(F.lit(dt.date(2024, 7, 1)))) == 2025
    assert value(spark, calendar.afternoon_clock(F.lit("07:30 (ET)"))) == 19 * 60 + 30
    assert value(spark, calendar.afternoon_clock(F.lit("12:05 (ET)"))) == 12 * 60 + 5
    assert value(spark, calendar.clock_seconds(F.lit("11:42"))) == 702
    assert value(spark, geo.great_circle_miles(F.lit(40.0), F.lit(-74.0), F.lit(40.0), F.lit(-74.0))) == 0
    assert value(spark, geo.great_circle_miles(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * geo.EARTH_MILES)
    assert value(spark, text.stated_probability(F.lit("probability 0.9 </think> Probability: 0.42"))) == 0.42
    assert value(spark, text.stated_probability(F.lit("none"))) is None


def test_person_keys_agree(spark):
    pairs = [("Collins, Zach", "Zach Collins"), ("Dončić, Luka", "Luka Doncic"), ("McConnell, T.J.", "TJ McConnell"), ("Trent Jr., Gary", "Gary Trent Jr.")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(text.person_key("a").alias("a"), text.person_key("b").alias("b")).collect()
    assert all(r.a == r.b for r in rows)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.floats(-5, 5)), min_size=2, max_size=5))
def test_bayes_posterior_sums_to_one(spark, pairs):
    total = sum(p for p, _ in pairs)
    post = value(spark, probability.bayes_update(F.array(*[F.lit(p / total) for p, _ in pairs]), F.array(*[F.lit(x) for _, x in pairs])))
    assert sum(post) == pytest.approx(1)


def test_asof_join_equals_brute_force(spark):
    rng = random.Random(1)
    base = dt.datetime(2024, 1, 1)
    right = [(rng.randrange(3), base + dt.timedelta(hours=rng.randrange(200)), k) for k in range(80)]
    left = [(k, rng.randrange(4), base + dt.timedelta(hours=rng.randrange(-5, 220))) for k in range(60)]
    r = spark.createDataFrame(right, "team int, seen timestamp, v int")
    l = spark.createDataFrame(left, "id int, team int, at timestamp")
    got = {x.id: x.v for x in asof.asof_join(l, r, by=["team"], left_time="at", right_time="seen", take=["v"], tie=["v"]).collect()}
    for k, team, at in left:
        best = max(((s, v) for t, s, v in right if t == team and s <= at), default=(None, None))
        assert got[k] == best[1]


def test_future_results_change_no_feature(spark):
    rows = [(2024, 1, dt.date(2024, 1, d), g, 0, (g * d) % 2, g - d) for d in (1, 1, 2, 5, 9, 9) for g in (d * 10, d * 10 + 1)]
    schema = "season int, team int, day date, game int, away int, won int, margin int"
    f = lambda data: {(r.game, r.n_last, r.win_rate, r.mean_margin) for r in rolling.form_features(spark.createDataFrame(data, schema), by=["season", "team"], day="day", order="game", won="won", margin="margin").collect() if r.game < 50}
    changed = [(s, t, d, g, a, 1 - w if g >= 50 else w, m + 100 if g >= 50 else m) for s, t, d, g, a, w, m in rows]
    assert f(rows) == f(changed)


def test_score_rollup_and_perfect_calibration(spark):
    rows = spark.createDataFrame([(1, 0.75, True)] * 3 + [(1, 0.75, False)], "season int, p double, won boolean")
    total = [r for r in scoring.score_summary(rows, ["season"]).collect() if r.season is None][0]
    assert (total.n, total.accuracy) == (4, 0.75)
    assert scoring.expected_calibration_error(scoring.reliability_bins(rows)).head().ece == pytest.approx(0)


def test_margin_elo_by_hand(spark):
    games = [(2020, dt.date(2020, 1, d), d, d % 4, (d + 1) % 4, 100 + d, 90 + 3 * d) for d in range(1, 12) if 100 + d != 90 + 3 * d]
    got = {r.game_id: r for r in folds.margin_elo(spark.createDataFrame(games, "season int, game_date date, game_id long, home int, away int, hs int, as_ int")).collect()}
    ratings = {}
    for _, _, g, h, a, hs, as_ in games:
        rh, ra = ratings.get(h, 1500.0), ratings.get(a, 1500.0)
        p = 1 / (1 + 10 ** (-(rh + 60 - ra) / 400))
        assert (got[g].home_rating, got[g].away_rating, got[g].home_p) == pytest.approx((rh, ra, p))
        lead = (rh + 60 - ra) * (1 if hs > as_ else -1)
        shift = 20 * math.log(abs(hs - as_) + 1) * 2.2 / (0.001 * lead + 2.2) * ((hs > as_) - p)
        ratings[h], ratings[a] = rh + shift, ra - shift


def test_batched_elo_holds_results_back(spark):
    rows = [(2020, 1, 3, 1, 0, 1, True), (2020, 2, 3, 2, 0, 1, True), (2020, 3, 4, 3, 0, 1, True)]
    got = {r.game_id: r for r in folds.batched_elo(spark.createDataFrame(rows, "season int, cutoff long, resolved_at long, game_id long, team int, opp int, won boolean")).collect()}
    assert got[1].team_rating == got[2].team_rating == 1500 and got[3].team_rating == pytest.approx(1520)


def test_kalman_recovers_a_constant(spark):
    rng = random.Random(3)
    rows = [(1, k, k, 8.0 + rng.gauss(0, 1), 50.0) for k in range(200)]
    last = max(folds.scalar_kalman(spark.createDataFrame(rows, "player long, day long, seq long, value double, weight double")).collect(), key=lambda r: r.seq)
    assert last.estimate == pytest.approx(8, abs=0.7)


def test_offset_logistic_is_the_optimum(spark):
    rng = random.Random(4)
    data = []
    for _ in range(3000):
        x, o = rng.gauss(0, 1), rng.gauss(0, 1)
        data.append((x, o, rng.random() < 1 / (1 + math.exp(-(o + 0.7 * x)))))
    w = fits.offset_logistic(spark.createDataFrame(data, "x double, o double, y boolean"), ["x"], "y", "o")["x"]
    assert w == pytest.approx(0.7, abs=0.12)
    slope = sum((1 / (1 + math.exp(-(o + w * x))) - y) * x for x, o, y in data) / len(data) + 0.01 * w
    assert abs(slope) < 1e-9


def test_bootstrap_is_seeded(spark):
    blocks = spark.createDataFrame([(2020, dt.date(2020, 1, 6 + 7 * k % 20), 0.1 * k - 0.3, 10) for k in range(8)], "season int, week date, total double, n long")
    a, b = (fits.block_bootstrap(blocks, "season", draws=500).collect() for _ in range(2))
    assert a == b and a[0].lower_bound < a[0].mean


def test_positional_join_and_notes(spark):
    l = spark.createDataFrame([(1, 10), (1, 12), (2, 20)], "k int, g int")
    r = spark.createDataFrame([(1, 5), (1, 4), (2, 1), (2, 2), (3, 9)], "k int, d int")
    found, notes = joins.positional_join(l, r, ["k"], ["g"], ["d"])
    assert sorted(map(tuple, found.collect())) == [(1, 10, 4), (1, 12, 5)]
    assert sorted(map(tuple, notes.collect())) == [(2, 1, 2), (3, 0, 1)]


def test_coverage(spark):
    found, extra = joins.cover(spark.createDataFrame([(1,), (2,)], "q int"), spark.createDataFrame([(1, 0.5), (9, 0.1)], "q int, p double"), "q", "p")
    assert {(r.q, r.failure) for r in found.collect()} == {(1, None), (2, "missing forecast")} and [r.q for r in extra.collect()] == [9]


def test_chain_audit_finds_a_change(spark):
    rows = spark.createDataFrame([(u, k, f"b{u}{k}") for u in (1, 2) for k in range(6)], "u long, k long, body string")
    links = ledger.chain(rows, "u", ["k"], F.col("body"))
    assert [r.breaks for r in ledger.audit(links, "u").collect()] == [0, 0]
    broken = links.withColumn("body_hash", F.when((F.col("u") == 2) & (F.col("seq") == 3), F.lit("0" * 64)).otherwise(F.col("body_hash")))
    assert {(r.u, r.breaks > 0) for r in ledger.audit(broken, "u").collect()} == {(1, False), (2, True)}
    head = hashlib.sha256(f"{ledger.GENESIS}|{hashlib.sha256(b'b10').hexdigest()}".encode()).hexdigest()
    assert links.where("u = 1 and seq = 0").head().event_hash == head


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    schema = StructType([StructField("x", IntegerType()), StructField("y", StringType())])
    assert [r.x for r in files.read_csv(spark, f"{tmp_path}/a.csv", schema, ["x"]).collect()] == [1, 2]
    (tmp_path / "a.jsonl").write_text('{"x": 1, "y": "a"}\n{"x": 1, "z": 2}\nno\n')
    got = files.read_jsonl(spark, f"{tmp_path}/a.jsonl", schema).collect()
    assert [r._violation for r in got] == [None, "other keys", "no object"]
    files.write_once(spark.range(2), f"{tmp_path}/out")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        files.write_once(spark.range(2), f"{tmp_path}/out")
    (tmp_path / "pin").mkdir()
    (tmp_path / "pin" / "f").write_text("x")
    pins = spark.createDataFrame([("f", hashlib.sha256(b"x").hexdigest()), ("g", "0")], "name string, sha256 string")
    assert [r.name for r in files.verified_files(spark, f"{tmp_path}/pin", pins).collect()] == ["g"]


def test_entry_without_llm():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(catalogue.QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("prior, logs, want", [([0.0, 1.0], [5.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [float("-inf"), 0.0], [0.0, 1.0]), ([0.25, 0.75], [float("inf")] * 2, [0.25, 0.75]), ([1.0, 0.0], [float("-inf"), 0.0], None)])
def test_bayes_update_where_priors_or_likelihoods_are_extreme(spark, prior, logs, want):
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert value(spark, probability.bayes_update(lit(prior), lit(logs))) == want


def test_logit_at_its_ends(spark):
    for p in (0.0, 1.0, 0.3):
        assert value(spark, probability.sigmoid(probability.logit(F.lit(p)))) == pytest.approx(p)


def test_entry_where_llm_cannot_be_imported(monkeypatch):
    import builtins

    import __spark_entry__

    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ModuleNotFoundError(name)) if name == "corpus_pipeline" else real(name, *a, **k))
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES) and set(__spark_entry__.oracle_sql()) == set(catalogue.ORACLE_SQL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_gate_takes_the_default_draws(spark):
    f = catalogue._relative(catalogue.views.forecasts(spark, SF))
    blocks = scoring.calendar_blocks(f, F.col("gain"), "season", "game_date")
    want = {r.season: round(r.lower_bound, 6) for r in fits.block_bootstrap(blocks, "season", draws=10_000).collect()}
    assert {r.season: r.lower_bound for r in catalogue.QUERIES["bootstrap_gate"](spark, SF).collect()} == pytest.approx(want, abs=1.1e-6)
