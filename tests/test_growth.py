"""Steps whose work once grew faster than their input: equal to a plain loop, and in a form that grows with it."""

import random

from pyspark.sql import functions as F

from priorline.operators import rolling

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_a_range_equal_a_loop_and_slide_over_nothing(spark):
    from priorline.plans import catalogue

    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), rng.randrange(40)) for k in range(200)]
    got = spark.createDataFrame(rows, "id int, team string, at long").select("id", rolling.count_between(["team"], F.col("at"), -7, -1).alias("n"))
    want = {k: sum(t == team and at - 7 <= a <= at - 1 for _, t, a in rows) for k, team, at in rows}
    assert {r.id: r.n for r in got.collect()} == want
    for name in ("tips_in_week", "tips_in_week_whole"):
        frames = plan(catalogue.QUERIES[name](spark, SF)).split("specifiedwindowframe(")[1:]
        assert frames and all("unboundedpreceding" in x.split(",")[1] for x in frames)


def test_events_that_share_a_start_are_one_group_of_state(spark, tmp_path):
    """As groups and each alone, in two batches: the same captures, of withdrawn and moved events too."""
    from priorline.streaming import timers

    hour, rng = 3_600_000, random.Random(7)
    # Starts move by a poll, and a few polls withdraw the event.
    rows = [(rng.choice([2**60 + 1, 2, 3, 4, 5, 6, 7, 8]), f"day {d}", 100 * d + k, d * 24 * hour + rng.randrange(9, 20) * hour, None if rng.random() < 0.1 else (d * 24 + rng.choice([20, 20, 20, 21])) * hour) for d in range(3) for k in range(40)]
    rows.append((0, "the end", 999, 10 * 24 * hour, 99 * 24 * hour))
    df = spark.createDataFrame(rows, "user_id long, day string, poll_id long, polled long, starts long").withColumn("ts", F.timestamp_millis("polled"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        fired = []
        for shared in (None, ["day"]):
            got, source = [], f"{tmp_path}/{'groups' if shared else 'alone'}"
            for part in ("polled < 120000000", "polled >= 120000000"):
                df.where(part).coalesce(1).write.mode("append").parquet(source)
                stream = timers.timed_captures(spark.readStream.schema(df.schema).parquet(source), {"user_id": "long", "day": "string"}, shared=shared, buckets=2)
                query = stream.writeStream.foreachBatch(lambda b, n, got=got: got.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{source}-state").outputMode("append").trigger(availableNow=True).start()
                query.awaitTermination()
            fired.append(sorted(got, key=str))
        assert len(fired[0]) > 20 and fired[0] == fired[1]
        assert 2**60 + 1 in {r[0] for r in fired[1]}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_plays_are_derived_once(spark):
    """What the events are derived from is read once, however many steps follow."""
    from priorline.operators import playbyplay
    from priorline.plans import catalogue

    seen = spark.sparkContext.accumulator(0)

    def derive(batches, seen=seen):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "game_id long, num long, kind int, period int, clock string, home_text string, away_text string, score string, p1 long, t1 string, p2 long, t2 string, p3 long, t3 string"
    rows = [(1, k, 1, 1, "10:00", "x" if k % 2 else "", "" if k % 2 else "x", "", 1 + k, "H" if k % 2 else "A", 0, "", 0, "") for k in range(12)]
    events = spark.createDataFrame(rows, schema).mapInArrow(derive, schema)
    playbyplay.lines_and_stints(events).collect()
    assert seen.value == 12
    got = {r.reason: r.games for r in catalogue.QUERIES["lineup_rejects"](spark, SF).collect()}
    assert sum(got.values()) == catalogue.QUERIES["lineup_stints"](spark, SF).select("game_id").distinct().count()


def test_rotations_compare_no_player_with_all_lines(spark):
    """Ten games' lines aren't searched once for each of their players: a player's own lines lie together."""
    from priorline.plans import catalogue

    told = plan(catalogue.QUERIES["projected_rotation"](spark, SF))
    assert "array_distinct" not in told and "flatten" not in told


def test_ratings_fold_pairs_of_a_cutoff_not_games(spark, monkeypatch):
    """Equal to a replay game by game, whatever the number of games; the fold reads a row for each pair and moment."""
    from priorline.operators import folds
    from priorline.plans import catalogue

    rng = random.Random(9)
    rows = [(1 + k % 2, day := rng.randrange(6), rng.choice([day + 1, day + 1, day + 3, None]), k, t := rng.randrange(3), (t + 1) % 3, rng.random() < 0.6) for k in range(600)]
    read, plain = [], folds.ordered_fold
    monkeypatch.setattr(folds, "ordered_fold", lambda df, **named: (read.append(df.count()), plain(df, **named))[1])
    got = {r.game_id: (r.team_rating, r.opp_rating, r.team_p) for r in folds.batched_elo(spark.createDataFrame(rows, "season int, cutoff long, resolved_at long, game_id long, team int, opp int, won boolean")).collect()}
    assert read == [len({r[:3] + r[4:6] for r in rows})] and read[0] < len(rows) / 2
    for season in (1, 2):
        ratings, pending = {}, []
        for day in range(6):
            for x in [x for x in pending if x[0] <= day]:
                pending.remove(x)
                ratings[x[1]] = ratings.get(x[1], 1500.0) + x[3]
                ratings[x[2]] = ratings.get(x[2], 1500.0) - x[3]
            for _, _, known, game, team, opp, won in [r for r in rows if r[:2] == (season, day)]:
                a, b = ratings.get(team, 1500.0), ratings.get(opp, 1500.0)
                p = 1 / (1 + 10 ** ((b - a) / 400))
                assert all(abs(x - y) < 1e-7 for x, y in zip(got.pop(game), (a, b, p), strict=True))
                if known is not None:
                    pending.append((known, team, opp, 20 * (won - p)))
    assert not got
    told = plan(catalogue.QUERIES["elo_on_resolution"](spark, SF))
    assert "Generate" not in told and "min_by" not in told  # no table of snapshots is made and grouped


def test_rows_seen_ahead_equal_a_loop_and_are_not_multiplied(spark):
    """Moments around the ends of buckets, equal ones, a hot key, null keys and times; rows only go to the buckets they are seen from."""
    from priorline.operators import asof

    rng, hour = random.Random(3), 3600
    rows = [(k, rng.choice([1, 1, 1, 2, None]), None if rng.random() < 0.05 else 24 * hour * rng.randrange(3) + rng.choice([0, 1, 5 * hour, 6 * hour, 20 * hour, 24 * hour - 1]), rng.choice(["a", None])) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, key int, s long, v string").select("id", "key", "v", F.timestamp_seconds("s").alias("at"), "s")
    ahead = {"now": 0, "later": 6 * hour, "last": 30 * hour}
    found = asof.asof_ahead(df, by=["key"], time="at", ahead=ahead, take=["id", "v"], tie=["id"])
    assert "Union" in plan(found) and "Join" not in plan(found)
    got = {r.id: r for r in found.collect()}
    assert len(got) == len(rows)
    for k, key, s, _ in rows:
        for name, more in ahead.items():
            seen = [(t, i, v) for i, other, t, v in rows if None not in (key, s, t) and other == key and t <= s + more]
            assert (tuple(got[k][name]) if got[k][name] else None) == (max(seen)[1:] if seen else None)


def test_fits_by_key_aggregate_numbers_alone(spark, monkeypatch):
    """An array among the aggregates would have every pass sort all rows."""
    from priorline.operators import fits

    plans, plain = [], fits.materialize
    monkeypatch.setattr(fits, "materialize", lambda df, *a, **named: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, *a, **named))[1])
    rng = random.Random(2)
    df = spark.createDataFrame([(k % 2, rng.random(), rng.random() < 0.5) for k in range(80)], "key int, x double, won boolean")
    assert fits.offset_logistic_by(df, ["key"], ["x"], "won").count() == 2
    assert len(plans) > 2 and not any("SortAggregate" in x for x in plans)


def test_windows_of_features_run_over_dates(spark):
    """Equal to a loop with many games a date, few and none before; rows go into no window, but each date's last ones."""
    from datetime import date, timedelta

    from priorline.operators import rolling
    from priorline.plans import catalogue

    rng, start = random.Random(4), date(2024, 1, 1)
    rows = [(rng.choice("ab"), start + timedelta(days=rng.choice([0, 1, 1, 2, 5, 9, 20])), k, rng.randrange(2), rng.randrange(2), rng.randrange(-9, 9)) for k in range(120)]
    df = spark.createDataFrame(rows, "team string, day date, game int, away int, won int, margin int")
    load = rolling.load_features(df, by=["team"], day="day", away="away")
    form = rolling.form_features(df, by=["team"], day="day", order="game", won="won", margin="margin")
    got = {r.game: r for r in load.join(form.select("game", "n_last", "win_rate", "mean_margin"), "game").collect()}
    assert len(got) == len(rows)
    for team, day, game, *_ in rows:
        before = sorted((d, g, a, w, m) for t, d, g, a, w, m in rows if t == team and d < day)
        gap, week, ten = (day - before[-1][0]).days if before else None, [x for x in before if (day - x[0]).days <= 7], before[-10:]
        r = got[game]
        assert (r.rest_days, r.back_to_back, r.games_7d, r.road_7d, r.n_last) == ((gap or 1) - 1, gap == 1, len(week), sum(x[2] for x in week), len(ten))
        want = (sum(x[3] for x in ten) / len(ten), sum(x[4] for x in ten) / len(ten)) if ten else (0.5, 0.0)
        assert all(abs(a - b) < 1e-12 for a, b in zip((r.win_rate, r.mean_margin), want, strict=True))
    nobody = rolling.load_features(df.withColumn("team", F.lit(None).cast("string")), by=["team"], day="day", away="away")
    assert nobody.count() == len(rows)
    shown = plan(form)
    assert "WindowGroupLimit" in shown
    told = plan(load)
    assert told.index("Window") < told.index("Aggregate")  # windows stand on the counts of dates
    assert "Window" not in plan(catalogue.QUERIES["side_features"](spark, SF))  # games meet a written table of dates


def test_repair_looks_up_the_words_of_megabytes_together():
    """A word that is all over some megabytes of texts is looked up once, and no pair reaches over an end id."""
    import numpy as np
    import pyarrow as pa

    from priorline.llm import repair_ids
    from priorline.llm.common import pieces

    assert len(list(pieces(pa.array(["word " * 1000] * 1000), repair_ids.AT_ONCE))) == 1
    for ids in ([1], [1, 1, 1], [5, 5] * 30 + [1], [1] + [7] * 50 + [1], [3, 1] * 40):
        starts = np.r_[0, np.flatnonzero(np.array(ids) == 1)[:-1] + 1]
        block = repair_ids.Block(repair_ids.compress(np.array(ids, "<u2"), starts))
        assert block.ids().tolist() == ids and sum((block.document(k).tolist() for k in range(len(block))), []) == ids
