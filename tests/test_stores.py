"""Publications, ledgers, lineage, archives and timers over several batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from priorline.operators import asof, ledger, lineage
from priorline.sources import archive, files, store
from priorline.streaming import timers


@pytest.fixture
def numbers(spark):
    return spark.range(20).select("id", (F.col("id") % 3).alias("k"))


# Publications.


def test_a_publication_that_dies_leaves_the_old_version(spark, numbers, tmp_path):
    root = f"file://{tmp_path}/p"
    assert store.current_version(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        store.published(spark, root, "a")
    assert store.publish(spark, root, {"a": numbers, "b": numbers.limit(3)}, 0) == 1
    dying = numbers.withColumn("x", F.raise_error(F.lit("dead")))
    with pytest.raises(Exception, match="dead"):
        store.publish(spark, root, {"a": numbers.limit(1), "b": dying}, 1)
    assert store.current_version(spark, root) == 1
    assert store.published(spark, root, "a", verify=True).count() == 20 and store.published(spark, root, "b").count() == 3
    with pytest.raises(ValueError, match="current"):
        store.publish(spark, root, {"a": numbers}, 0)
    assert store.publish(spark, root, {"a": numbers.limit(5)}, 1) == 3  # 2 is the dead one's
    assert store.published(spark, root, "a").count() == 5 and store.published(spark, root, "a", version=1).count() == 20


def test_what_was_changed_since_is_told(spark, numbers, tmp_path):
    root = f"file://{tmp_path}/p"
    store.publish(spark, root, {"a": numbers}, 0)
    numbers.limit(19).write.mode("overwrite").parquet(f"{root}/versions/00000001/a")
    with pytest.raises(ValueError, match="isn't what was published"):
        store.published(spark, root, "a", verify=True)


def test_a_name_is_created_once(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.create("x/a.json", "one")
    with pytest.raises(FileExistsError):
        s.create("x/a.json", "two")
    s.claim("c/1")
    with pytest.raises(Exception):
        s.claim("c/1")
    assert s.text("x/a.json") == "one" and s.names("x") == ["a.json"] and s.names("none") == []


# Ledgers.


def body():
    return F.concat_ws("|", F.col("id").cast("string"), F.col("k").cast("string"))


def test_appends_equal_one_chain(spark, numbers, tmp_path):
    stored = ledger.StoredChain(spark, f"file://{tmp_path}/l", "k")
    assert stored.head == ledger.GENESIS and stored.heads() is None
    first = stored.append(numbers.where("id < 7"), "one", ["id"], body(), expected=ledger.GENESIS)
    heads = stored.heads().where("k = 1").select("k", "event_hash")
    second = stored.append(numbers.where("id >= 7"), "two", ["id"], body(), expected=first, expected_heads=heads)
    links = lambda df: sorted(tuple(r) for r in df.select("k", "event", "seq", "body_hash", "prev_hash", "event_hash").collect())
    assert links(stored.links()) == links(ledger.chain(numbers, "k", ["id"], body()))
    assert {r.k: r.event_hash for r in stored.heads().collect()} == {r.k: r.head for r in ledger.audit(stored.links(), "k").collect()}
    # Again, stale, and stale for one key.
    assert stored.append(numbers.where("id >= 7"), "two", ["id"], body()) == second and stored.links().count() == 20
    with pytest.raises(ledger.StaleHead):
        stored.append(numbers, "three", ["id"], body(), expected=first)
    with pytest.raises(ledger.StaleHead):
        stored.append(numbers, "three", ["id"], body(), expected_heads=heads)
    assert stored.head == second and stored.links().count() == 20


def test_a_torn_tail_is_cut_and_logged(spark, numbers, tmp_path):
    path = f"file://{tmp_path}/l"
    stored = ledger.StoredChain(spark, path, "k")
    stored.append(numbers.where("id < 7"), "one", ["id"], body())
    numbers.write.parquet(f"{path}/links/00000002")  # links without a commit
    assert stored.links().count() == 7
    stored.append(numbers.where("id >= 7"), "two", ["id"], body())
    assert stored.links().count() == 20
    cuts = [json.loads(stored.store.text(f"cuts/{n}")) for n in stored.store.names("cuts")]
    assert [c["folder"] for c in cuts] == ["links/00000002"] and len(cuts[0]["digest"]) == 64


# Lineage.


def test_the_first_broken_edge_is_named(spark):
    artifacts = spark.createDataFrame([("raw", "d0"), ("clean", "d1"), ("model", "d2"), ("report", "d3")], "path string, digest string")
    edges = [("clean", "raw", "d0"), ("model", "clean", "OLD"), ("report", "model", "d2"), ("report", "raw", "d0"), ("report", "gone", "d9")]
    got = {r.path: (r.inputs, r.depth, r.broken) for r in lineage.prove(artifacts, spark.createDataFrame(edges, "path string, input_path string, input_digest string")).collect()}
    assert got == {"raw": (0, 0, None), "clean": (1, 1, None), "model": (2, 2, "model clean changed"), "report": (4, 3, "report gone missing")}


def test_a_circle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(lineage, "DEEPEST", 5)
    artifacts = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, digest string")
    with pytest.raises(ValueError):
        lineage.prove(artifacts, spark.createDataFrame([("a", "b", "2"), ("b", "a", "1")], "path string, input_path string, input_digest string"))


# Archives.


def folder(root, day, slot, rows):
    os.makedirs(f"{root}/day={day}/slot={slot}", exist_ok=True)
    with open(f"{root}/day={day}/slot={slot}/part-0.json", "w") as f:
        f.writelines(json.dumps({"at": a, "minutes_": m}) + "\n" for a, m in rows)


def test_archive_reads_the_days_asked_for_and_streams_new_folders(spark, tmp_path):
    root = f"{tmp_path}/archive"
    folder(root, "2024-01-01", 0, [(1, 10), (2, 20)])
    folder(root, "2024-01-01", 2, [(3, 30)])
    folder(root, "2024-01-02", 0, [(4, 40)])
    spark.dataSource.register(archive.SnapshotArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("snapshot_archive").load(root)
    assert sorted(tuple(r) for r in df.select("at", "minutes_", "day", "slot").collect()) == [(1, 10, "2024-01-01", 0), (2, 20, "2024-01-01", 0), (3, 30, "2024-01-01", 2), (4, 40, "2024-01-02", 0)]
    asked = df.where("day = '2024-01-02' and minutes_ > 5")
    plan = asked._jdf.queryExecution().explainString(asked._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert [r["at"] for r in asked.collect()] == [4] and "2024-01-02" in plan.split("PushedFilters")[1].split("]")[0]
    assert df.where("day > '2030-01-01'").count() == 0
    base, seen = f"file://{tmp_path}/stream", []

    def run():
        stream = spark.readStream.format("snapshot_archive").load(root)
        query = stream.writeStream.foreachBatch(lambda b, n: seen.append((n, sorted(r["at"] for r in b.collect())))).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    folder(root, "2024-01-02", 3, [(5, 50)])
    run()  # a new start goes on behind the last folder
    run()
    assert [x for _, x in seen if x] == [[1, 2, 3, 4], [5]]


# Timers.


def test_timers_fire_by_the_watermark_and_state_goes(spark, tmp_path):
    hour, start = 3_600_000, 100 * 3_600_000
    at = lambda h: start + int(h * hour)
    schema = "key long, poll_id long, ts timestamp, polled long, starts long"
    source = f"{tmp_path}/in"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    fired = []

    def batch(rows):
        df = spark.createDataFrame([(k, i, at(h), None if s is None else at(s)) for k, i, h, s in rows], "key long, poll_id long, polled long, starts long")
        df.select("key", "poll_id", F.timestamp_millis("polled").alias("ts"), "polled", "starts").coalesce(1).write.mode("append").parquet(source)
        polls = spark.readStream.schema(schema).parquet(source)
        query = timers.timed_captures(polls, {"key": "long"}, "0 seconds").writeStream
        query = query.foreachBatch(lambda b, n: fired.extend((r.key, r.timer, r.poll_id) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    try:
        batch([(1, 1, 0, 10), (2, 2, 0, 10), (3, 3, 0, 10), (3, 4, 1, None)])  # event 3 is withdrawn
        assert fired == []
        batch([(1, 5, 3, 10), (2, 6, 4.5, 11)])  # event 2 moves by an hour; the watermark passes 10 - 6
        assert fired == [(1, "T-6h", 5)]
        batch([(9, 7, 10.5, 99)])  # nobody polls 1 and 2 any more: their timers fire all the same
        assert sorted(fired[1:]) == [(1, "T-15", 5), (1, "T-60", 5), (2, "T-60", 6), (2, "T-6h", 6)]
        last = batch([(9, 8, 12, 99)])
        assert fired[-1] == (2, "T-15", 6) and len(fired) == 6
        rows = [p.stateOperators[0].numRowsTotal for p in last.recentProgress if p.stateOperators]
        assert rows[-1] <= 6  # one event and its timers: those of past events are gone
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


# As-of joins with nulls, strict objects.


def test_asof_rows_with_null_keys_or_times_match_nothing(spark):
    left = spark.createDataFrame([(1, "a", 30), (2, None, 30), (3, "a", None), (4, None, None), (5, "b", 30)], "id int, k string, h long")
    right = spark.createDataFrame([("a", 2, 10), (None, 29, 11), (None, 2, 12), ("a", None, 13), ("a", 29, 14), ("a", 31, 15)], "k string, h long, v int")
    timed = lambda df, name: df.withColumn(name, F.timestamp_micros(F.col("h") * 3_600_000_000)).drop("h")
    out = asof.asof_join(timed(left, "t"), timed(right, "s"), by=["k"], left_time="t", right_time="s", take=["v"], tie=["v"])
    assert {r.id: r.v for r in out.collect()} == {1: 14, 2: None, 3: None, 4: None, 5: None}


@pytest.mark.parametrize(
    "line, verdict",
    [
        ('{"name":"x","value":1} trailing', "no object"), ('{"name":"x","value":1}{"b":2}', "no object"), ('{"name":"x","value":1},{"a":1}', "no object"), ("[1]", "no object"), ("", "no object"), (None, "no object"),
        ('{"name":"rate: NaN","value":1}', "ok"), ('{"name":"{\\"a\\":1,\\"a\\":2","value":1.5}', "ok"), (' {"name":"x","value":-2} ', "ok"),
        ('{"name":"x","value":NaN}', "not finite"), ('{"name":"x","value":1e400}', "not finite"), ('{"name":"x","value":{"name":1}}', "wrong type"), ('{"name":1,"value":1}', "wrong type"),
        ('{"name":"x","name":"y","value":1}', "repeated key"), ('{"name":"x","\\u006eame":"y","value":1}', "repeated key"), ('{"name":"x","value":[{"b":1,"b":2}]}', "repeated key"), ('{"name":"x","valu":1}', "other keys"),
    ],
)
def test_strict_objects(spark, line, verdict):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(files.strict_verdict(F.col("line"), {"name": "string", "value": "number"})).head()[0] == verdict



def test_steps_go_with_their_block(spark, tmp_path):
    from pathlib import Path

    from priorline.session import materialize, steps

    there = lambda df: all(Path(x.removeprefix("file://")).exists() for x in files[df])
    files = {}

    def written(n, **more):
        df = materialize(spark.range(n), "kept", **more)
        files[df] = df.inputFiles()
        return df

    with steps(spark):
        outer = written(3)
        with steps(spark):
            inner, handed = written(4), written(5, outlives=True)
        assert not there(inner) and there(handed) and there(outer) and handed.count() == 5
        last = written(6, outlives=True)
    assert not there(outer) and not there(handed) and there(last) and last.count() == 6
    with pytest.raises(ZeroDivisionError):
        with steps(spark):
            lost = written(2)
            raise ZeroDivisionError
    assert not there(lost)
    assert there(written(1))
