"""Ledgers that are appended to, tables published together, packs of snapshots, archives as sources and timers in state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.operators import ledger
from priorline.plans import views
from priorline.plans.checks import _CHAIN_SQL
from priorline.plans.records import _new_path
from priorline.plans.registry import Registry
from priorline.sources import archive, packs, store
from priorline.streaming import pending, timers

STORES = Registry()
query = STORES.query


@query("select user_id, count(*) links, 0::bigint breaks, max_by(h, seq) head from chain group by 1", _CHAIN_SQL)
def ledger_appends(spark, sf_dir):
    """Chains of users' events appended in three batches, each behind the head that it expects, the second one twice: the
    audit finds the chains that one append would have made."""
    e = views.table(spark, sf_dir, "events")
    body = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    stored, bounds = ledger.StoredChain(spark, _new_path(spark, "ledger"), "user_id"), ("2024-01-11", "2024-01-21")
    head = ledger.GENESIS
    for name, rows in (("first", e.where(F.col("ts") < bounds[0])), ("second", e.where((F.col("ts") >= bounds[0]) & (F.col("ts") < bounds[1]))), ("third", e.where(F.col("ts") >= bounds[1]))):
        head = stored.append(rows, name, ["ts", "event_id"], body, expected=head)
        if name == "second":
            head = stored.append(rows, name, ["ts", "event_id"], body)
    return ledger.audit(stored.links(), "user_id")


@query("select case when season < 2000 then 'train' else 'test' end part, season, count(*) n, sum(hs - as_)::bigint margin from games group by 1, 2")
def published_parts(spark, sf_dir):
    """Two tables published together twice; what the second version holds is read back and held against its manifest."""
    root = _new_path(spark, "published")
    g = views.games(spark, sf_dir)
    parts = {"train": g.where("season < 2000"), "test": g.where("season >= 2000")}
    first = store.publish(spark, root, {name: df.where("game_id % 2 = 0") for name, df in parts.items()}, 0)
    store.publish(spark, root, parts, first)
    both = [store.published(spark, root, name, verify=True).withColumn("part", F.lit(name)) for name in parts]
    return both[0].unionByName(both[1]).groupBy("part", "season").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hs") - F.col("as_")).alias("margin"))


_ARCHIVE = """select report_time::date::varchar as day, (hour(report_time) // 6)::int slot, count(*) n, sum((minutes * 100)::bigint)::bigint total from reports {} group by 1, 2"""


def _archive(spark, sf_dir) -> str:
    """Reports written as an archive; its folder."""
    path = _new_path(spark, "archive")
    r = views.reports(spark, sf_dir).select(F.unix_micros("report_time").alias("at"), F.round((F.col("minutes") * 100).cast("decimal(20,6)")).cast("long").alias("minutes_"), F.to_date("report_time").cast("string").alias("day"), F.floor(F.hour("report_time") / 6).cast("string").alias("slot"))
    r.repartition("day").write.partitionBy("day", "slot").json(path)
    spark.dataSource.register(archive.SnapshotArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return path


def _folders(df):
    return df.groupBy("day", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("minutes_").alias("total"))


@query(_ARCHIVE.format("where report_time::date between date '2024-01-05' and date '2024-01-12'"))
def archive_source(spark, sf_dir):
    """The archive read through its own source; the days asked for choose the folders that are opened."""
    return _folders(spark.read.format("snapshot_archive").load(_archive(spark, sf_dir)).where("day >= '2024-01-05' and day <= '2024-01-12'"))


@query(_ARCHIVE.format(""))
def archive_stream(spark, sf_dir):
    """The same archive as a stream of folders in order."""
    stream = spark.readStream.format("snapshot_archive").load(_archive(spark, sf_dir))
    return _folders(pending.run_available(stream, "archive_stream", "append"))


@query(
    """select user_id, ts::date as day, timer, max_by(event_id, (date_trunc('milliseconds', ts), event_id)) poll_id from events, (select unnest(['T-6h', 'T-60', 'T-15']) timer, unnest([360, 60, 15]) as ahead)
       where date_trunc('milliseconds', ts) <= ts::date + interval 20 hour - ahead * interval 1 minute and ts::date + interval 20 hour - ahead * interval 1 minute < (select max(ts) from events) - interval 10 minute group by 1, 2, 3"""
)
def stream_timers(spark, sf_dir):
    """Users' polls of an evening's start: timers before it fire by the watermark and capture the last poll there was."""
    schema = views.table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    evening = F.unix_millis(F.date_trunc("day", "ts")) + 20 * 3_600_000
    polls = s.select("user_id", F.to_date("ts").cast("string").alias("day"), F.col("event_id").alias("poll_id"), "ts", F.unix_millis("ts").alias("polled"), evening.alias("starts"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = pending.run_available(timers.timed_captures(polls, {"user_id": "long", "day": "string"}, shared=["day"]), "timers", "append")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out.select("user_id", F.col("day").cast("date").alias("day"), "timer", "poll_id")


#: Snapshots that never reach the pack, and those whose payload changes in it.
_LOST, _CHANGED = "event_id % 89 = 5", "event_id % 97 = 3"


def _evidence_pack(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each report a snapshot, in a pack that was tampered with, and the records that were bound to the snapshots as they
    came: one for each report, five hours after it, on that report and the one of the next number."""
    path, written = _new_path(spark, "pack"), _new_path(spark, "evidence")
    cents = F.round((F.col("minutes") * 100).cast("decimal(20,6)")).cast("long").cast("string")
    r = views.reports(spark, sf_dir).withColumn("body", F.concat_ws("|", F.col("event_id").cast("string"), "status", cents))
    r = r.select("event_id", F.concat(F.lit("team "), F.col("team").cast("string")).alias("source"), F.col("event_id").cast("string").alias("version"), F.col("report_time").alias("taken"), F.col("body").cast("binary").alias("payload"))
    packs.write_pack(r.where(f"not ({_LOST})"), path)
    # The tampered copy of the pack: the payload of some lines is replaced, their digests stay.
    tampered = _new_path(spark, "tampered-pack")
    line = F.col("value")
    number = F.get_json_object(line, "$.version").cast("long")
    other = F.regexp_replace(line, '"payload":"[^"]*"', '"payload":"b3RoZXI="')
    spark.read.text(path).select(F.when(number % 97 == 3, other).otherwise(line).alias("value")).write.text(tampered)
    own = r.select("event_id", F.struct("source", "version", F.sha2("payload", 256).alias("sha256")).alias("ref"), "taken")
    after = own.select((F.col("event_id") - 1).alias("event_id"), F.col("ref").alias("ref_2"))
    both = own.join(after, "event_id", "left")
    refs = F.filter(F.array("ref", "ref_2"), lambda x: x.isNotNull()).alias("evidence")
    packs.write_evidence(both.select("event_id", F.unix_micros(F.col("taken") + F.expr("interval 5 hours")).alias("cutoff_us"), refs), written)
    read = spark.read.schema("event_id long, cutoff_us long, evidence array<struct<source string, version string, sha256 string>>").json(written)
    return packs.read_pack(spark, tampered), read.withColumn("cutoff", F.timestamp_micros("cutoff_us"))


_VERDICT = "case when e.{lost} then 'missing snapshot' when e.{changed} then 'changed payload' when e.report_time > r.report_time + interval 5 hour then 'late snapshot' end"


@query(
    """select event_id, count(*) refs, string_agg(place || ' ' || violation, '; ' order by place) violations, coalesce(sum(case when violation is null then (minutes * 100)::bigint end), 0)::bigint total from bound group by 1""",
    f"""bound as (select r.event_id, p place, e.minutes, {_VERDICT.format(lost=_LOST, changed=_CHANGED)} violation from reports r, (select unnest([0, 1]) p) x join reports e on e.event_id = r.event_id + p)""",
)
def evidence_bundles(spark, sf_dir):
    """Records read back with their nested evidence, each reference held to the pack: missing, changed and late snapshots
    come out as violations of their own, what holds is read out of the payloads."""
    pack, records = _evidence_pack(spark, sf_dir)
    bound = packs.bind(records, pack, key="event_id", cutoff="cutoff")
    told = F.array_sort(F.collect_list(F.when(F.col("violation").isNotNull(), F.concat_ws(" ", F.col("place").cast("string"), "violation"))))
    total = F.coalesce(F.sum(packs.fields(F.col("payload"))[2].cast("long")), F.lit(0))
    out = bound.groupBy("event_id").agg(F.count(F.lit(1)).alias("refs"), told.alias("told"), total.cast("long").alias("total"))
    return out.select("event_id", "refs", F.when(F.size("told") > 0, F.array_join("told", "; ")).alias("violations"), "total")


_TAKEN = "game_date + interval 1 hour * (game_id % 5 - 1)"


@query(
    "select season, verdict, count(*) n, sum(hs - as_)::bigint margin from finals group by 1, 2",
    f"""finals as (select season, hs, as_, case when game_id % 41 = 2 then 'missing snapshot' when game_id % 43 = 1 then 'repeated version' when {_TAKEN} < game_date then 'early snapshot'
                           when game_id % 53 = 7 then 'other score' else 'ok' end verdict from games)""",
)
def bound_resolutions(spark, sf_dir):
    """Final scores bound to the snapshots that show them: one taken before the end can't, a version that stands twice
    decides nothing, and the payload has to show the recorded score."""
    path, end = _new_path(spark, "finals"), F.col("game_date").cast("timestamp")
    g = views.games(spark, sf_dir).select("season", "game_id", "hs", "as_", end.alias("ended"), (F.unix_micros(end) + (F.col("game_id") % 5 - 1) * 3_600_000_000).alias("us"))
    shown = F.concat_ws("|", F.col("hs").cast("string"), (F.col("as_") + F.when(F.col("game_id") % 53 == 7, 1).otherwise(0)).cast("string"))
    g = g.withColumns({"source": F.lit("finals"), "version": F.col("game_id").cast("string"), "payload": shown.cast("binary"), "taken": F.timestamp_micros("us")})
    copies = F.when(F.col("game_id") % 43 == 1, 2).otherwise(1)
    packs.write_pack(g.where("game_id % 41 <> 2").select("source", "version", "taken", "payload", F.explode(F.array_repeat(F.lit(0), copies)).alias("_")).drop("_"), path)
    refs = F.array(F.struct("source", "version", F.sha2("payload", 256).alias("sha256"))).alias("evidence")
    bound = packs.bind(g.select("game_id", "ended", refs), packs.read_pack(spark, path), key="game_id", cutoff="ended", after=True)
    score = packs.fields(F.col("payload"))
    same = (score[0].cast("int") == F.col("hs")) & (score[1].cast("int") == F.col("as_"))
    joined = g.select("game_id", "season", "hs", "as_").join(bound.select("game_id", "payload", "violation"), "game_id")
    verdict = F.coalesce("violation", F.when(same, "ok").otherwise("other score"))
    return joined.groupBy("season", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hs") - F.col("as_")).alias("margin"))
