"""Packs of snapshots with their payloads, and records bound to the snapshots that they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorline.sources.files import struct, write_once

#: A line of a pack, its keys in order.
LINE = "payload string, sha256 string, source string, taken_us long, version string"
#: What a record says of a snapshot that it rests on.
REFERENCE = ("source", "version", "sha256")


def write_pack(snapshots: DataFrame, path: str) -> None:
    """Snapshots (source, version, taken, payload as binary) as a new folder of JSON lines: payloads in base64 beside their
    SHA-256. An existing folder is an error."""
    line = F.struct(
        F.regexp_replace(F.base64("payload"), r"\s", "").alias("payload"), F.sha2("payload", 256).alias("sha256"), "source", F.unix_micros("taken").alias("taken_us"), F.col("version").cast("string").alias("version")
    )
    write_once(snapshots.select(F.to_json(line).alias("value")), path, "text")


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """(source, version, sha256, taken, payload, violation): a row for each line. A line has exactly the keys of LINE, none of
    them null, base64 as it is written and a payload of its digest; a source's version stands once. The payload of a
    line that breaks this is null, its violation the first of: other keys, no value, no base64, changed payload, repeated version."""
    parsed = spark.read.text(path).select("value", F.from_json("value", struct(LINE)).alias("r"))
    names = struct(LINE).names
    keys = F.coalesce(F.array_sort(F.json_object_keys("value")) != F.array(*[F.lit(n) for n in names]), F.lit(True))
    line = parsed.select(keys.alias("_keys"), F.greatest(*[F.col(f"r.{n}").isNull() for n in names]).alias("_empty"), "r.*").withColumn("_bytes", F.try_to_binary("payload", F.lit("base64")))
    again = F.regexp_replace(F.base64("_bytes"), r"\s", "")
    versions = F.count(F.lit(1)).over(Window.partitionBy("source", "version"))
    violation = (
        F.when(F.col("_keys"), "other keys")
        .when(F.col("_empty"), "no value")
        .when(F.col("_bytes").isNull() | (again != F.col("payload")), "no base64")
        .when(F.sha2("_bytes", 256) != F.col("sha256"), "changed payload")
        .when(versions > 1, "repeated version")
    )
    out = line.withColumn("violation", violation)
    return out.select(*REFERENCE, F.timestamp_micros("taken_us").alias("taken"), F.when(F.col("violation").isNull(), F.col("_bytes")).alias("payload"), "violation")


def write_evidence(records: DataFrame, path: str) -> None:
    """Records with nested references, the array ``evidence``, as a new folder of JSON lines."""
    write_once(records, path, "json")


def bind(records: DataFrame, pack: DataFrame, *, key: str, cutoff: str, evidence: str = "evidence", after: bool = False) -> DataFrame:
    """(key, place, source, version, taken, payload, violation): a row for each reference of each record, with what it refers to.

    A reference is held to the pack by its source and version: missing snapshot where there is none (a null in either finds
    none), the pack's own violation where that has one, other payload where the digests differ, no time without cutoff or
    ``taken``. Evidence has to be taken at or before the cutoff, else it is a late snapshot; with ``after`` (results) at or
    after it, else an early one. The payload is null beside a violation. A record without references gives one row, with no
    evidence as its violation. ``key`` should name one record; records that share it share their rows."""
    refs = records.select(F.col(key), F.col(cutoff).alias("_cutoff"), F.posexplode_outer(evidence).alias("place", "_ref"))
    asked = refs.select(key, "_cutoff", "place", *[F.col(f"_ref.{c}").alias(c) for c in REFERENCE])
    # A version that repeats has a violation on each of its lines; one of them stands for all.
    known = pack.groupBy("source", "version").agg(F.min_by(F.struct(F.col("sha256").alias("found"), "taken", "payload", "violation"), F.struct("sha256", "taken")).alias("_of"))
    met = asked.join(known, ["source", "version"], "left")
    wrong_time = F.col("_of.taken") < F.col("_cutoff") if after else F.col("_of.taken") > F.col("_cutoff")
    violation = (
        F.when(F.col("place").isNull(), "no evidence")
        .when(F.col("_of").isNull(), "missing snapshot")
        .when(F.col("_of.violation").isNotNull(), F.col("_of.violation"))
        .when(~F.col("_of.found").eqNullSafe(F.col("sha256")), "other payload")
        .when(wrong_time.isNull(), "no time")
        .when(wrong_time, "early snapshot" if after else "late snapshot")
    )
    out = met.withColumn("_violation", violation)
    payload = F.when(F.col("_violation").isNull(), F.col("_of.payload"))
    return out.select(key, "place", "source", "version", F.col("_of.taken").alias("taken"), payload.alias("payload"), F.col("_violation").alias("violation"))


def fields(payload: Column) -> Column:
    """The parts of a payload that is text with bars between them."""
    return F.split(payload.cast("string"), r"\|")
