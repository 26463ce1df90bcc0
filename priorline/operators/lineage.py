"""Lineage of artifacts: each names the digests of its inputs, and all that it was made from is followed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.session import materialize

#: Steps from an artifact to its farthest input.
DEEPEST = 100


def checked_edges(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` (path, input_path, input_digest) with verdict: ok, changed (the input has another digest now) or missing.
    artifacts: path, digest, one row a path."""
    now = artifacts.select(F.col("path").alias("input_path"), F.col("digest").alias("_now"))
    verdict = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("input_digest"), "changed").otherwise("ok")
    return edges.join(now, "input_path", "left").select("path", "input_path", verdict.alias("verdict"))


def prove(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Per artifact inputs (how many others it was made from), depth, and broken: the nearest edge on the way that doesn't
    hold, as 'path input verdict', null where all do. A step goes one edge further for all artifacts at once, and a pair
    of artifact and input is followed once a depth; a chain longer than DEEPEST, as a circle makes one, is an error."""
    links = materialize(checked_edges(artifacts, edges), "edges")
    front = artifacts.select(F.col("path").alias("root"), "path").withColumn("depth", F.lit(0))
    steps = [front]
    for depth in range(1, DEEPEST + 2):
        front = front.join(links.select("path", "input_path"), "path").select("root", F.col("input_path").alias("path")).distinct().withColumn("depth", F.lit(depth))
        front = materialize(front, "reach")
        if front.isEmpty():
            break
        steps.append(front)
    else:
        raise ValueError("an artifact was made from itself, or from a longer chain than can be followed")
    reach = steps[0]
    for step in steps[1:]:
        reach = reach.unionByName(step)
    wrong = F.when(F.col("verdict") != "ok", F.concat(F.lpad(F.col("depth").cast("string"), 6, "0"), F.lit(" "), F.concat_ws(" ", "path", "input_path", "verdict")))
    told = reach.join(links, "path", "left")
    return told.groupBy(F.col("root").alias("path")).agg((F.count_distinct("path") - 1).alias("inputs"), F.max("depth").alias("depth"), F.substring(F.min(wrong), 8, 1000).alias("broken"))
