"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text's k-mers are runs of K words, a k-mer's inner substrings its runs of S words. A k-mer is an anchor
(a closed syncmer) where the substring with the least hash is its first or last; that depends on the
k-mer alone, so an edit moves no anchor but those it touches. All anchors come out in the order of the
text: 64-bit hashes of their contents, and the place of their first word (0 upwards). The fingerprint
holds the low 32 bits of the hashes, each once, as hexadecimal digits in ascending order; the likeness of
two texts is the Jaccard likeness of their whole sets of anchor hashes.

Words are runs of characters other than ASCII white space. A text of fewer than K words has one anchor,
the whole of it, at place 0.

Defined cases: null text is empty; a text without words has no anchor and an empty fingerprint, alike 1 to another
empty one and 0 to all others; equal texts have equal fingerprints; rows that repeat a doc_id are ordered
by text, null ids come last; the next document of the last is the first, of an only one itself; texts
count whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import range_bucket
from priorline.session import materialize

K, S = 5, 2
#: The most hashes of a fingerprint: no bound.
SKETCH = None
WHITE, CUT = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"
LOW = 0xFFFFFFFF
#: Ranges of doc_id: so many for each shuffle partition, and more where one would hold more bytes of text.
RANGES_A_PARTITION, RANGE_BYTES = 4, 64_000_000


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the anchors of column ``text``: their hashes (``name``) and places (``name``_at). Each step
    is a column of its own, so that no lambda computes an array anew for each element."""
    words, inner, starts, closed = f"_{name}_words", f"_{name}_inner", f"_{name}_n", f"_{name}_closed"
    trimmed = F.btrim(F.col(text), F.lit(WHITE))
    out = df.withColumn(words, F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, CUT), lambda w: F.xxhash64(w))))
    out = out.withColumn(starts, F.size(words) - (K - 1))
    pair = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn(inner, F.when(F.col(starts) > 0, pair))
    places = F.sequence(F.lit(0), F.greatest(F.col(starts), F.lit(1)) - 1).alias("at")
    shifted = F.arrays_zip(*[F.slice(inner, i + 1, F.col(starts)).alias(f"s{i}") for i in range(K - S + 1)], places)
    out = out.withColumn(closed, F.filter(shifted, lambda x: F.least(x["s0"], x["s3"]) <= F.least(x["s1"], x["s2"])))
    hashes = F.transform(closed, lambda x: F.xxhash64(x["s0"], x["s2"], x["s3"]))
    none = F.size(words) == 0
    short = F.when(none, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(F.col(words).cast("array<string>"), " "))))
    short_at = F.when(none, F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    long = F.col(starts) > 0
    return out.withColumns({name: F.when(long, hashes).otherwise(short), f"{name}_at": F.when(long, F.col(closed)["at"]).otherwise(short_at)}).drop(words, inner, starts, closed)


def as_text(hashes: Column) -> Column:
    low = F.sort_array(F.array_distinct(F.transform(hashes, lambda x: x.bitwiseAND(F.lit(LOW)))))
    return F.array_join(F.transform(low, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Of the different anchor hashes of both texts, the share that both have."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, anchors and anchors_at of each document."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = with_anchors(base, "text", "anchors")
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), as_text(F.col("anchors")).alias("fingerprint"), "anchors", "anchors_at")


def _successors(base: DataFrame) -> DataFrame:
    """For each range of doc_ids the text that follows its last document: the first one of the next lower
    range that has any, after the lowest that of the highest. One row for each range."""
    tops = materialize(base.groupBy("range").agg(F.max("doc_id").alias("top")), "tops")
    same = base["range"].eqNullSafe(tops["range"]) & base["doc_id"].eqNullSafe(tops["top"])
    firsts = base.join(F.broadcast(tops), same, "left_semi").groupBy("range").agg(F.min("text").alias("text"))  # a row for each range is broadcast
    downward = Window.orderBy(F.col("range").desc())
    whole = downward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = F.coalesce(F.lead("range").over(downward), F.first("range").over(whole)).alias("follows")
    firsts = materialize(firsts, "firsts")
    order = firsts.select("range").select("range", follows)
    return order.join(firsts.withColumnRenamed("range", "follows"), "follows").select("range", "text")


def edited(docs: DataFrame) -> DataFrame:
    """Per document the anchors and fingerprints of its text and of its edited text, whose last third is replaced by as
    much of the next document's start (by descending doc_id), and both likenesses."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    ranges = max(RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    base = range_bucket(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "doc_id", ranges)
    after = _successors(base).select(F.lit(None).cast("long").alias("doc_id"), "text", "range", F.lit(1).alias("extra"))
    order = ["extra", F.col("doc_id").desc_nulls_last(), "text"]
    # Anchors are found after the shuffle, so that only texts are moved.
    dealt = base.withColumn("extra", F.lit(0)).unionByName(after).repartition("range").sortWithinPartitions("range", *order)
    downward = Window.partitionBy("range").orderBy(*order)
    rows = with_anchors(dealt, "text", "anchors")
    rows = rows.withColumns({"next_text": F.lead("text").over(downward), "next_anchors": F.lead("anchors").over(downward)}).where("extra = 0")
    third = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)))
    rows = with_anchors(rows.drop("next_text"), "edited", "edited_anchors")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
        "anchors",
        "anchors_at",
        "edited_anchors",
        "edited_anchors_at",
    )
