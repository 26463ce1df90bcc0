"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Each source gets a target number of words. Whole repeats of a source come first; what is left of its
target is a budget for documents in hash order. The budget's threshold is found without sorting: words
are summed by source and leading hash digits, the digit group in which the running sum passes the
budget is kept, and only its documents are summed again by the next digits. Documents below the
threshold are taken once more, those above are not, and documents that share the threshold's whole
hash split what is left in proportion to their sizes.

Defined cases: a null text has size 0 and nothing is taken from it; a null source is a source of its
own, last in order; rows that repeat a doc_id share a hash and so a fate; an empty table gives no rows;
further columns are dropped by ``mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import set_aside
from priorline.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Weights by the code point order of the sources, repeating; the most times a source or document is taken.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Hash digits (hexadecimal) of each level of the histogram, from the left.
LEVELS = (3, 3, 3)
#: A table with one row for each source is broadcast up to this many rows, else joined by shuffle.
MOST_BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_digits(doc_id: Column) -> Column:
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, sum(LEVELS))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) to (.., target): weights are filled up to ``most`` sizes, the excess goes to
    the others by weight. Sources in the order of cap over weight reach their caps one after another,
    so running sums give the level at which the rest stands. One row for each source."""
    ordered = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ordered = ordered.select("source", "source_size", "rank", w.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = ordered.withColumn("level", level)
    open_level = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(whole)
    return leveled.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce(open_level, F.lit(0.0))).alias("target"))


def _with_sources(df: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    small = F.broadcast(sources) if n_sources <= MOST_BROADCAST_SOURCES else sources
    return df.join(small, df["source"].eqNullSafe(small["source"]), "left").drop(small["source"])


def _allot(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(doc_id, source, size, digits, ..) with source_size, target and taken added."""
    sources = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "sources")
    n_sources = sources.count()
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("repeats", repeats).withColumn("left", F.floor("target").cast("long") - F.col("repeats") * F.col("source_size"))
    edge = sources.select("source", F.lit("").alias("edge"), F.col("left"), F.lit(0).cast("long").alias("cell"))
    upto = 0
    for width in LEVELS:
        near = _with_sources(sized.select("source", "size", "digits"), edge, n_sources)
        near = near.where(F.substring("digits", 1, upto) == F.col("edge")) if upto else near
        upto += width
        sums = near.groupBy("source", "left", F.substring("digits", 1, upto).alias("edge")).agg(F.sum("size").alias("cell"))
        upward = Window.partitionBy("source").orderBy("edge").rowsBetween(Window.unboundedPreceding, -1)
        under = F.coalesce(F.sum("cell").over(upward), F.lit(0))
        crossed = sums.withColumn("under", under).where((F.col("under") <= F.col("left")) & (F.col("under") + F.col("cell") > F.col("left")))
        edge = materialize(crossed.select("source", "edge", (F.col("left") - F.col("under")).alias("left"), "cell"), "edge")
    out = _with_sources(sized, sources.drop("left"), n_sources)
    out = _with_sources(out, edge, n_sources)
    once_more = F.when(F.col("digits") < F.col("edge"), F.col("size")).when(F.col("digits") == F.col("edge"), F.expr("size * left div cell")).otherwise(F.lit(0))
    return out.withColumn("taken", (F.col("repeats") * F.col("size") + F.coalesce(once_more, F.lit(0))).cast("long")).drop("edge", "left", "cell", "repeats")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target of its source, taken (words, repeats counted)."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash_digits(F.col("doc_id")).alias("digits")), "sized")
    return _allot(sized, weights, most).select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a document's text is repeated as often as it is
    taken whole, then cut at the word where its share ends; documents of which nothing is taken go."""
    aside, at, back = set_aside(docs)
    doc_id, source, text = (F.col(at[c]) for c in ("doc_id", "source", "text"))
    sized = aside.select("*", word_count(text).alias("size"), hash_digits(doc_id).alias("digits"))
    # Only sizes and digits go through the histogram; its rows find their texts again by what decides a share.
    small = materialize(sized.select(source.alias("source"), "size", "digits"), "sized")
    shares = _allot(small, weights, most).select("source", "size", "digits", "taken").distinct()
    mine, other = sized.alias("mine"), shares.alias("other")
    same = (F.col("mine.digits") == F.col("other.digits")) & F.col(f"mine.{at['source']}").eqNullSafe(F.col("other.source")) & (F.col("mine.size") == F.col("other.size"))
    joined = mine.join(other, same).where(F.col("taken") > 0).select("mine.*", "taken")
    whole = F.expr("cast(taken div size as int)")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    part = F.array_join(F.slice(words, 1, F.expr("cast(taken % size as int)")), " ")
    each = F.concat(F.array_repeat(text, whole), F.array(F.when(F.expr("taken % size > 0"), part)))
    mixed = joined.withColumn(at["text"], F.array_join(F.filter(each, lambda x: x.isNotNull()), "\n"))
    if "n_chars" in at:
        mixed = mixed.withColumn(at["n_chars"], F.length(at["text"]).cast("long"))
    return back(mixed)


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         substr(md5(coalesce(doc_id::varchar, '')), 1, 9) as digits
  from documents),
ranked as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) - 1 as rank from sized group by source),
weighed as (
  select *, case rank % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, source_size * 3.0::double as cap from ranked),
leveled as (
  select *, (sum(source_size) over ()
     - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0.0::double))
     / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level from weighed),
targets as (
  select source, source_size, least(cap, weight * coalesce(max(case when cap / weight >= level then level end) over (), 0.0::double))::double as target from leveled),
budgets as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as repeats from targets),
placed as (
  select s.doc_id, s.source, s.size, b.source_size, b.target, b.repeats, floor(b.target)::bigint - b.repeats * b.source_size as budget,
         sum(s.size) over (partition by s.source, s.digits) as cell,
         sum(s.size) over (partition by s.source order by s.digits range between unbounded preceding and current row)
           - sum(s.size) over (partition by s.source, s.digits) as under
  from sized s join budgets b on s.source is not distinct from b.source)
select doc_id, source, size, source_size, target,
       (repeats * size + case when under + cell <= budget then size
                              when under <= budget and cell > 0 then (size * (budget - under)) // cell else 0 end)::bigint as taken
from placed
"""
