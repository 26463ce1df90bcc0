"""Typed readers that fail on what they don't expect, and sinks that never overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from priorline.functions.canonical import repeats_key


def read_csv(spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header; a row that doesn't fit the schema fails the read. Only ``columns`` are parsed."""
    found = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")
    return found.select(*columns) if columns else found


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with exactly the schema's fields: a line with others, or none of one's, comes back in a
    violation row rather than as data. Columns: the schema's, _violation."""
    text = spark.read.text(path)
    wanted = F.array_sort(F.array(*[F.lit(f.name) for f in schema]))
    keys = F.array_sort(F.json_object_keys("value"))
    parsed = text.select(F.from_json("value", schema).alias("r"), F.when(keys.isNull(), F.lit("no object")).when(keys != wanted, F.lit("other keys")).alias("_violation"))
    return parsed.select("r.*", "_violation")


def write_once(df: DataFrame, path: str, kind: str = "json") -> None:
    """Writes a new folder; an existing one is an error."""
    df.write.mode("errorifexists").format(kind).save(path)


def verified_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """The files under ``path`` whose content has not the SHA-256 that ``expected`` (name, sha256) tells."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return expected.join(found, "name", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("found")))


def scoreboard_events(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """Nested JSON payloads to one row for each event in them."""
    return raw.select(F.explode(F.from_json(column, schema)["events"]).alias("e")).select("e.*")


def struct(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def write_csv(df: DataFrame, path: str, schema: str) -> None:
    """Writes a new folder of CSV files under the header that ``schema`` tells, its columns cast and in its order."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in struct(schema)]).write.mode("errorifexists").csv(path, header=True)


def read_archive(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON lines of all files that a glob finds, with the file's path: it tells the snapshot."""
    return spark.read.schema(schema).json(pattern).withColumn("_path", F.col("_metadata.file_path"))


def one_object(text: Column) -> Column:
    """The variant of a JSON object that the text is and nothing else; null for anything more or less."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    second = F.try_variant_get(alone, "$[1]", "variant").isNotNull()
    return F.when(F.trim(text).startswith("{") & ~second, F.try_variant_get(alone, "$[0]", "variant"))


#: JSON strings.
STRING = r'"(?:[^"\\]|\\.)*"'


def strict_verdict(line: Column, kinds: dict[str, str]) -> Column:
    """What is wrong with a JSON object that should have exactly the keys of ``kinds``, of kind string or number: a
    repeated key at any depth, a number that isn't finite, no object or something beside it, other keys, a wrong type; ok
    if nothing is. What stands within strings is no structure."""
    bare = F.regexp_replace(line, STRING, '""')
    keys = F.json_object_keys(line)
    value = one_object(line)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    fits = {"string": lambda c: c == "STRING", "number": lambda c: c.rlike("^(BIGINT|DECIMAL.*|DOUBLE)$")}
    right = [F.coalesce(fits[k](kind(name)), F.lit(False)) for name, k in kinds.items()]
    endless = [F.coalesce(F.abs(F.try_variant_get(value, f"$.{name}", "double")) == float("inf"), F.lit(False)) for name, k in kinds.items() if k == "number"]
    return (
        F.when(line.isNull(), "no object")
        .when(repeats_key(line), "repeated key")
        .when(bare.rlike("NaN|Infinity") | F.exists(F.array(*endless, F.lit(False)), lambda x: x), "not finite")
        .when(value.isNull() | keys.isNull(), "no object")
        .when(F.array_sort(keys) != F.array(*[F.lit(k) for k in sorted(kinds)]), "other keys")
        .when(~F.forall(F.array(*right), lambda x: x), "wrong type")
        .otherwise("ok")
    )
