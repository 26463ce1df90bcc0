"""Canonical JSON and parsers of answers against the json module."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from priorline.functions import canonical, text


def test_numbers_equal_json(spark):
    rng = random.Random(1)
    numbers = [5e-324, 1e-323, 2.2250738585072014e-308, 1e22, 1e23, 1e16, 9999999999999998.0, 1e-4, 0.0001234, 1e-5, 0.0, 2e-3, 1.7976931348623157e308, 1e-07, -1.5, 100.0]
    numbers += [round(rng.uniform(-1000, 1000), rng.randrange(8)) for _ in range(3000)] + [float(rng.randrange(-(10**9), 10**9)) * 10.0 ** rng.randrange(-12, 9) for _ in range(3000)]
    numbers += [x for x in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)) if math.isfinite(x) and abs(x) < 4e37]
    rows = spark.createDataFrame([(x,) for x in numbers if x or math.copysign(1, x) > 0], "d double").select("d", canonical.shortest_decimal(F.col("d")).alias("t")).collect()
    assert [(r.d, r.t) for r in rows if r.t != json.dumps(r.d)] == []
    odd = spark.createDataFrame([(-0.0,), (math.nan,), (math.inf,), (None,)], "d double").select(canonical.shortest_decimal(F.col("d")).alias("t")).collect()
    assert [r.t for r in odd] == [None] * 4


def test_nested_records_equal_json(spark):
    schema = "b struct<z: double, a: array<double>, m: map<string, long>>, a string, c boolean"
    rows = [({"z": 1e-7, "a": [1.0, 2.5e20], "m": {"y": 1, "x": 2}}, 'q"\\\u001b\n\u001f/é\\u001B', True), ({"z": None, "a": [], "m": None}, "", None), (None, None, False)]
    df = spark.createDataFrame(rows, schema).select(F.struct("*").alias("r"))
    got = [r.j for r in df.select(canonical.canonical_json(F.col("r"), df.schema["r"].dataType).alias("j")).collect()]
    assert got == [json.dumps({"b": b, "a": a, "c": c}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for b, a, c in rows]


def test_a_number_without_canonical_form_leaves_no_record(spark):
    df = spark.createDataFrame([([1.0, -0.0],), ([math.nan],)], "a array<double>").select(F.struct("a").alias("r"))
    assert [r[0] for r in df.select(canonical.canonical_json(F.col("r"), df.schema["r"].dataType)).collect()] == [None, None]


@pytest.mark.parametrize(
    "said, probability, failure",
    [
        ('{"probability": "0.5"}', None, "no number"), ('{"probability": 0.5, "x": 1}', None, "other keys"), ('ok {"probability": 0.25}\n', 0.25, None), ('{"probability": {"b":1}}', None, "no number"),
        ("x", None, "no object"), ('{"probability": 1.5}', None, "outside 0 to 1"), ('{"a":1} {"probability": 1}', 1.0, None), ('{"probability":0.5} end', None, "no object"), ('{"probability":0.5,"probability":0.6}', None, "no object"),
    ],
)
def test_answers(spark, said, probability, failure):
    assert tuple(spark.createDataFrame([(said,)], "said string").select(*text.parsed_answer(F.col("said"))).head()) == (probability, failure)


@pytest.mark.parametrize("said, number", [("0.3 </think> so 0.75 or 0.2", 0.75), ("x" * 300 + " 0.4", 0.4), ("0.4" + "y" * 300, None), ("a 1.00", 1.0), ("2.5", None), ("none", None)])
def test_stated_numbers(spark, said, number):
    assert spark.createDataFrame([(said,)], "said string").select(text.stated_probability(F.col("said"))).head()[0] == number
