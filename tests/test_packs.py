"""Packs of snapshots and the records bound to them."""

import base64
import hashlib
import json
from datetime import datetime

import pytest

from priorline.sources import packs

SNAPSHOTS = "source string, version string, taken timestamp, payload binary"
RECORDS = "id long, cutoff timestamp, evidence array<struct<source string, version string, sha256 string>>"


def at(hour):
    return datetime(2024, 1, 5, hour)


def digest(b):
    return hashlib.sha256(b).hexdigest()


def line(**changes):
    told = {"payload": base64.b64encode(b"abc").decode(), "sha256": digest(b"abc"), "source": "s", "taken_us": 5, "version": "1"}
    return json.dumps({**told, **changes})


def test_a_pack_reads_back_whole(spark, tmp_path):
    path = f"file://{tmp_path}/pack"
    payloads = [b"", b"\x00\xff\n", "ünï|x".encode(), b"z" * 20_000]
    packs.write_pack(spark.createDataFrame([("s", str(k), at(k), bytearray(p)) for k, p in enumerate(payloads)], SNAPSHOTS), path)
    rows = sorted(packs.read_pack(spark, path).collect(), key=lambda r: r.version)
    assert [(bytes(r.payload), r.sha256, r.taken, r.violation) for r in rows] == [(p, digest(p), at(k), None) for k, p in enumerate(payloads)]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        packs.write_pack(spark.createDataFrame([], SNAPSHOTS), path)


def test_lines_that_break_the_rules(spark, tmp_path):
    lines = {
        "a": line(version="a"),
        "b": line(version="b", payload=base64.b64encode(b"abd").decode()),
        "c": line(version="c", payload="YWJj="),
        "d": line(version="d", payload="YWJ j"),
        "e": line(version="e", more=1),
        "f": line(version="f", sha256=None),
        "g": line(version="g") + "\n" + line(version="g"),
    }
    (tmp_path / "pack").write_text("\n".join([*lines.values(), "no json"]) + "\n")
    rows = packs.read_pack(spark, f"file://{tmp_path}/pack").collect()
    found = {r.version: r.violation for r in rows}
    assert found == {"a": None, "b": "changed payload", "c": "no base64", "d": "no base64", "e": "other keys", "f": "no value", "g": "repeated version", None: "other keys"}
    assert all((r.payload is None) == (r.violation is not None) for r in rows)


def test_references_are_held_to_the_pack(spark, tmp_path):
    path = f"file://{tmp_path}/pack"
    packs.write_pack(spark.createDataFrame([("s", "1", at(1), bytearray(b"one")), ("s", "2", at(4), bytearray(b"two"))], SNAPSHOTS), path)
    ref = lambda v, b: ("s", v, digest(b))
    records = [
        (1, at(3), [ref("1", b"one"), ref("2", b"two"), ref("3", b"one"), ref("1", b"two"), (None, "1", digest(b"one"))]),
        (2, at(4), [ref("2", b"two")]),
        (3, None, [ref("1", b"one")]),
        (4, at(3), []),
        (5, at(3), None),
    ]
    df, pack = spark.createDataFrame(records, RECORDS), packs.read_pack(spark, path)
    out = {(r.id, r.place): (r.violation, r.payload and bytes(r.payload)) for r in packs.bind(df, pack, key="id", cutoff="cutoff").collect()}
    assert out == {
        (1, 0): (None, b"one"), (1, 1): ("late snapshot", None), (1, 2): ("missing snapshot", None), (1, 3): ("other payload", None), (1, 4): ("missing snapshot", None),
        (2, 0): (None, b"two"), (3, 0): ("no time", None), (4, None): ("no evidence", None), (5, None): ("no evidence", None),
    }
    later = {(r.id, r.place): r.violation for r in packs.bind(df, pack, key="id", cutoff="cutoff", after=True).collect()}
    assert later[1, 0] == "early snapshot" and later[1, 1] is None and later[2, 0] is None
    assert packs.bind(df.limit(0), pack, key="id", cutoff="cutoff").count() == 0
