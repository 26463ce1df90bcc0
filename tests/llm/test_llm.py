"""The llm operators against brute force, round trips and held-out accuracy, on small tables."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from priorline.llm import chat_format, fingerprints, html_text, language, media, mixing, ngram_join, packing, repair_ids, suffix_dedup
from priorline.llm import queries as llm_queries
from priorline.llm.components import components
from priorline.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool="abcdefg"):
    return " ".join("".join(rng.choice(pool) for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty and odd texts, repeated rows, ids far apart."""
    rng = random.Random(1)
    passage = words(rng, 90)
    base = words(rng, 220)
    out = [(k, words(rng, rng.randrange(1, 300)), "en", f"s{k % 4}", 0) for k in range(40)]
    out += [(100 + k, base, "en", "s0", 0) for k in range(3)]
    out += [(200 + k, " ".join(w if rng.random() > 0.01 else f"z{k}" for w in base.split()), None, "s1", 0) for k in range(8)]
    out += [(300 + k, words(rng, 20) + " " + passage + " " + words(rng, 30), "de", None, 0) for k in range(4)]
    out += [(400, None, None, None, None), (401, "", "en", "s2", 0), (402, "  \n\t", "en", "s2", 0), (403, "one two", "en", "s2", 0), (404, "one  two", "en", "s2", 0)]
    out += [(405, "b" * 900, "en", "s3", 0), (406, "é" * 500 + "ab" * 300, "fr", "s3", 0), (5000, "日本語 " * 200, "ja", "zz", 0), (5000, "日本語 " * 200, "ja", "zz", 0), (None, "no id here", "en", "s1", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_every_operator_takes_an_empty_table(spark, empty):
    for f in (suffix_dedup.dedup, fingerprints.edited, mixing.mix, packing.pack, language.identify, ngram_join.join, media.audio_features, suffix_dedup.apply_dedup, mixing.apply_mix, ngram_join.keep_one):
        assert f(empty).count() == 0, f
    assert repair_ids.read_ids(repair_ids.write_ids(empty)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 0


# Suffix-array dedup.


def brute_removal(rows, n=suffix_dedup.LENGTH):
    return sorted(((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()) for i, b, gone, runs, kept in brute_cuts(rows, n)), key=str)


def brute_cuts(rows, n):
    """Per row: id, bytes, which of them go, in how many runs, what stays."""
    seen = {}
    data = [(i, (x or "").encode()) for i, x, *_ in rows]
    for _, b in data:
        for k in range(len(b) - n + 1):
            seen[b[k : k + n]] = seen.get(b[k : k + n], 0) + 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        runs = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, b, gone, runs, bytes(c for c, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("batches, length", [(1, 400), (5, suffix_dedup.PASSAGE)])
def test_suffix_dedup_equals_brute_force(docs, rows, batches, length):
    got = suffix_dedup.dedup(docs, batches=batches, length=length).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removal(rows, length)


def test_suffix_dedup_gives_spans_and_texts(spark, docs, rows, tmp_path):
    passage = words(random.Random(8), 120)
    odd = [(600, f"one {passage}é end", "fr", "s0", 0), (601, f"two {passage}è stop", "fr", "s0", 0)]  # the cut divides é and è
    docs.unionByName(spark.createDataFrame(odd, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    told = brute_cuts(rows + odd, suffix_dedup.LENGTH)
    starts = lambda gone, on: [k for k in range(len(gone)) if gone[k] == on and (k == 0 or gone[k - 1] != on)]
    runs = lambda gone: [(a, next((b for b in starts(gone, 0) if b > a), len(gone))) for a in starts(gone, 1)]
    got = [(r.doc_id, r.n_bytes, [tuple(x) for x in r.spans], bytes(r.kept)) for r in suffix_dedup.cut(table).collect()]
    assert sorted(got, key=str) == sorted(((i, len(b), runs(gone), kept) for i, b, gone, _, kept in told), key=str)
    query = llm_queries.op1_suffix_array_dedup(spark, str(tmp_path))
    assert query.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    want = [(i, len(b), sum(gone), n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")) for i, b, gone, n, kept in told]
    assert sorted(map(tuple, query.collect()), key=str) == sorted(want, key=str)
    assert {i: text for i, *_, text in want}[600] == "one\ufffd end"


def test_levels_merge_geometrically_and_persist(spark):
    rng = random.Random(5)
    family, said, seen = suffix_dedup.SuffixFamily(spark), [], []
    for b in range(7):
        heads = [bytes([7]) * 64, bytes([b]) * 64, bytes([100 + b // 2]) * 64, *(rng.randbytes(64) for _ in range(50))]
        if b == 3:
            heads.append(heads[-1])
        found = {bytes(r.head) for r in family.add(spark.createDataFrame([(h, b"u", b * 100 + k) for k, h in enumerate(heads)], "head binary, uid binary, place int")).collect()}
        want = {h for h in heads if heads.count(h) > 1 or h in said}
        assert want <= found <= want | set(seen)
        said += heads
        seen += want
        assert [size for size, _ in family.levels] == {0: [1], 1: [2], 2: [2, 1], 3: [4], 4: [4, 1], 5: [4, 2], 6: [4, 2, 1]}[b]
        family = suffix_dedup.SuffixFamily(spark, family.folder)  # as another session would go on
    for _, level in family.levels:
        parts = [[bytes(r.head) for r in p] for p in level.select("head").rdd.glom().collect()]
        assert all(p == sorted(p) for p in parts)


def test_neighbours_are_found_across_files(spark, tmp_path):
    heads = [b"a"] * 3 + [b"b"] + [b"c"] * 2 + [b"d", b"e"]
    rows = [(h, b"u", k) for k, h in enumerate(heads)]
    spark.createDataFrame(rows, "head binary, uid binary, place int").repartitionByRange(8, "place").write.parquet(f"{tmp_path}/array")
    assert {bytes(r.head) for r in suffix_dedup.neighbours(spark.read.parquet(f"{tmp_path}/array")).collect()} == {b"a", b"c"}


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 4, 900).astype(np.uint8)
    seen = []
    for lead in (0, 37, 801):
        data = np.r_[rng.integers(0, 4, lead).astype(np.uint8), common]
        _, _, n, place, _, _ = suffix_dedup.anchors(data, np.array([0]), np.array([len(data)]))
        inside = (place >= lead + suffix_dedup.LENGTH) & (place < lead + 900 - suffix_dedup.LENGTH)
        seen.append(sorted((place[inside] - lead).tolist()))
        assert sum(n) == len(data) - suffix_dedup.LENGTH + 1
    assert seen[0] == seen[1] == seen[2]


def test_apply_dedup_keeps_columns_and_clean_rows(docs):
    out = suffix_dedup.apply_dedup(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert {403, 401, 400, None} <= kept and not kept & {100, 101, 102, 405}


# Fingerprints.


def brute_sketch(text):
    x = lambda b, seed=42: xxhash.xxh64(b, seed=seed).intdigest()
    sign = lambda v: v - (1 << 64) if v >> 63 else v

    def longs(*values):
        h = 42
        for v in values:
            h = x(struct.pack("<Q", v), h)
        return h

    w = [x(t.encode()) for t in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not w:
        return []
    if len(w) < fingerprints.K:
        return [x(" ".join(str(sign(v)) for v in w).encode()) & 0xFFFFFFFF]
    pairs = [longs(a, b) for a, b in zip(w, w[1:])]
    anchors = set()
    for i in range(len(w) - 4):
        a, b, c, d = map(sign, pairs[i : i + 4])
        if min(a, d) <= min(b, c):
            anchors.add(longs(pairs[i], pairs[i + 2], pairs[i + 3]) & 0xFFFFFFFF)
    return sorted(anchors)[: fingerprints.SKETCH]


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    both = sorted(set(a) | set(b))[: fingerprints.SKETCH]
    return len(set(a) & set(b) & set(both)) / len(both)


def test_fingerprints_equal_brute_force(docs, rows):
    ordered = sorted(((i, x or "") for i, x, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = {}
    for r in fingerprints.edited(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, (i, x) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        third = len(x) // 3
        edited = x[: len(x) - third] + after[:third]
        want = (len(x), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{v:08x}" for v in brute_sketch(x)), "".join(f"{v:08x}" for v in brute_sketch(edited)))
        near = [(r.near_edited, r.near_next) for r in got[i] if (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == want]
        assert near, i
        assert any(a == pytest.approx(brute_likeness(brute_sketch(x), brute_sketch(edited))) and b == pytest.approx(brute_likeness(brute_sketch(x), brute_sketch(after))) for a, b in near)


def test_ranges_in_two_steps(spark, monkeypatch):
    from priorline.llm import common

    rows = [(k * k,) for k in range(2000)] + [(None,), (5 * 5,)]
    monkeypatch.setattr(common, "LITERAL_BOUNDS", 8)
    got = sorted((r.k, r.range) for r in common.range_bucket(spark.createDataFrame(rows, "k long"), "k", 100).where("k is not null").collect())
    assert [b for _, b in got] == sorted(b for _, b in got)
    sizes = {}
    for _, b in got:
        sizes[b] = sizes.get(b, 0) + 1
    assert len(sizes) > 60 and max(sizes.values()) < 100


def test_fingerprints_over_many_ranges(docs, rows, monkeypatch):
    from priorline.llm import common

    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.fingerprint, r.edited_sha256)
    want = sorted(fingerprints.edited(docs).collect(), key=key)
    monkeypatch.setattr(common, "LITERAL_BOUNDS", 4)
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 400)
    assert sorted(fingerprints.edited(docs).collect(), key=key) == want


def test_all_anchors_of_long_texts_count(spark):
    rng = random.Random(8)
    a = words(rng, 3000, "abcdefghijklmnop").split()
    b = words(rng, 3000, "abcdefghijklmnop").split()
    b[1000:1012] = a[500:512]  # the passage that both share is under a hundredth of either
    found = {r.doc_id: r for r in fingerprints.edited(spark.createDataFrame([(2, " ".join(a)), (1, " ".join(b))], "doc_id long, text string")).collect()}
    for k, w in ((2, a), (1, b)):
        r = found[k]
        assert len(r.anchors) == len(r.anchors_at) > 1000 and r.anchors_at == sorted(set(r.anchors_at))
        assert set(r.anchors_at) == {i for i in range(len(w) - 4) if brute_sketch(" ".join(w[i : i + 5]))}
        assert all(brute_sketch(" ".join(w[i : i + 5])) == [h & 0xFFFFFFFF] for h, i in zip(r.anchors, r.anchors_at, strict=True))
        assert len(r.edited_anchors) == len(r.edited_anchors_at) > 1000
    sets = [set(found[k].anchors) for k in (2, 1)]
    shared = {(x - y) for h, x in zip(found[1].anchors, found[1].anchors_at) for g, y in zip(found[2].anchors, found[2].anchors_at) if g == h}
    assert shared == {500} and 0 < found[2].near_next == len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.01


# Chat format.

TRICKY = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<|", "|>", "<", "\\", "|", "\n", "\r", "a", "é", "assistant"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=5))
def test_chat_round_trip(turns):
    assert chat_format.parse_turns(chat_format.render(turns)) == turns


def test_chat_parser_rejects_what_no_turn_is():
    for bad in ("x", "<|im_start|>user<|im_end|>\n", "<|im_start|>u\nx<|im_start|>y<|im_end|>\n", "<|im_start|>u\nx"):
        with pytest.raises(ValueError):
            chat_format.parse_turns(bad)


def test_chat_query_reads_back_the_source(spark):
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <|im_end|>\n b"), (1, 2, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (None, 0, "user", "x")]
    table = spark.createDataFrame([(*r, "more") for r in said], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_segments(chat_format.with_control_case(table))).collect()}
    assert set(got) == {1, 2, None, -1}
    for conv in (1, 2):
        own = [(r or "", t or "") for c, _, r, t in said if c == conv]
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == len(chat_format.render(own))


def test_large_ids_beside_null_stay_apart(spark):
    a, b = (1 << 60) + 1, (1 << 60) + 2
    said = spark.createDataFrame([(a, 0, "user", "x"), (b, 0, "assistant", "y"), (None, 0, "user", "z")], "conv_id long, turn long, role string, text string").coalesce(1)
    assert {r.conv_id: r.n_turns for r in chat_format.read_back(chat_format.format_segments(said)).collect()} == {a: 1, b: 1, None: 1}
    table = spark.createDataFrame([(a, "some words", "en"), (b, "other words", "en"), (None, "more", "de")], "doc_id long, text string, lang string").coalesce(1)
    for f in (packing.pack, language.identify, lambda d: repair_ids.read_ids(repair_ids.write_ids(d)), media.audio_features, suffix_dedup.dedup, ngram_join.join, fingerprints.edited):
        assert {r.doc_id for r in f(table).collect()} == {a, b, None}


def test_further_columns_with_clashing_names_change_nothing(spark, docs):
    few = docs.where("doc_id < 12 or doc_id >= 400").dropDuplicates(["doc_id"])
    more = few.withColumns({c: F.lit("x") for c in ("uid", "doc", "range", "extra", "anchors", "edited", "piece", "group", "start", "length", "part", "media", "n_bytes", "held_out", "lang_pred", "score", "sid", "label", "size", "_key")})
    told = lambda df, drop=(): sorted(str(r) for r in df.drop(*drop).collect())
    for f, drop in (
        (fingerprints.edited, ()), (media.audio_features, ()), (language.identify, ()), (lambda d: repair_ids.read_ids(repair_ids.write_ids(d)), ()),
        (packing.pack, ("sequence_id", "offset")), (ngram_join.join, ()), (suffix_dedup.dedup, ()),
    ):
        assert told(f(more), drop) == told(f(few), drop), f
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes")]
    table = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    clash = table.withColumns({c: F.lit("x") for c in ("turn_no", "segment", "loss_start", "loss_end", "part")})
    assert told(chat_format.read_back(chat_format.format_segments(clash))) == told(chat_format.read_back(chat_format.format_segments(table)))


def test_very_long_texts(spark):
    rng = random.Random(31)
    long = words(rng, 120_000, "abcdefghijklmnop")
    table = spark.createDataFrame([(1, long, "en"), (2, long + " more", "en"), (3, "short one here", "en")], "doc_id long, text string, lang string")
    near = {r.doc_id: r for r in fingerprints.edited(table).collect()}
    assert near[1].near_edited > 0.4 and len(near[1].anchors) > 20_000
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(table).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    assert all(0 <= r.score <= 1 for r in language.identify(table).collect())
    said = spark.createDataFrame([(1, 0, "assistant", long + "<|im_end|>")], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_segments(said)).head().loss_chars == len(long) + 10


def test_loss_mask_is_read_from_what_is_stored(spark):
    said = [(1, 0, "assistant", "a <|im_end|> b"), (1, 1, "user", "no"), (1, 2, "assistant", "c\nd")]
    stored = chat_format.format_segments(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    marked = [r.segment[r.loss_start : r.loss_end] for r in stored.orderBy("turn_no").collect()]
    assert [chat_format.unescape(x) for x in marked] == ["a <|im_end|> b", "", "c\nd"]
    none = chat_format.read_back(stored.withColumn("loss_end", F.col("loss_start"))).head()
    assert (none.loss_chars, none.n_turns) == (0, 3)
    assert chat_format.read_back(chat_format.format_segments(stored.select("conv_id", F.lit(0).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text")).limit(0))).count() == 0


# Mixing.


def test_mixing_meets_targets_and_caps(docs, rows):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert v[0].source_size == sum(r["size"] for r in v)
        assert v[0].target <= 3 * v[0].source_size + 1e-6
        assert abs(sum(r.taken for r in v) - v[0].target) <= 2 + len(v)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


@pytest.mark.parametrize("sizes", [[10, 1000, 1000], [1, 1, 1000], [0, 5, 7], [5], [0, 0, 9], [100, 3, 50, 2]])
def test_targets_fill_by_weight(spark, sizes):
    names = "abcdefgh"
    weight, cap = [5, 2, 1, 5, 2, 1][: len(sizes)], [3 * s for s in sizes]
    left, target, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:  # share by weight, fix those above their caps, share what is left
        level = left / sum(weight[i] for i in free)
        over = [i for i in free if weight[i] * level > cap[i] + 1e-12]
        for i in over or list(free):
            target[i] = float(cap[i]) if over else weight[i] * level
            left -= target[i] if over else 0
            free.discard(i)
    table = spark.createDataFrame([(names[k], s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    assert [got[names[k]] for k in range(len(sizes))] == pytest.approx(target)


def test_applied_mix_has_the_taken_words(docs):
    taken = sum(r.taken for r in mixing.mix(docs.dropDuplicates(["doc_id"])).collect())
    out = mixing.apply_mix(docs.dropDuplicates(["doc_id"]))
    assert out.columns == docs.columns
    assert sum(len(re.findall(mixing.WORD, r.text)) for r in out.collect()) == taken


# Tokens, packing, id files.


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab Éßİ1.,'\n\t\r\xa0\u3000\x01\x1cΣ|<>é", "<|endoftext|>", "  "]), max_size=30).map("".join), max_size=4))
def test_encoder_equals_the_library(texts):
    for name, spaces, dtype in (("byte_bpe_50k.json", True, "<u4"), ("word_bpe_49k.json", False, "<u2")):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        got = Encoder(name, spaces, dtype, "<|endoftext|>").many(pa.array(texts, pa.string()))
        assert got == [np.array(library.encode(x, add_special_tokens=False).ids, dtype).tobytes() for x in texts]


def test_packing_is_gapless_and_full(docs, rows):
    out = packing.pack(docs).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(library.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for i, x, *_ in rows}
    for r in out:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r.length for r in out) == sum(len(ids[i]) for i, *_ in rows)
    assert len(bins) <= -(-sum(r.length for r in out) // packing.CAPACITY) + 1


def test_cut_leaves_the_first_piece_shorter():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(1, 4) == [(0, 1)]


def test_local_search_beats_best_fit():
    assert len(packing.pack_lengths([5, 4, 4, 3, 2, 2], 10)) == 2
    rng = random.Random(2)
    lengths = [rng.randrange(300, 1500) for _ in range(3000)]
    bins = packing.pack_lengths(lengths)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and max(sum(lengths[i] for i in b) for b in bins) <= 2048
    assert len(bins) <= 1.01 * sum(lengths) / 2048 + 1


def test_one_id_for_all_makes_no_larger_group(spark):
    cut = spark.createDataFrame([(None, 0, 0, 100, 7)] * 5000, packing.PIECES)
    out = packing.pack_pieces(cut, group_pieces=500)
    groups = {r.g: r["count"] for r in out.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()}
    assert sum(groups.values()) == 5000 and max(groups.values()) < 1500


def test_second_round_packs_underfull_bins(spark):
    rng = random.Random(3)
    cut = spark.createDataFrame([(k, 0, 0, rng.randrange(1, 2049), k) for k in range(4000)], packing.PIECES)
    out = packing.pack_pieces(cut, group_pieces=200).collect()
    assert sorted(r.doc_id for r in out) == list(range(4000))
    fills = {}
    for r in out:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 2048 and len(fills) <= 1.05 * sum(fills.values()) / 2048


def test_id_files_read_back(docs, rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(repair_ids.read_ids(repair_ids.write_ids(docs)).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, x, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = np.array(library.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=60), min_size=1, max_size=30))
def test_grammar_round_trip_and_random_access(texts):
    flat = np.array([v for t in texts * 5 for v in [*t, 1]], "<u2")
    starts = np.r_[0, np.cumsum([len(t) + 1 for t in texts * 5])][:-1]
    block = repair_ids.Block(repair_ids.compress(flat, starts))
    assert block.ids().tolist() == flat.tolist()
    for k, t in enumerate(texts * 5):
        assert block.document(k).tolist() == [*t, 1]


@pytest.mark.parametrize("flat", [([5, 6] * 10 + [0, 0, 9, 1]) * 3, [0] * 500 + [1], [7, 1] * 400, list(range(49_407)) * 3 + [1]])
def test_grammar_takes_any_ids(flat):
    ids = np.array(flat, "<u2")
    starts = np.r_[0, np.flatnonzero(ids == 1)[:-1] + 1] if len(flat) < 10_000 else np.array([0])
    block = repair_ids.Block(repair_ids.compress(ids, starts))
    assert block.ids().tolist() == flat
    assert [v for k in range(len(block)) for v in block.document(k).tolist()] == flat


def test_no_pair_stays_frequent():
    rng = random.Random(12)
    ids = np.array([v for _ in range(300) for v in [*(rng.randrange(2, 40) for _ in range(60)), 1]], "<u2")
    block = repair_ids.Block(repair_ids.compress(ids, np.arange(300) * 61))
    left = {}
    s = block._symbols.tolist()
    for a, b in zip(s, s[1:]):
        if 1 not in (a, b) and a != b:
            left[a, b] = left.get((a, b), 0) + 1
    assert max(left.values()) < repair_ids.LEAST_COUNT and block.ids().tolist() == ids.tolist()
    assert all(block._expand(np.array([k]))[-1] != 1 for k in range(repair_ids.FIRST_NONTERMINAL, repair_ids.FIRST_NONTERMINAL + len(block.lengths)))


def test_grammar_replaces_frequent_pairs():
    ids = np.array(([5, 6, 7, 8] * 500 + [1]) * 4, "<u2")
    assert len(repair_ids.compress(ids, np.arange(4) * 2001)) < ids.nbytes / 4


# Language.


def test_language_held_out_accuracy_and_unknown(spark):
    rng = random.Random(4)
    make = lambda pool: " ".join("".join(rng.choice(pool) for _ in range(2)) for _ in range(60))
    pools = {"xx": ["the", "ing", "er", "on"], "yy": ["sch", "ung", "ein", "ü"], "zz": ["que", "eau", "é", "oi"]}
    data = [(k, make(pools[lang]), lang) for k, lang in enumerate(list(pools) * 60)] + [(900, None, "xx"), (901, "12 34!", "yy"), (902, "theingeron", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    out = [got[k].lang_pred == lang for k, _, lang in data[:180] if got[k].held_out]
    assert sum(out) / len(out) > 0.95
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred) == ("und", 0.0, "und")
    assert got[902].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got.values())


def test_cosine_equals_that_of_whole_vectors():
    prototypes = {"a": language.trigram_vectors(np.array([70, 80, 90])).sum(0).astype(float), "b": language.trigram_vectors(np.array([5000, 6000])).sum(0).astype(float)}
    text = "some words, and some more words of it " * 5
    owner, grams, _ = language._trigrams([text])
    vector = language.trigram_vectors(grams).astype(float).sum(0)
    names, scores = language.Classifier(prototypes).predict([text])
    exact = {k: vector @ v / np.linalg.norm(vector) / np.linalg.norm(v) for k, v in prototypes.items()}
    assert names[0] == max(exact, key=exact.get) and scores[0] == pytest.approx(max(0, max(exact.values())), abs=1e-12)
    assert (language.Classifier(prototypes).bundles([text, None, "other words"])[0][0] == vector).all()


@pytest.mark.parametrize("pools", [["абвгеж", "зидкон"], ["αβγδ", "εζηθ"], ["日月火水", "山川田人"]])
def test_languages_of_one_script_are_told_apart(spark, pools):
    if pools[0] == "абвгеж":  # letter by letter those that six codes by hash can't tell apart
        assert all((ord(a) * 2654435761 >> 7) % 6 == (ord(b) * 2654435761 >> 7) % 6 for a, b in zip(*pools, strict=True))
    rng = random.Random(6)
    shapes = [[rng.randrange(len(pools[0])) for _ in range(rng.randrange(2, 7))] for _ in range(300)]
    data = []
    for k in range(120):  # both languages have the same words but for the letters
        data.append((k, " ".join("".join(pools[k % 2][i] for i in rng.choice(shapes)) for _ in range(30)), f"l{k % 2}"))
    got = language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).where("held_out").collect()
    assert len(got) > 10 and all(r.lang_pred == f"l{r.doc_id % 2}" for r in got)


def test_a_corpus_without_labels_stays_as_it_is(spark):
    rows = [(1, "the cat sat on the mat", None, "s", 0), (2, "12", "en", "s", 0), (3, None, None, None, None)]
    out = language.keep_known(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3] and out.columns == [x.split()[0] for x in DOCS.split(", ")]


def test_products_are_forgotten_not_lost(monkeypatch):
    rng = np.random.default_rng(3)
    prototypes = {"a": rng.normal(size=language.DIMENSIONS), "b": rng.normal(size=language.DIMENSIONS)}
    texts = [words(random.Random(k), 40, "abcdefghжщы日") for k in range(12)]
    want = language.Classifier(prototypes).predict(texts)
    monkeypatch.setattr(language, "MOST_KNOWN", 50)
    monkeypatch.setattr(language, "PART", 40)
    small = language.Classifier(prototypes)
    got = [small.predict([x]) for x in texts]
    assert len(small._known) <= 50 and [n[0] for n, _ in got] == want[0] and [s[0] for _, s in got] == pytest.approx(want[1])


# N-gram join.


def brute_classes(rows, t=0.8):
    sets = []
    for i, x, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for a, r in enumerate(rows):
        least.setdefault(find(a), []).append(r[0])
    return sorted(((rows[a][0], min(least[find(a)], key=lambda v: (v is not None, v or 0)), links[a]) for a in range(len(rows))), key=str)


def test_join_equals_brute_force(docs, rows):
    got = ngram_join.join(docs).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_classes(rows)


def test_keep_one_of_each_class(docs, rows):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {c for i, c, _ in brute_classes(rows)}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, classes))


@pytest.mark.parametrize("ids", [(None, None, None), (7, 7, 7), (7, None, 7)])
def test_keep_one_where_ids_are_null_or_repeat(spark, ids):
    w = words(random.Random(9), 300).split()
    near = [" ".join(w), " ".join(w[:-1] + ["other"]), "  ".join(w)]  # the last has the set of the first
    alone = [(ids[0], "quite another text with some words of its own", "alone"), (ids[0], "", "bare"), (ids[0], "", "bare")]
    rows = [(i, x, "near") for i, x in zip(ids, near, strict=True)] + [(ids[0], near[0], "near")] + alone
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()
    assert sorted(r.kind for r in kept) == ["alone", "bare", "bare", "near"]
    assert next(r.doc_id for r in kept if r.kind == "near") == (None if None in ids else 7)


def test_pieces_of_a_group_cover_each_pair_once(spark):
    members = spark.createDataFrame([(1, k) for k in range(700)], "band long, sid long")
    dealt = ngram_join._blocks(members, "band", spark.createDataFrame([(1, 700)], "band long, size long")).collect()
    seen = {}
    for r in dealt:
        seen.setdefault((r.low, r.high), []).append((r.sid, r.upper))
    pairs = 0
    for (low, high), m in seen.items():
        a, b = sum(not u for _, u in m), sum(u for _, u in m)
        pairs += a * (a - 1) // 2 if low == high else a * b
    assert pairs == 700 * 699 // 2


def test_pruning_keeps_what_reaches_the_threshold():
    need = ngram_join.least_matches()
    assert list(need) == sorted(need)
    rng = np.random.default_rng(0)
    kept = 0
    for _ in range(300):
        left = rng.integers(0, 256, 128).astype(np.uint8)
        right = np.where(rng.random(128) < 0.8, left, rng.integers(0, 256, 128)).astype(np.uint8)
        kept += ngram_join.prune(left[None], right[None], need)[0, 0]
    assert kept == 300
    strangers = rng.integers(0, 256, (40, 128)).astype(np.uint8)
    assert ngram_join.prune(strangers, strangers, need).sum() == 40


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_forest_finds_components(edges):
    linked = np.zeros((31, 31), bool)
    for a, b in edges:
        linked[a, b] = linked[b, a] = True
    root = ngram_join.forest(linked)
    assert all(root[a] == root[b] for a, b in edges) and all(root[k] <= k for k in range(31))


@pytest.mark.parametrize("few", [0, 20_000])
def test_components_of_a_long_path(spark, monkeypatch, few):
    monkeypatch.setattr("priorline.llm.components.FEW_EDGES", few)
    got = components(spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")).collect()
    assert {r.label for r in got if r.node <= 60} == {0} and {r.label for r in got if r.node >= 100} == {100}


# HTML.

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=x>A</a><li><a href=y>B</a></ul></nav><div class="cookie-notice">We use cookies, ok?</div><div class="content"><h2>The title</h2>
<p>First text, with a <a href=q>link</a> &amp; more&nbsp;of it. It goes on, and on.<p>Second<br>line, which is long, too.<ul><li>One</li><li>Two</ul><p>Short.</p>
<div class="ad">Buy now, cheap!</div><form><label>Name</label><input></form><p>The last, and done, finally.</div><div id="comments"><p>Nice, I liked it, a lot!</p></div>
<aside><p>Related, more, of it.</p></aside><footer>c, d</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE).split("\n\n") == [
        "The title", "First text, with a link & more of it. It goes on, and on.", "Second line, which is long, too.", "One", "Two", "Short.", "The last, and done, finally.",
    ]


@pytest.mark.parametrize("page, text", [("", ""), ("<p>", ""), ("plain", "plain"), ("<p>a</p><script>x<", "a"), ("<p>cut <a hre", "cut"), ("<nav>m</nav>", ""), ("<!-- <p>no</p> --><p>yes, it is.</p>", "yes, it is.")])
def test_html_edges(page, text):
    assert html_text.main_text(page) == text


def made_page(rng, scramble=False):
    """A page of a known article among navigation, adverts, a sidebar, comments and a footer."""
    name = (lambda x: f"q{rng.randrange(1000)}") if scramble else (lambda x: x)
    line = lambda n: (words(rng, n) + ".").capitalize()
    paragraph = lambda: " ".join(line(rng.randrange(6, 14)).replace(" ", ", ", 1) for _ in range(rng.randrange(2, 6)))
    article = [line(5)[:-1], *(paragraph() for _ in range(rng.randrange(3, 9)))]
    inner = f"<h1>{article[0]}</h1>" + "".join(f"<p>{x}</p>" for x in article[1:])
    menu = "<ul>" + "".join(f"<li><a href=/{k}>{words(rng, 1)}</a></li>" for k in range(8)) + "</ul>"
    return article, (
        f"<html><head><title>t</title><script>var x = '<p>';</script></head><body><div class={name('top-menu')}>{menu}</div><div class={name('ad')}>{line(4)}</div>"
        f"<div class={name('text')}>{inner}</div><div class={name('sidebar')}><ul><li>{line(2)}</li><li>{line(3)}</li></ul></div><footer>{line(5)}</footer></body></html>"
    )


@pytest.mark.parametrize("scramble", [False, True])
def test_article_is_found_by_its_ratios(scramble):
    rng = random.Random(21)
    for _ in range(60):
        article, page = made_page(rng, scramble)
        assert html_text.main_text(page).split("\n\n") == article


LONG = "A long sentence, with commas in it, goes on for some time and then it ends. "


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><form id=aspnetForm><input type=hidden><article><p>{LONG}</p></article></form></body>", [LONG]),
        (f"<body><form id=f><div id=menu><a href=x>Home</a></div><div class=body><h2>T</h2><p>{LONG * 3}</p><label>Name</label></div></form></body>", ["T", LONG * 3]),
        (f"<article><h1>T</h1><p>{LONG * 3}</p><form><p>Subscribe, please.</p><input></form></article>", ["T", LONG * 3]),
        (f"<ul><li><a href=x>Home</a></li></ul><div class=body><h1>Brief</h1><p>Only this.</p></div><div class=foot><p>{LONG * 3}</p></div>", ["Brief", "Only this."]),
        (f"<ul><li><a href=x>Home</a></li></ul><article><h1>Brief</h1><p>Only this.</p></article><div class=legal><p>{LONG * 3}</p></div>", ["Brief", "Only this."]),
        (f"<article><h1>T</h1><p>{LONG * 4}</p><div class=comments>{f'<p>{LONG * 3}</p>' * 3}</div></article>", ["T", LONG * 4]),
        (f"<div class=story><h1>T</h1>{f'<p>{LONG * 3}</p>' * 3}</div><div class=comments>{f'<div class=comment><p>{LONG * 4}</p></div>' * 8}</div>", ["T", *[LONG * 3] * 3]),
        (f"<div class=story><h1>T</h1>{f'<p>abcd {LONG * 3}</p>' * 3}</div><div class=comments>{f'<div class=comment><p>{LONG * 4}</p></div>' * 8}</div>", ["T", *["abcd " + LONG * 3] * 3]),
        (f"<div id=c><div class=sec><h2>A</h2><p>{LONG * 6}</p></div><div class=sec2><h2>B</h2><p>short one, ok.</p></div></div>", ["A", LONG * 6, "B", "short one, ok."]),
    ],
)
def test_pages_of_other_shapes(page, text):
    assert html_text.main_text(page) == "\n\n".join(x.strip() for x in text)


def test_scores_decide():
    _, page = made_page(random.Random(22))
    blocks = html_text.blocks_of(page)
    assert len(blocks) > len(html_text.main_text(page).split("\n\n"))  # without scores all blocks would stay
    assert html_text.main_text('<div class="post search"><p>Some words, here.</p><p>And more.</p></div>') == "Some words, here.\n\nAnd more."
    assert html_text.main_text('<div class="notice-board story"><p>Some words, here.</p></div>') == "Some words, here."


def test_path_scores_equal_their_definition():
    rng = random.Random(23)
    for _ in range(20):
        blocks = html_text.blocks_of(made_page(rng)[1])
        n = len(blocks)
        mean = lambda f: [b.weight ** (f is size) * sum(f(c) for c in blocks if c.path == b.path) / sum(c.path == b.path for c in blocks) for b in blocks]  # noqa: E731, B023
        size = lambda b: max(0, len(b.text) - b.links)
        points = lambda b: sum(c in ".,;:!?" for c in b.text) * (b.links < len(b.text))
        near = lambda v: [sum(v[j] * np.exp(-((i - j) ** 2) / 2) for j in range(n) if abs(i - j) <= 3) / sum(np.exp(-((i - j) ** 2) / 2) for j in range(n) if abs(i - j) <= 3) for i in range(n)]
        own = mean(size)
        fused = [min(x, 2 * o) * (y + html_text.LEAST_MARKS) for x, o, y in zip(near(own), own, near(mean(points)))]
        for path, score in html_text.path_scores(blocks).items():
            assert score == pytest.approx(np.mean([f for f, b in zip(fused, blocks) if b.path == path]))


def test_html_rows(spark):
    got = html_text.extract(spark.createDataFrame([(1, "u", None), (2, None, PAGE), (2, None, PAGE)], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.n_chars) for r in got)[0] == (1, 0) and len(got) == 3
    long = "<p>" + "</p><p>".join(f"Line {k}, of many." for k in range(20_000)) + "</p>"
    big = spark.createDataFrame([((1 << 60) + 1, "u", long, "more"), (None, "u", "<p>a", "more")], "page_id long, url string, html string, text string")
    got = html_text.extract(big).collect()
    assert {r.page_id for r in got} == {(1 << 60) + 1, None} and max(r.text.count("Line") for r in got) == 20_000


# Media.


def test_media_rows(docs, rows):
    got = media.audio_features(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for i, x, *_ in rows:
        b = (x or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want[i] = (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert all(want[r.doc_id] == (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)
    same = {r.doc_id: (r.media_sha256, r.feature) for r in got}
    assert same[100] == same[101] and same[100] != same[403]


def test_media_resynchronises_and_counts_damage():
    payload = bytes(range(256)) * 40
    stream = media.wrap(payload)
    whole = media.read_stream(b"junk\xff\xfbzz" + stream + b"TAG" + bytes(125))
    assert (whole.payload, whole.skipped, whole.bad_checksums) == (payload, 8, 0)
    assert whole.table[0] == len(whole.offsets) and whole.seconds == whole.samples / 32000
    first = stream.index(b"\xff\xfa", 60)
    damaged = bytearray(stream)
    damaged[first + 1440 + 10] ^= 1
    assert media.read_stream(bytes(damaged)).bad_checksums == 1


def test_seek_offsets_are_frames():
    stream = media.wrap(bytes(64) * 500)
    found = media.read_stream(stream)
    tag = len(stream) - found.table[1]
    assert all(stream[tag + o : tag + o + 2] == b"\xff\xfa" for o in found.offsets)


def test_all_frames_of_the_stored_stream_can_be_sought(spark):
    text = words(random.Random(10), 60_000)
    r = media.audio_features(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).where("doc_id = 1").head()
    tag = 10 + int.from_bytes(r.media[6:10], "big")
    assert len(r.seek_offsets) == r.n_frames > 200 and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert all(r.media[tag + o : tag + o + 2] == b"\xff\xfa" for o in r.seek_offsets) and len(set(r.seek_offsets)) == r.n_frames
    assert f"seek {zlib.crc32(','.join(map(str, r.seek_offsets)).encode()):08x}" in r.feature
    assert media.read_stream(bytes(r.media)).payload.rstrip(b"\0").decode() == text


# Pipeline.


def test_columns_that_clash_come_back(docs):
    clash = [("uid", "u"), ("mark", "m"), ("start", "s"), ("end", "e"), ("size", "z"), ("digits", "d"), ("taken", "t"), ("rank", "r"), ("names", "n"), ("lang_pred", "p"), ("score", "q"), ("sets", "x"), ("own_0", "o")]
    more = docs.dropDuplicates(["doc_id"]).withColumns({k: F.lit(v) for k, v in clash})
    for f in (suffix_dedup.apply_dedup, ngram_join.keep_one, mixing.apply_mix, language.keep_known):
        out = f(more)
        assert out.columns == more.columns
        assert all(r[k] == v for r in out.collect() for k, v in clash)
    assert {r["size"] for r in mixing.mix(more).collect()} > {0}


def test_pipeline_equals_brute_force(spark, docs, tmp_path):
    import duckdb

    import corpus_pipeline

    table = docs.dropDuplicates(["doc_id"])
    told = [tuple(r) for r in table.collect()]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        table = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append([tuple(r) for r in table.collect()])
    by_id = lambda rows: sorted(((r[0], r[1]) for r in rows), key=str)
    # Language: what has a letter stays. Near copies: the first of each class stays.
    told = [r for r in told if any(c.isalpha() for c in r[1] or "")]
    assert by_id(seen[0]) == by_id(told)
    first = {c for _, c, _ in brute_classes(told)}
    told = [r for r in told if r[0] in first]
    assert by_id(seen[1]) == by_id(told)
    # Repeated text: cut, and gone where nothing is left.
    cuts = {i: kept.decode("utf-8", "ignore") if runs else None for i, _, _, runs, kept in brute_cuts(told, suffix_dedup.PASSAGE)}
    told = [(r[0], r[1] if cuts[r[0]] is None else cuts[r[0]], *r[2:]) for r in told if cuts[r[0]] is None or cuts[r[0]].strip()]
    assert by_id(seen[2]) == by_id(told)
    # Mixing: the words that the operator's SQL takes.
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/2/*.parquet'")
    mixed = []
    for doc_id, _, size, _, _, taken in con.execute(mixing.ORACLE).fetchall():
        text = next(r[1] for r in told if r[0] == doc_id)
        words = re.findall(mixing.WORD, text)
        if taken:
            mixed.append((doc_id, "\n".join([text] * (taken // size) + ([" ".join(words[: taken % size])] if taken % size else []))))
    assert by_id(seen[3]) == by_id(mixed)
    # Packing: all pieces of all documents, gapless in sequences.
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in mixed:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want += [(doc_id, j, a, n, zlib.crc32(ids[a : a + n].tobytes())) for j, (a, n) in enumerate(packing.cut(len(ids)))]
    assert sorted((r[:5] for r in seen[4]), key=str) == sorted(want, key=str)
    at = {}
    for r in sorted(seen[4], key=lambda r: (r[5], r[6])):
        assert r[6] == at.get(r[5], 0)
        at[r[5]] = r[6] + r[3]
    assert max(at.values()) <= packing.CAPACITY


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    path = f"{tmp_path}/documents.parquet"
    docs.dropDuplicates(["doc_id"]).write.parquet(path)
    table = spark.read.parquet(path)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}")
            table = spark.read.parquet(f"{tmp_path}/{k}")
    assert out.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()
