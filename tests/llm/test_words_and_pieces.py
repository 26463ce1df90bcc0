"""Source divergence, word runs and sentence pieces against brute force and the library, on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from priorline.llm import divergence, sentence_pieces, word_runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and odd texts, repeated rows and words, long terms, long texts, ties."""
    rng = random.Random(3)
    pool = ["Alpha", "beta", "gamma", "ab", "x", "internationalisation", "Donaudampfschifffahrt", "straße", "naïveté", "ÄÖÜ", "日本語" * 9, "q" * 70, "it's", "e5e"]
    out = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None]), f"s{k % 4}", 0) for k in range(60)]
    out += [(100, None, None, None, None), (101, "", "fr", "s1", 0), (102, " \n\t 12 -", "fr", "s9", 0), (103, "one two", "", "", 0), (None, "no id", "en", "s1", 0)]
    out += [(104, "say it " * 40 + "once", "en", "s1", 0), (105, "a b c " * 9 + "d " + "a b c " * 9, "en", "s1", 0), (106, "word\n" * 3000, "en", "s0", 0)]
    out += [(107, "ﬁ  é Å　x\t▁a\x01 😀", "en", "s2", 0)] * 3 + [(108, "z" * 5000 + " " + "é" * 700, "en", "s2", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_they_take_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    for f in (divergence.audit, word_runs.collapse, word_runs.runs, sentence_pieces.digests):
        assert f(empty).count() == 0


# Source divergence.


def brute_audit(rows):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= 3}

        def profile(parts, kept=kept):
            n = Counter(t for d in parts for t in d[2] if t in kept)
            return n, {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}

        whole = profile(mine)[1]
        groups = {s: profile([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for s, (n, p) in groups.items():
            pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, (_, q) in groups.items() if o != s]
            terms = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if n[t] and p[t] > whole[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < 200]
    return sorted(out)


def test_audit_equals_brute_force_and_sql(docs, rows):
    got = sorted(tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(rows)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    assert sorted(con.execute(divergence.ORACLE).fetchall()) == got


def test_sums_that_a_task_does_not_hold_are_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_CELLS", 1)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 8)
    got = sorted(tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(rows)


@given(st.lists(st.text(alphabet="abAB é\0z9日", max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_runs_of_terms_are_counts(texts):
    raw = [x.encode() for x in texts]
    groups = np.arange(len(raw)) % 2
    got = divergence.count_runs(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64), groups)
    want = {}
    for d, x in enumerate(raw):
        for t, n in Counter(re.findall(rb"[A-Za-z\x80-\xff]+", x)).items():
            key = (re.sub(rb"[A-Z]", lambda m: m[0].lower(), t), d % 2)
            want.setdefault(key, Counter())[d] += n
    merged = {k: (sum(v.values()), len(v)) for k, v in want.items()}
    assert {(t, g): (n, d) for t, g, n, d in zip(got[0], *(x.tolist() for x in got[1:]), strict=True)} == merged


@given(st.integers(0, 10**12), st.integers(0, 10**12))
def test_shares_are_exact(count, more):
    size = count + more + 1
    assert divergence.shares(np.array([count]), np.array([size])).tolist() == [1 + 10**9 * (count + 1) // size]


# Word runs.


def brute_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            if size >= max(least, 2 * q) and not any(all(w[k] == w[k + d] for k in range(s, s + size - d)) for d in range(1, q)):
                out.append((s, size, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_collapse_equals_brute_force(docs, rows):
    got = sorted((tuple(r) for r in word_runs.collapse(docs).collect()), key=str)
    short = [(i, x) for i, x, *_ in rows if not x or len(x) < 10_000]
    assert [r for r in got if r[0] != 106] == sorted((brute_collapse(i, x) for i, x in short), key=str)
    long = next(r for r in got if r[0] == 106)
    assert zlib.crc32(b"106") % 10 and long[1:6] == (1, 0, 3000, 1, 3_000_000) and long[7] == hashlib.sha256(b"word").hexdigest()


@given(st.lists(st.lists(st.integers(0, 2), max_size=50), max_size=5), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_runs_of_documents_equal_brute_force(texts, period):
    texts = [*texts, *([x[i % period % len(x)] for i in range(60)] for x in texts if x)]
    bounds = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
    rows, owner = word_runs.document_runs(np.array([w for x in texts for w in x], np.int64), bounds)
    for d, x in enumerate(texts):
        assert [tuple(r) for r in rows[owner == d].tolist()] == brute_runs(x)


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=200, deadline=None)
def test_groups_are_longest_lyndon_words(w):
    lengths, group = word_runs.lyndon_groups(np.array(w, np.int64))
    want = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        want.append(j - i)
    assert lengths.tolist() == want
    words = [tuple(w[i : i + n]) for i, n in enumerate(want)]
    assert all((group[i] == group[j]) == (words[i] == words[j]) for i in range(len(w)) for j in range(i))


def test_long_stretches_and_many_blocks(monkeypatch):
    rng = random.Random(8)
    base = [rng.randrange(5000) for _ in range(4000)]
    texts = [base * 5, [7] * 9000, base[:700] * 2 + [5001] + base[:700] * 2]
    monkeypatch.setattr(word_runs, "SORTED_AT_ONCE", 1000)
    rows, owner = word_runs.document_runs(np.array(sum(texts, []), np.int64), np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64))
    assert [(d, *r) for d, r in zip(owner.tolist(), rows.tolist(), strict=True)] == [(0, 0, 20000, 4000), (1, 0, 9000, 1), (2, 0, 1400, 700), (2, 1401, 1400, 700)]


# Sentence pieces.


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return SentencePieceProcessor(model_file=public_tokenizers.path(sentence_pieces.MODEL))


def same_ids(texts, library):
    ids, bounds = sentence_pieces.encoder().many(pa.array(texts, pa.string()))
    return all(ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(x or "") for k, x in enumerate(texts))


def test_digests_equal_the_library(docs, rows, library):
    got = sorted((tuple(r) for r in sentence_pieces.digests(docs).collect()), key=str)
    want = []
    for i, x, *_ in rows:
        ids = library.encode(x or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


@given(st.lists(st.text(max_size=40) | st.text(alphabet=" abcehilnorst=-\n▁é", max_size=60), max_size=8))
@settings(max_examples=200, deadline=None)
def test_ids_of_any_texts_equal_the_library(library, texts):
    assert same_ids(texts, library)


def test_joined_pieces_equal_the_library(library):
    """Words made of pieces have the most ways to merge."""
    rng = random.Random(4)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    assert same_ids(["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + ["a" * 999, "=" * 301, " " * 77, None, ""], library)
