"""Substring dedup, decontamination, licences and top-k: SQL twins, brute force, defined cases."""

import hashlib
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "scripts"))
from compare import connect, rows_of  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rollframe.llm import decontaminate, licenses, substring, topk  # noqa: E402
from rollframe.llm.queries import ORACLES, QUERIES  # noqa: E402
from rollframe.llm.words import NOT_BLANK, Words, span_hashes  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    df, twin = QUERIES[name](spark, SF), connect(SF).sql(ORACLES[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(twin.columns, twin.fetchall())


def brute_substring(rows, length):
    """rows in doc order: kept words of each."""
    seen, out = set(), []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - length + 1):
            key = tuple(words[s: s + length])
            if key in seen:
                gone[s: s + length] = True
            seen.add(key)
        out.append((len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def test_substring_on_dense_repeats(spark, monkeypatch):
    """Few words and short windows: repeats overlap, nest, repeat inside a text and run into each other."""
    rnd = random.Random(6)
    pool = [" ".join(rnd.choice("abc") for _ in range(30)) for _ in range(6)]
    rows = [(i, " \n".join(rnd.choice(pool) + " " + " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(12))) for _ in range(rnd.randrange(1, 5))))
            for i in range(120)] + [(200, "z " * 300), (201, "é ü " * 40), (202, " ".join(pool[0].split()[:7]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for frequent in (1 / 5000, 1.0):
        monkeypatch.setattr(substring, "FREQUENT", frequent)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup_substrings(docs, 8, 3).collect()}
        assert [got[i] for i, _ in rows] == brute_substring(rows, 8)


def test_substring_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, long), (4, "x " + long), (None, "a b " * 30), (5, "c d e"), (6, "a b " * 30), (6, "a b " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as at", "2 as anchor", "3 as doc", "4 as kept")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(docs).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1] == got[2] == (0, 0, digest(""))
    assert got[3] == (60_000, 0, digest(long)) and got[4] == (60_001, 60_000, digest("x"))
    assert got[None] == (60, 58, digest("a b"))  # the first two windows are new, then all repeat
    assert got[6] == (60, 60, digest(""))
    assert substring.dedup_substrings(docs.filter("doc_id = 6")).count() == 2
    assert substring.dedup_substrings(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring.repeated_windows(docs, 5, 6)


def brute_shared_ids(rows, length):
    """rows in any order, ids may repeat: only a smaller (id, place) makes a window a repeat."""
    places, out = {}, []
    texts = [(-1 if doc is None else doc, (text or "").split()) for doc, text in rows]
    for doc, words in texts:
        for s in range(len(words) - length + 1):
            key = tuple(words[s: s + length])
            places[key] = min(places.get(key, (doc, s)), (doc, s))
    for (doc_id, _), (doc, words) in zip(rows, texts):
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - length + 1):
            if places[tuple(words[s: s + length])] < (doc, s):
                gone[s: s + length] = True
        out.append((doc_id, len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def test_substring_rows_that_share_an_id(spark, monkeypatch):
    """Null and repeated ids: texts of different length, clean ones, and repeated rows."""
    rnd = random.Random(9)
    pool = [" ".join(rnd.choice("abc") for _ in range(30)) for _ in range(4)]
    rows = [(rnd.choice([None, None, 3, 7, i]), " ".join(rnd.choice(pool) + " " + " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(12)))
                                                          for _ in range(rnd.randrange(1, 5)))) for i in range(10, 90)]
    rows += [(None, " ".join(f"clean{i}_{k}" for k in range(n))) for i, n in enumerate((8, 40, 200))]
    rows += rows[:9] + [(None, None), (None, ""), (5, " ".join(f"own{k}" for k in range(50)))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for frequent in (1 / 5000, 1.0):
        monkeypatch.setattr(substring, "FREQUENT", frequent)
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.dedup_substrings(docs, 8, 3).collect()]
        assert sorted(got, key=str) == sorted(brute_shared_ids(rows, 8), key=str)


def test_substring_tells_extents_apart_whose_upper_halves_are_equal(spark, monkeypatch):
    """Two texts around one anchor that have nothing else in common."""
    texts = ["71 99f 751 1c9 e0 503 774 624 1c2 78e ba0 a7e 14a 7ab a 951 a23 d32 5e 88d",
             "56e 999 71b dc3 8c 59 bbf 624 1c2 78e ba0 a7e 14a 28f 1c2 6e3 b74 30e 3f a22"]
    words = Words(pa.array(texts), NOT_BLANK, False)
    hashes = words.hashes()
    place, start, n = substring.anchors(words, hashes, 20, 6)
    extent = span_hashes(hashes, "word", start, start + n + 19)
    assert place.tolist() == [7, 27] and extent[0] != extent[1] and extent[0] >> np.uint64(32) == extent[1] >> np.uint64(32)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, texts[1])], "doc_id long, text string")
    for hot in ([], substring._rows(docs.selectExpr("doc_id as doc", "0L as row", "text"), 20, 6).first()[:1]):
        monkeypatch.setattr(substring, "_frequent", lambda *_: list(hot))
        assert {r.doc_id: r.n_removed for r in substring.dedup_substrings(docs).collect()} == {0: 0, 1: 0, 9: 20}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for s in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[s: s + 13]), set()).add(str(item) if item is not None else "")
    out = []
    for doc, text in docs:
        w, found = words_of(text), set()
        hit = [False] * len(w)
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                names = windows.get(tuple(w[s: s + k]))
                if names:
                    found |= names
                    hit[s: s + k] = [True] * k
        n = sum(hit)
        out.append((doc, len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return out


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_contamination_by_brute_force(spark, block, monkeypatch):
    rnd = random.Random(7)
    text = lambda n: " ".join(rnd.choice(["the", "of", "cat", "Dog", "é1", "run"]) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 3, 12, 13, 14, 30]))) for i in range(12)] + [(3, text(20)), (None, text(15)), (50, None), (51, "..."), (52, ""), (53, text(13))]
    docs = [(i, text(rnd.randrange(0, 80)) + " " + (rnd.choice(items)[1] or "") + " " + text(5)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (None, items[5][1]), (103, items[5][1]), (103, items[5][1]), (104, text(50_000))]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as hits", "2 as items")
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as hits", "2 as items", "3 as n_hit", "4 as fp")
    monkeypatch.setattr(decontaminate.find_benchmark, "__defaults__", (13, 3, block, "doc_id"))
    got = decontaminate.contamination(table, bench).drop("items", "fp").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_contamination(docs, items), key=str)
    kept = decontaminate.drop_contaminated(table, bench)
    assert kept.columns == table.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(d) for d, *_, bad in brute_contamination(docs, items) if not bad)


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, none).collect()] == [(3, 0, False)]
    assert decontaminate.contamination(docs.limit(0), docs.selectExpr("doc_id as item_id", "text")).count() == 0


def brute_licenses(rows):
    tokens = [words_of(t) for _, t in rows]
    vocabulary = {w for text, _, _ in licenses.TEMPLATES for w in text.split()}
    frequency = {w: sum(w in set(t) for t in tokens) for w in vocabulary}
    index = licenses.index(len(rows), frequency)
    out = []
    for (doc, _), words in zip(rows, tokens):
        base = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i: i + len(phrase.split())] == phrase.split())
        starts = {}
        for i, w in enumerate(words):
            for t, word, p, weight in index:
                if w == word:
                    starts[t, i - p] = starts.get((t, i - p), 0) + weight
        best, own = 0.0, set()
        for (t, start), share in starts.items():
            text, label, phrases = licenses.TEMPLATES[t]
            for phrase in phrases:
                at = start + len(text[: text.index(phrase)].split())
                if round(share, 9) >= licenses.SHARE and at >= 0 and words[at: at + len(phrase.split())] == phrase.split():
                    own.add(label)
                    best = max(best, share)
        out.append((doc, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({b for _, b in base})),
                    ",".join(sorted(own | {b for _, b in base})), pytest.approx(min(1, max(best, 0.5 if base else 0)), abs=2e-6)))
    return out


def test_licenses_by_brute_force(spark):
    texts = [None, "", "MIT License", "the apache-license", "General Public\nLICENSE", "public license", "license", "mit mit license license",
             *(t.title() + "." for t, _, _ in licenses.TEMPLATES), *("x y " + t[:-12] for t, _, _ in licenses.TEMPLATES), "All rights. Reserved", "é mit license " * 300,
             "filler " * 30_000 + licenses.TEMPLATES[0][0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "mit license"), (2, "MIT License")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as words", "2 as row", "3 as places", "4 as base", "'z' as labels")
    got = sorted((tuple(r) for r in licenses.scan_licenses(docs).collect()), key=lambda r: (str(r[0]), r[1]))
    assert got == sorted(brute_licenses(rows), key=lambda r: (str(r[0]), r[1]))
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [dict(shard_rows=40, block_rows=3, leaf_rows=4), dict()])
def test_top_k_by_brute_force(spark, size):
    rng = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 8]) for i in range(300)] + [(1000, [0.5] * 5), (1000, [0.5] * 5), (1001, [1e15] * 5), (1100, [-1e14] * 5)]
    odd = [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0, 1.0]), (403, [1.0, float("nan"), 1.0, 1.0, 1.0]), (404, [float("inf")] * 5), (None, [1.0] * 5), (500, [1.0, 2.0]), (501, [2.0, 1.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as score", "3 as dim", "4 as shard")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_top_k(df, F.col("vec_id") % 100 == 0, 10, **size).collect()]
    clean = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in [*vectors, *odd] if i not in (400, 401, 402, 403, 404)]
    want = []
    for at, (q, v) in enumerate(clean):
        if q is not None and q % 100 == 0:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, c)))), i is None, i or 0)
                            for own, (i, c) in enumerate(clean) if own != at and len(c) == len(v))
            want += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:10])]
    near = lambda rows: sorted(str(r) for r in rows if r[0] < 1000)
    assert near(got) == near(want)
    assert Counter(r[:2] for r in got) == Counter(r[:2] for r in want) and sum(r[0] == 1000 for r in got) == 20
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
