"""Near duplicates against all pairs by brute force, and the parts on their own."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rollframe.llm import near
from rollframe.llm.components import components

SF = "/root/testdata/sf0.001"


def bag(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def brute_classes(rows):
    """rows: (doc_id, text). Smallest doc_id of each class, by all pairs that share a run."""
    bags = [bag(t) for _, t in rows]
    holders, parent = defaultdict(list), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, b in enumerate(bags):
        for s in b:
            holders[s].append(i)
    pairs = {(x, y) for h in holders.values() for x in h for y in h if x < y}
    for x, y in pairs:
        if len(bags[x].keys() & bags[y].keys()) >= 0.3 * len(bags[x].keys() | bags[y].keys()) and similarity(bags[x], bags[y]) >= 0.8:
            parent[max(root(x), root(y))] = min(root(x), root(y))
    return [rows[root(i)][0] for i in range(len(rows))]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    want = dict(zip([r[0] for r in rows], brute_classes(rows)))
    got = {r.doc_id: r.class_id for r in near.near_duplicates(docs)[0].collect()}
    assert got == want
    assert len(set(want.values())) < len(want)


def test_chains_across_a_bucket(spark):
    """Ends of a chain that only link through the middle are one class."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
    rows = []
    for i in range(6):
        own = list(words)
        for j in range(i * 9):
            own[j] = f"x{j}"
        rows.append((i, " ".join(own)))
    rows += [(10 + i, f"unlike {i} " + " ".join(f"v{i}_{k}" for k in range(40))) for i in range(4)]
    got = {r.doc_id: r.class_id for r in near.near_duplicates(table(spark, rows))[0].collect()}
    assert got == dict(zip([r[0] for r in rows], brute_classes(rows)))
    assert [got[i] for i in range(6)] == [0] * 6


def test_defined_cases(spark):
    long = " ".join(f"t{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, "!!"), (4, "A b"), (5, "a, B"), (None, "a b"), (None, "other words here that differ"), (7, long), (8, long + " end"),
            (9, "one two three four five six"), (9, "one two three four five six")]
    docs = table(spark, rows).selectExpr("*", "1 as fp", "2 as node", "3 as id", "4 as class_id")
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in near.near_duplicates(docs)[0].collect()), key=str)
    assert got == sorted([(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 3), (5, 4, 3), (None, 4, 3), (None, None, 1), (7, 7, 2), (8, 7, 2), (9, 9, 2), (9, 9, 2)], key=str)
    kept = near.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.text[:9] if r.text else r.text) for r in kept.collect()], key=str) == sorted(
        [(1, None), (2, ""), (3, "!!"), (4, "A b"), (None, "other wor"), (7, "t0 t1 t2 "), (9, "one two t")], key=str)
    assert near.near_duplicates(table(spark, []))[0].count() == 0


def test_exact_similarity():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (Counter({int(k): int(v) for k, v in zip(rng.choice(30, 12, replace=False), rng.integers(1, 6, 12))}) for _ in range(2))
        pack = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert near.probability_jaccard(*pack) == pytest.approx(similarity(a, b), abs=1e-12)


def test_registers_agree_as_often_as_the_similarity():
    rng, agree, want = np.random.default_rng(3), [], []
    for _ in range(60):
        runs = rng.integers(1, 1 << 63, 80, dtype=np.uint64)
        w = [rng.integers(1, 5, 80), rng.integers(1, 5, 80)]
        part = [slice(0, 60), slice(15, 80)]
        sig = near.signatures(np.repeat([0, 1], [60, 65]), np.concatenate([runs[p] for p in part]), np.concatenate([x[p] for x, p in zip(w, part)]), 2)
        agree.append((sig[0] == sig[1]).mean())
        bags = [Counter(dict(zip(runs[p].tolist(), x[p].tolist()))) for x, p in zip(w, part)]
        want.append(similarity(*bags))
    assert np.mean(agree) == pytest.approx(np.mean(want), abs=0.02)


def test_sketches_of_short_linked_texts_stay_within_the_bound(spark):
    """Texts of 5 to 30 runs at the threshold, also with repeated ones: no pair is turned away."""
    rng, rows = np.random.default_rng(4), []
    for i in range(600):
        n = (5, 10, 16, 27)[i % 4]
        words = [f"w{k}" for k in rng.integers(0, 10**6, n + 4)]
        if i % 8 > 3:
            words += words[:9]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: -max(1, n // 5)]))]
    linked = [i for i in range(0, len(rows), 2) if similarity(bag(rows[i][1]), bag(rows[i + 1][1])) >= 0.8]
    assert len(linked) > 300
    got = {r[0]: r[1:] for r in near.sketch(spark.createDataFrame(rows, "id long, text string")).collect()}
    differ = [sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(got[i], got[i + 1])) for i in linked]
    assert max(differ) <= near.most_differing(0.8)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
