"""Source divergence, line dedup and the Merkle manifest: brute force and defined cases.

Their SQL twins are run with all others in test_scans.py.
"""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollframe.llm import divergence, lines, manifest
from rollframe.llm.labelled import remainder

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
#: Names the operators use inside, and one that needs quoting.
CLASHES = ["doc", "h", "g", "n", "keeper", "batch", "pos", "drop", "fp", "term", "tree", "idx", "leaf", "level", "place", "tile", "a.b", "_fp"]


def with_clashes(docs):
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASHES])


# Line dedup

def brute_lines(rows, min_chars, min_docs):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = defaultdict(list)
    split = [(-1 if d is None else d, (t or "").split("\n")) for d, t in rows]
    key = lambda line: line.strip("\x20\t\n\x0b\x0c\r").translate(upper)
    for d, own in split:
        for k in {key(x) for x in own}:
            if len(k) >= min_chars:
                held[k].append(d)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, own in split:
        stay = [x for x in own if gone.get(key(x), d) == d]
        out.append((len(own), len(own) - len(stay), "\n".join(stay)))
    return out


LINE_ROWS = [(i, "\n".join(random.Random(i).choices(["Alpha beta", " alpha BETA\t", "gamma", "", "Äpfel über", "äpfel über", f"own {i}", "x" * 30], k=i % 9))) for i in range(60)]
LINE_ROWS += [(None, "Alpha beta\ngamma"), (None, None), (7, "Alpha beta\nAlpha beta"), (59, "alpha beta\n\n"), (61, "y\n" * 3000 + "gamma"), (62, ""), (62, ""), (63, "\n"), (64, "Alpha beta\r\nz")]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (9, 3)])
def test_lines_against_brute_force(spark, batches, fanout):
    docs = with_clashes(spark.createDataFrame(LINE_ROWS, "doc_id long, text string").repartition(5))
    got = lines.drop_repeated_lines(docs, min_chars=5, min_docs=3, batches=batches, fanout=fanout).collect()
    want = [(d, *r) for (d, _), r in zip(LINE_ROWS, brute_lines(LINE_ROWS, 5, 3))]
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))


def test_line_runs_hold_every_key_once(spark):
    index = lines.LineIndex(spark, fanout=2)
    for batch in range(7):
        rows = [(k, k % 5, batch, 1) for k in range(batch * 3, batch * 3 + 10)]
        new = index.add(spark.createDataFrame(rows, "h long, g int, keeper long, n long"))
        assert sorted(r.h for r in new.collect()) == (list(range(10)) if not batch else [batch * 3 + i for i in (7, 8, 9)])
    assert [len(level) for level in index.levels] == [1, 1, 1]
    held = [r for run in index.runs() for r in run.collect()]
    assert sorted(r.h for r in held) == list(range(28))
    assert all(r.keeper == max(0, (r.h - 7) // 3) for r in held)
    names = list(index.tables)
    index.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_lines_of_an_empty_table(spark):
    assert lines.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# Source divergence

@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
def test_gallop_and_merge(x, y):
    a, b = np.array(sorted(x), np.int64), np.array(sorted(y), np.int64)
    assert divergence.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()
    p, q = dict(zip(sorted(x), range(100, 600))), dict(zip(sorted(y), range(50, 950, 2)))
    want = sum(abs(p.get(t, 7) - q.get(t, 11)) for t in range(401))
    sides = (a, np.array(list(p.values()), np.int64), 7), (b, np.array(list(q.values()), np.int64), 11)
    assert divergence.merge(*sides, 401) == divergence.merge(*sides[::-1], 401) == want


def brute_divergence(rows, min_docs, top):
    term = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, seen = defaultdict(Counter), defaultdict(Counter)
    for source, lang, text in rows:
        words = term.findall((text or "").translate(upper))
        count[lang or "", source or ""].update(words)
        seen[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in count}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        own = {s: {t: c[t] for t in kept} for (x, s), c in count.items() if x == lang}
        price = lambda c, have: 1 + 10 ** 9 * (c + 5) // (sum(have.values()) + 5 * len(kept))
        whole = {t: sum(h[t] for h in own.values()) for t in kept}
        for s, mine in own.items():
            pairs = [(-sum(abs(price(mine[t], mine) - price(its[t], its)) for t in kept), o.encode()) for o, its in own.items() if o != s]
            terms = [(price(whole[t], whole) - price(mine[t], mine), t.encode()) for t in kept if mine[t] and price(mine[t], mine) > price(whole[t], whole)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return out


def divergence_rows():
    rnd = random.Random(4)
    pool = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(90)]
    rows = [(f"s{min(rnd.randrange(9), rnd.randrange(9))}", rnd.choice(["en", "de"]), " ".join(rnd.choices(pool, k=rnd.randrange(60))).title()) for _ in range(300)]
    return rows + [(None, None, None), (None, "en", "wa WA wa-wb"), ("empty", "en", ""), ("s1", "xx", "alone"), ("s2", "xx", "12 !"), ("long", "de", "wab " * 400_000)]


@pytest.mark.parametrize("block, tile", [(1 << 15, 16), (16, 2)])
def test_divergence_against_brute_force(spark, block, tile):
    rows = divergence_rows()
    docs = with_clashes(spark.createDataFrame(rows, "source string, lang string, text string").repartition(6))
    got = divergence.audit(docs, min_docs=20, top=7, block=block, tile=tile).collect()
    assert sorted(map(tuple, got)) == sorted(brute_divergence(rows, 20, 7))


def test_prices_are_exact_for_large_counts(spark):
    cases = [(c, n, v) for c in (0, 1, 999, 10 ** 12, 3 * 10 ** 15) for n in (3 * 10 ** 15, 9 * 10 ** 15) for v in (1, 10 ** 7)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.price("c", "n", "v").alias("p")).collect()
    for r in got:
        assert r.p == 1 + 10 ** 9 * (r.c + 5) // (r.n + 5 * r.v) == divergence.prices(np.array([r.c]), r.n, r.v)[0]


def test_divergence_of_tables_without_kept_terms(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    few = spark.createDataFrame([("a", "en", "x"), ("b", "en", "y")], "source string, lang string, text string")
    assert sorted(map(tuple, divergence.audit(few).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


# Merkle manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    def leaf(doc, source, lang, n, text):
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in (doc, source, lang, n, text)))

    def grow(digests):
        """The top, and of every leaf the siblings on its way up."""
        paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
        while len(level) > 1:
            for i, a in enumerate(at):
                run = level[a // 3 * 3: a // 3 * 3 + 3]
                paths[i].append((run[: a % 3], run[a % 3 + 1:]))
            level = [sha("".join(level[i: i + 3])) for i in range(0, len(level), 3)]
            at = [a // 3 for a in at]
        return level[0], paths

    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    out, subs = [], []
    for name in names:
        own = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        sub, paths = grow([leaf(*r) for r in own])
        subs.append(sub)
        out.append([(r, leaf(*r), sub, p) for r, p in zip(own, paths)])
    root, above = grow(subs)
    result = []
    for group, more in zip(out, above):
        for r, own, sub, path in group:
            now = own
            if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = leaf(*r[:4], r[4].replace("\n", ""))
            proof = ""
            for left, right in path + more:
                now = sha("".join(left) + now + "".join(right))
                proof += "".join(left + right)
            result.append((r[0], own, sub, root, sha(proof), now))
    return result


def manifest_rows(count, sources):
    rnd = random.Random(count)
    rows = [(i, rnd.choice(sources), rnd.choice([None, "en", ""]), rnd.choice([None, i]), rnd.choice([None, "", "é\n", f"a\nb{i}"])) for i in range(count)]
    return rows + [(None, sources[0], None, None, None), (3, sources[0], "x", 1, "two"), (3, sources[0], "x", 1, "two"), (3, sources[0], "x", 1, "one")]


@pytest.mark.parametrize("rows", [
    manifest_rows(900, ["hot"] * 6 + [None, "", "ä", "b", "Z"]), manifest_rows(300, [f"s{i}" for i in range(90)]), manifest_rows(260, ["only"]),
    [(1, "one", "en", 3, "a\nb")], [(1, "a", None, None, "x"), (2, "b", None, None, "y\n")], [(i, "s", None, None, "") for i in range(243)]])
def test_manifest_against_brute_force(spark, rows):
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(5))
    tampered = F.when(remainder(2) == 0, manifest.leaf_hash(text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    proof = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    got = manifest.prove(docs, tampered).select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256), "folded_root").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest(rows)))


def test_manifest_of_an_empty_table(spark):
    out = manifest.prove(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and "folded_root" in out.columns
