"""Bracketed selection, engine-side draws, exact order statistics and rank-test tails, line numbers."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollframe import distributed
from rollframe.distributed import exact_quantiles, first_rows
from rollframe.functions import draws, inference
from rollframe.operators import episodes, selection, statistics
from rollframe.sources import readers

PROBS = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p95": 0.95, "p99": 0.99, "high": 1.0}


def uneven():
    """A key with most rows, one value only, few rows, two rows, one row, and ties that hold a third."""
    rnd = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rnd.normal(size=30_000)] + [("one", 2.5)] * 5_000 + [("few", float(x)) for x in rnd.normal(size=37)]
    rows += [("two", 1.0), ("two", 2.0), ("single", 7.0), (None, 1.0), (None, 3.0)] + [("none", None)] * 3
    return rows + [("ties", float(x)) for x in np.concatenate([np.full(4_000, 0.5), rnd.random(8_000)])]


@pytest.mark.parametrize("sketch, bracket", [(10_000, 1 / 2_500), (50, 1 / 1_000_000)])
def test_quantiles_by_brackets(spark, monkeypatch, sketch, bracket):
    """Exact whatever the sketch; with a poor one the brackets miss and are widened."""
    monkeypatch.setattr(distributed, "SKETCH", sketch)
    monkeypatch.setattr(distributed, "BRACKET", bracket)
    monkeypatch.setattr(distributed, "LEAST_RANKS", 4 if sketch > 50 else 0)
    rows = uneven()
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: tuple(r)[1:] for r in exact_quantiles(df, ["k"], "v", PROBS).collect()}
    for key in {k for k, v in rows if v is not None}:
        want = np.quantile([v for k, v in rows if k == key and v is not None], list(PROBS.values()))
        assert got.pop(key) == pytest.approx(want, abs=1e-12)
    assert not got


def test_only_bracket_rows_are_written(spark, monkeypatch):
    written = []
    keep = distributed.stage
    monkeypatch.setattr(distributed, "stage", lambda df: written.append(keep(df)) or written[-1])
    rows = spark.range(200_000).select(F.lit("a").alias("k"), F.rand(5).alias("v"))
    exact_quantiles(rows, ["k"], "v", {"m": 0.5, "p": 0.99}).collect()
    assert max(w.count() for w in written) < 2_000


def test_whole_table_quantiles(spark):
    got = exact_quantiles(spark.range(1, 1001).withColumn("v", F.col("id") * 2), [], "v", {"m": 0.5}).first()
    assert got.m == 1001.0


@pytest.mark.parametrize("count", [1, 7, 900, 20_000])
def test_first_rows(spark, count):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("o"), F.lit("x").alias("other"))
    got = first_rows(df, "o", count).orderBy("_pos").collect()
    want = sorted(i * 7919 % 20_011 for i in range(20_000))[:count]
    assert [r.o for r in got] == want and [r._pos for r in got] == list(range(1, count + 1))


def test_first_rows_looks_at_no_more_than_it_needs(spark, monkeypatch):
    written = []
    keep = distributed.stage
    monkeypatch.setattr(distributed, "stage", lambda df: written.append(keep(df)) or written[-1])
    first_rows(spark.range(100_000).withColumnRenamed("id", "o"), "o", 50).collect()
    assert max(w.count() for w in written) <= 5_000


def brute_split(rows, train, validation, test):
    seen, out = set(f for _, f in train), []
    for seed, print_ in sorted(rows):
        if print_ not in seen and len(out) < validation + test:
            seen.add(print_)
            out.append((seed, print_, "validation" if len(out) < validation else "test"))
    return sorted([(s, f, "train") for s, f in train] + out)


def test_split_where_early_prints_are_taken(spark):
    """Almost all early candidates repeat or are trained on, so the bound has to move up."""
    rnd = random.Random(8)
    train = [(i, f"t{i % 50}") for i in range(100)]
    rows = [(1_000 + i, f"t{rnd.randrange(50)}" if rnd.random() < 0.6 else f"c{rnd.randrange(40)}") for i in range(9_000)]
    rows += [(20_000 + i, f"late{i % 300}") for i in range(900)]
    make = lambda r: spark.createDataFrame(r, "seed long, fingerprint string")
    got = selection.build_split(make(rows), make(train), "seed", 60, 90).collect()
    assert sorted(tuple(r) for r in got) == brute_split(rows, train, 60, 90)
    with pytest.raises(Exception, match="not enough disjoint items: 340"):
        selection.build_split(make(rows), make(train), "seed", 200, 141).collect()


def test_poisson_steps_and_large_means():
    """The table is the distribution function; the large form is within its stated error."""
    for rate in (0, 1, 5, 63):
        steps = draws.poisson_steps(rate)
        total = 0.0
        for k, t in enumerate(steps):
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate else float(k == 0)
            assert t == pytest.approx(total * 2 ** 31, abs=2)
    for rate in (64, 128, 4096, 10 ** 6):
        sd, worst, cdf = math.sqrt(rate), 0.0, 0.0
        low, high = max(0, int(rate - 8 * sd)), int(rate + 8 * sd)
        for k in range(low, high):
            cdf += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            # floor(rate + sd z + (z z - 1) / 6 + 1/2) is k at most up to this z.
            z = (-sd + math.sqrt(rate - 4 / 6 * (rate - 1 / 6 + 0.5 - (k + 1)))) * 3
            worst = max(worst, abs(cdf - 0.5 * math.erfc(-z / math.sqrt(2))))
        assert worst < 0.002


def test_draws_have_the_moments_of_poisson_counts(spark):
    rates = [1, 3, 63, 64, 100, 70_000]
    rows = spark.createDataFrame([(r, i) for i, r in enumerate(rates)], "n long, s long").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(19_999))))
    got = draws.poisson_draws(rows, "n", "s", "b", "w").groupBy("n").agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).collect()
    for r in got:
        assert r.m == pytest.approx(r.n, abs=5 * math.sqrt(r.n / 20_000)) and r.v == pytest.approx(r.n, rel=0.05)


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([("a" if i % 3 else None, float(i % 7)) for i in range(2_000)] + [("s", 4.0)], "k string, x double")
    one, other = (sorted(map(str, statistics.bootstrap_mean(rows.repartition(n), ["k"], "x", resamples=2_000).collect())) for n in (1, 9))
    assert one == other
    got = {r.k: r for r in statistics.bootstrap_mean(rows, ["k"], "x", resamples=4_000).collect()}
    for key in ("a", None):
        x = np.array([float(i % 7) for i in range(2_000) if ("a" if i % 3 else None) == key])
        half = 1.96 * x.std() / math.sqrt(len(x))
        assert got[key].ci_low == pytest.approx(x.mean() - half, abs=half / 5) and got[key].ci_high == pytest.approx(x.mean() + half, abs=half / 5)
    assert (got["s"].ci_low, got["s"].ci_high) == (4.0, 4.0)


def test_best_and_majority_over_all_subsets(spark):
    rnd = random.Random(5)
    groups = [[rnd.choice([0.0, 0.25, 1.0, -2.0][: rnd.randrange(1, 5)]) for _ in range(n)] for n in range(1, 9) for _ in range(4)]
    rows = [("src", f"p{i}", x) for i, g in enumerate(groups) for x in g]
    got = {r.metric: r.metric_value for r in episodes.validation_metrics(spark.createDataFrame(rows, "s string, p string, reward double"), "s", "p", ["reward"]).collect()}
    want = {}
    for g in groups:
        for size in {2 ** i for i in range(4) if 2 ** i < len(g)} | {len(g)}:
            sets = list(itertools.combinations(g, size))
            winner = lambda s: max(Counter(s).items(), key=lambda c: (c[1], c[0]))[0]
            for name, value in (("best", np.mean([max(s) for s in sets])), ("maj", np.mean([winner(s) for s in sets]))):
                want.setdefault((name, size), []).append(value)
            if size == len(g):
                want.setdefault(("mean", size), []).append(np.mean(g))
    assert got == {f"val-{'core' if n == 8 else 'aux'}/src/reward/{m}@{n}": pytest.approx(np.mean(v), abs=1e-12) for (m, n), v in want.items()}


def brute_tail(u, a, b):
    sums = [sum(s) - a * (a - 1) // 2 for s in itertools.combinations(range(a + b), a)]
    return sum(s >= u for s in sums) / len(sums)


def test_exact_rank_tail(monkeypatch):
    for a, b in ((1, 1), (2, 5), (5, 4), (8, 4)):
        for u in np.arange(0, a * b + 0.6, 0.5):
            assert inference.exact_u_tail(u, a, b) == pytest.approx(brute_tail(u, a, b), abs=1e-12)
    closed = [inference.exact_u_tail(u, 8, 9) for u in range(73)]
    monkeypatch.setattr(inference, "CLOSED_FORM", 3)
    assert [inference.exact_u_tail(u, 8, 9) for u in range(73)] == pytest.approx(closed, abs=1e-12)


def test_exact_rank_tail_of_a_huge_sample():
    """Eight against a thousand million rows: no array of eight thousand million places."""
    n1, n2 = 8, 10 ** 9
    sd = math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    for z in (0.5, 1.5, 2.5):
        assert inference.exact_u_tail(n1 * n2 / 2 + z * sd, n1, n2) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=0.004)
    assert inference.exact_u_tail(n1 * n2, n1, n2) == pytest.approx(1 / math.comb(n1 + n2, n1), rel=1e-9)


def test_rank_test_methods(spark):
    rows = spark.createDataFrame([(20.0, 5, 6, 0.0)], "u double, a long, b long, t double")
    p = rows.select(*[inference.mann_whitney_p("u", "a", "b", "t", m).alias(m) for m in ("auto", "exact", "normal")]).first()
    assert p.auto == p.exact == pytest.approx(2 * brute_tail(20, 5, 6)) and p.normal != p.exact
    with pytest.raises(ValueError):
        inference.mann_whitney_p("u", "a", "b", "t", "other")


@pytest.mark.parametrize("split", ["64", "1m"])
def test_line_numbers_over_split_files(spark, tmp_path, split):
    rnd, want = random.Random(2), []
    for name in ("1", "2", "3"):
        lines = [rnd.choice(['{"score": 1}', "", "  ", "[1]", "broken " + "x" * rnd.randrange(90), "17"]) for _ in range(200)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + ("\n" if name == "2" else ""))
        want += [(f"{name}.jsonl", i + 1, x) for i, x in enumerate(lines) if x.startswith("broken")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = readers.bad_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.path.rsplit("/", 1)[1], r.line, r.text) for r in got) == sorted(want)
