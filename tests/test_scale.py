"""Results must not depend on partitions, copies or skew."""

import random

import pytest
from pyspark.sql import functions as F

from rollframe.distributed import SLICE, affine_suffix, exact_quantiles, ordered, previous, row_numbers, running, with_row
from rollframe.operators import credit, episodes, groups
from rollframe.operators import trajectories as J

PAYLOAD = ["score", "output", "last_turn", "traj_success"]


@pytest.fixture(scope="module")
def rollouts(spark):
    rng, rows = random.Random(3), []
    for g in range(12):
        for t in range(4 if g else 40):
            n, won = rng.randint(1, 9), rng.random() < 0.5
            rows += [(str(g), t, i + 1, round(rng.random(), 2), round(rng.random(), 2), rng.randint(1, 9), i == n - 1, won, rng.choice("abc")) for i in range(n)]
    return spark.createDataFrame(rows, "group_idx string, traj_idx int, turn_idx int, score double, value double, tokens int, last_turn boolean, traj_success boolean, output string")


def pipeline(df):
    unique = J.drop_copies(df, PAYLOAD)
    scores = credit.trajectory_scores(unique, "bounded_process", reward="score", success="traj_success", with_issues=True)
    adv = credit.group_advantages(scores.filter(F.size("issues") == 0)).select("group_idx", "traj_idx", F.col("advantage").alias("relative"))
    est = credit.generalized_advantages(unique.select(*J.KEY, "score", "value", "tokens"), "score", "value", 0.9, 0.8)
    out = credit.whiten(credit.loss_weights(est, "trajectory")).join(adv, J.TRAJECTORY)
    return sorted((r.group_idx, r.traj_idx, r.turn_idx, round(r.relative, 9), round(r.whitened, 9), round(r.weight, 12)) for r in out.collect())


def test_partitions_and_copies_change_nothing(rollouts):
    want = pipeline(rollouts)
    assert len(want) == rollouts.count()
    for n in (1, 7, 64):
        assert pipeline(rollouts.repartition(n)) == want
    # One row has as many copies as a third of the table.
    hot = rollouts.limit(1).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("_n")
    assert pipeline(rollouts.unionByName(hot).unionByName(rollouts.sample(0.5, seed=1))) == want


def test_long_trajectory_is_folded_in_levels(spark):
    """A trajectory of three fold levels against the plain recurrence."""
    n = 64 * 64 + 70
    df = spark.range(1, n + 1).select(F.lit("g").alias("k"), F.col("id").cast("int").alias("i"), (F.col("id") % 7 * 0.5).alias("v"), F.when(F.col("id") % 5 == 0, 0.0).otherwise(0.9).alias("f"))
    got = {r.i: (r.suffix, r.after) for r in affine_suffix(df, ["k"], "i", F.col("v"), F.col("f")).collect()}
    s = 0.0
    for i in range(n, 0, -1):
        after, s = s, i % 7 * 0.5 + (0.0 if i % 5 == 0 else 0.9) * s
        assert got[i] == pytest.approx((s, after))


def test_fold_with_gaps_and_maps(spark):
    df = spark.createDataFrame([("g", 1, 1.0), ("g", 100, 2.0), ("g", 9000, 4.0), ("h", 3, 8.0)], "k string, i int, v double").withColumn("m", F.create_map(F.lit("x"), F.col("i")))
    got = {(r.k, r.i): (r.suffix, r.m["x"]) for r in affine_suffix(df, ["k"], "i", F.col("v"), F.lit(1.0)).collect()}
    assert got == {("g", 1): (7.0, 1), ("g", 100): (6.0, 100), ("g", 9000): (4.0, 9000), ("h", 3): (8.0, 3)}
    with pytest.raises(Exception, match="beyond max_index"):
        affine_suffix(df, ["k"], "i", F.col("v"), F.lit(1.0), max_index=64).collect()


@pytest.fixture(scope="module")
def skewed(spark):
    """Four thousand rows, half of them under one key."""
    return spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 90).cast("string"))).alias("k"),
                                    F.col("id").alias("o"), (F.col("id") * 37 % 101).cast("double").alias("v"))


def by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.k, []).append(r)
    return {k: sorted(v, key=lambda r: r.o) for k, v in out.items()}


def test_ordered_helpers_on_a_hot_key(skewed):
    spread = ordered(skewed, ["k"], ["o"])
    sizes = [r["count"] for r in spread.filter("k = 'hot'").groupBy(SLICE).count().collect()]
    assert len(sizes) >= 3, "the hot key must cover several slices"
    sums = by_key(running(spread, ["k"], ["o"], {"n": F.lit(1), "s": F.col("v")}))
    before = by_key(previous(spread, ["k"], ["o"], {"p": "v"}))
    for k, rows in sums.items():
        total = 0.0
        for i, r in enumerate(rows):
            total += r.v
            assert (r.n, r.s) == (i + 1, pytest.approx(total))
        assert [r.p for r in before[k]] == [None] + [r.v for r in rows[:-1]]


def test_global_order(skewed):
    got = sorted((r.rn, r.o) for r in row_numbers(skewed, [], ["o"]).collect())
    assert got == [(i + 1, i) for i in range(4000)]


def test_quantiles_match_sorted_values(skewed):
    got = {r.k: (r.a, r.b) for r in exact_quantiles(skewed, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()}
    for k, rows in by_key(skewed).items():
        v = sorted(r.v for r in rows)
        want = []
        for p in (0.5, 0.95):
            at = p * (len(v) - 1)
            lo = int(at)
            hi = min(lo + 1, len(v) - 1)
            want.append(v[lo] + (at - lo) * (v[hi] - v[lo]))
        assert got[k] == pytest.approx(tuple(want))


def test_with_row_rejects_more_than_one(spark):
    assert with_row(spark.range(2), spark.range(1).selectExpr("id AS x")).count() == 2
    with pytest.raises(Exception):
        with_row(spark.range(2), spark.range(2).selectExpr("id AS x")).collect()


def test_hot_episode_runs(spark):
    words = ["left", "up", "up", "up", "down"] * 300 + ["right"] * 700
    df = spark.createDataFrame([("hot", i, w) for i, w in enumerate(words)] + [(f"e{i}", 0, "up") for i in range(50)], "ep string, pos int, w string")
    runs = {r.ep: r for r in episodes.longest_runs(df, "ep", "pos", F.col("w")).collect()}
    assert (runs["hot"].max_repetition, runs["hot"].repeated_action, runs["hot"].texts) == (700, "right", 2200) and len(runs) == 51


def test_tied_groups_keep_every_group(spark):
    rows = [(f"g{i:03d}", float(x)) for i in range(300) for x in (0, 1)]
    v = groups.group_variance(spark.createDataFrame(rows, "group_idx string, reward double"))
    assert sorted(r.group_idx for r in groups.top_k_groups(v, 0.1).collect()) == [f"g{i:03d}" for i in range(30)]
    assert groups.top_p_groups(v, 0.5).count() == 150
