"""Steps whose work must not be repeated as tables grow."""

import time

from pyspark.sql import functions as F

from rollframe import distributed, session
from rollframe.distributed import affine_suffix
from rollframe.operators import credit, episodes, groups, maps
from rollframe.plans import spatial_queries, views
from rollframe.plans.catalog import enough_tasks
from rollframe.sources import readers


def turns(spark):
    rows = [(g, t, i, 0.01 * i, "ab"[i % 2], i == 4, t == 0, f"s{i}") for g in ("1", "2") for t in range(3) for i in range(1, 5)]
    return spark.createDataFrame(rows + rows[:5], "group_idx string, traj_idx int, turn_idx int, score double, output string, last_turn boolean, traj_success boolean, state_anchor string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_turns_are_folded_once_for_advantages(spark):
    out = credit.episode_advantages(turns(spark), ["score", "output"], reward="score", success="traj_success")
    assert "turn_idx" not in plan(out) and out.count() == 6


def test_preflight_works_out_state_groups_once(spark, monkeypatch):
    seen, real = [], groups.exact_quantiles
    monkeypatch.setattr(groups, "exact_quantiles", lambda df, *a: seen.append(df) or real(df, *a))
    row = groups.preflight(turns(spark).dropDuplicates(), action="output").first()
    assert "Aggregate" not in plan(seen[0]) and row.state_groups == 8 and row.max_group_rows == 3


def test_a_block_of_the_recurrence_is_walked_once(spark):
    rows = spark.range(200).select(F.lit("k").alias("k"), F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("v"))
    out = affine_suffix(rows, ["k"], "i", F.col("v"), F.lit(0.5))
    assert "slice(" not in plan(out)
    want, after = 0.0, {}
    for i in reversed(range(200)):
        after[i], want = want, i % 7 + 0.5 * want
        after[i] = (want, after[i])
    assert all(abs(r.suffix - after[r.i][0]) < 1e-12 and abs(r.after - after[r.i][1]) < 1e-12 for r in out.collect())


def test_votes_are_worked_out_once(spark):
    rows = spark.createDataFrame([("a", p, float(p % 3), float(i % 2)) for p in range(6) for i in range(3)], "run string, prompt int, reward double, acc double")
    out = episodes.validation_metrics(rows, "run", "prompt", ["reward", "acc"])
    assert "Python" not in plan(out) and "Arrow" not in plan(out) and out.count() == 14


def test_heavy_rows_get_more_tasks_as_they_grow(spark):
    small, large = (enough_tasks(spark.range(0, n, 1, 8).select("id")) for n in (1000, 1_000_000))
    assert small.rdd.getNumPartitions() == 8 and large.rdd.getNumPartitions() == 20


def test_scale_of_a_position_is_worked_out_once(spark):
    scaled, plain = (maps.position_similarity(F.col("m"), allow_scale=s) for s in (True, False))
    rows = spark.sql("SELECT array(named_struct('g', struct(1 AS x, 2 AS y), 'p', struct(2 AS x, 4 AS y)), named_struct('g', struct(0 AS x, 3 AS y), 'p', NULL)) AS m")
    text = plan(rows.repartition(1).select(scaled.alias("v")))
    assert text.count("aggregate(") <= 10
    assert rows.select(scaled.alias("v")).first().v == 0.5
    assert abs(rows.select(plain.alias("v")).first().v - 0.5 * 2.718281828459045 ** -1) < 1e-12


def test_padded_rows_move_once_for_their_advantages(spark, monkeypatch):
    rows = turns(spark).withColumn("value", F.lit(0.1)).withColumn("copy_no", F.xxhash64("state_anchor") % 3)
    rows = rows.unionByName(rows.filter("turn_idx % 2 = 0").withColumn("copy_no", F.lit(9).cast("long")))
    made = lambda: credit.advantages_of_copies(rows, ["score", "output"], ["copy_no"], "score", "value", 0.99, 0.95)
    out = made()
    assert "Join" not in plan(out) and out._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    got = sorted(out.collect())
    monkeypatch.setattr(credit, "has_hot_key", lambda *a: True)
    want = sorted(made().collect())
    assert len(got) == len(want) == rows.count()
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and abs(a.advantage - b.advantage) < 1e-12 and abs(a.turn_return - b.turn_return) < 1e-12


def test_stability_works_out_a_row_once(spark, monkeypatch):
    rows = spatial_queries.scenes(spark, "/root/testdata/sf0.001")
    held = lambda: len(session._staged.get(spark.sparkContext.applicationId, []))
    before = held()
    out = maps.stability(rows, "sample", "scene")
    assert plan(out).count("aggregate(") == 2 and held() == before
    got = sorted(out.collect(), key=lambda r: r.scene)
    monkeypatch.setattr(maps, "has_hot_key", lambda *a: True)
    assert got == sorted(maps.stability(rows, "sample", "scene").collect(), key=lambda r: r.scene) and got


def test_orders_are_bounded_without_a_join(spark, monkeypatch):
    """The ids of turns: all orders bound those with lines, so these are joined once only."""
    seen, real = [], distributed.has_hot_key
    monkeypatch.setattr(distributed, "has_hot_key", lambda df, keys: seen.append(plan(df)) or real(df, keys))
    views.turns(spark, "/root/testdata/sf0.001//")
    assert len(seen) == 1 and "Join" not in seen[0]


def test_flags_as_numbers_cost_no_more_than_as_words(spark):
    """A cast that fails row by row took most of the time of SRC1."""
    texts = ["0", "1", "0.0", "1.0", "2", "-1", "+1", "1e0", ".5", "1d", " 1 ", " true", "true", "TRUE", "False", "t", "y", "no", "NaN", "Infinity", "-", "", " ", "x", "9x", None]
    some = spark.createDataFrame([(t,) for t in texts], "t string")
    plainly = F.coalesce(F.lower("t").try_cast("boolean"), F.col("t").try_cast("double") != 0)
    assert [tuple(r) for r in some.select(readers.flag(F.col("t")), plainly).collect() if r[0] != r[1]] == []

    def seconds(*words):
        rows = spark.range(2_000_000).select(F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 2 + 1).cast("int")).alias("t"))
        took = []
        for _ in range(3):
            start = time.monotonic()
            rows.select(F.count_if(readers.flag(F.concat("t", F.lit(""))))).collect()
            took.append(time.monotonic() - start)
        return min(took)

    assert seconds("0.0", "1.0") < 3 * seconds("true", "false") + 0.5
