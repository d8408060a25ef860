"""Broken input must give an issue or stop the job."""

import pytest
from pyspark.sql import functions as F

from rollframe.functions import tokens as T
from rollframe.operators import contracts, credit, parity, selection
from rollframe.operators import trajectories as J
from rollframe.registry import Registry

TURN = "group_idx string, traj_idx int, turn_idx int, score double, last_turn boolean, traj_success boolean, output string"


def report(spark, *ends):
    rows = [("g", 0, t, 0.0, last, False, "") for t, last in ends]
    return J.trajectory_report(spark.createDataFrame(rows, TURN))


@pytest.mark.parametrize("ends,text", [
    ([(1, False), (3, True)], "not contiguous"), ([(2, False), (3, True)], "not contiguous"), ([(1, False), (2, False)], "exactly one terminal"),
    ([(1, True), (2, True)], "exactly one terminal"), ([(1, True), (2, False)], "not on the final turn")])
def test_broken_trajectories(spark, ends, text):
    found = report(spark, *ends)
    assert text in "; ".join(found.first().issues)
    with pytest.raises(Exception, match=text):
        J.fail_on(found).collect()


def test_whole_trajectory(spark):
    assert report(spark, (1, False), (2, True)).first().issues == []


def test_group_ids(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "group_idx string, traj_idx int")
    found = {r.group_idx: r.issues for r in J.group_report(df, expected=2).collect()}
    assert found["a"] == [] and len(found["b"]) == 2
    kept = J.keep_whole_groups(df, J.group_report(df))
    assert {r.group_idx for r in kept.collect()} == {"a"}


def test_conflicting_copies(spark):
    df = spark.createDataFrame([("g", 0, 1, 0.0, True, False, "a"), ("g", 0, 1, 1.0, True, False, "a")], TURN)
    assert J.copy_report(df, ["score"]).first().conflict
    with pytest.raises(Exception, match="conflicting copies"):
        J.drop_copies(df, ["score"]).collect()
    assert J.drop_copies(df, ["score"], strict=False).count() == 1
    assert J.drop_copies(df, ["output"]).count() == 1


def test_null_and_value_conflict(spark):
    df = spark.createDataFrame([("g", 0, 1, None, True, False, "a"), ("g", 0, 1, 1.0, True, False, "a")], TURN)
    assert J.copy_report(df, ["score"]).first().conflict


def test_empty_response(spark):
    df = spark.createDataFrame([("g", 0, 1, [0, 0])], "group_idx string, traj_idx int, turn_idx int, response_mask array<int>")
    adv = df.select("group_idx", "traj_idx", F.lit(1.0).alias("advantage"))
    with pytest.raises(Exception, match="empty response"):
        credit.advantage_to_tokens(df, adv).collect()
    with pytest.raises(Exception, match="no tokens"):
        credit.loss_weights(df.withColumn("tokens", T.mask_size("response_mask")), "turn").collect()


def test_bad_log_probabilities(spark):
    nan = spark.createDataFrame([([float("nan")], [0.0], [1])], "p array<double>, q array<double>, m array<int>")
    with pytest.raises(Exception, match="non-finite"):
        parity.token_ratios(nan, "p", "q", "m", []).collect()
    short = spark.createDataFrame([([0.0, 1.0], [0.0], [1])], "p array<double>, q array<double>, m array<int>")
    with pytest.raises(Exception, match="differ in shape"):
        parity.token_ratios(short, "p", "q", "m", []).collect()
    with pytest.raises(ValueError):
        parity.ratio_statistics(short, [], clip_low=1.5)


def test_missing_padding_sentinel(spark):
    with pytest.raises(Exception, match="sentinel"):
        J.drop_padding(spark.createDataFrame([(1, None)], "a int, _is_padding boolean")).collect()


def test_conflicting_turn_counts(spark):
    df = spark.createDataFrame([("g", 0, 1, 0.0, True, False, "", 4), ("g", 0, 2, 0.0, True, False, "", 6)], TURN + ", n int")
    with pytest.raises(Exception, match="conflicting trajectory turn counts"):
        J.trajectory_records(df, J.declared_turns(F.col("n"))).collect()


def test_unknown_uid(spark):
    with pytest.raises(Exception, match="unknown uid"):
        selection.align_tasks(spark.createDataFrame([(1,), (2,)], "uid int"), spark.createDataFrame([(1, "x")], "uid int, t string")).collect()


def test_too_few_disjoint_items(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "seed int, fingerprint string")
    assert [r.seed for r in selection.select_disjoint(df, "seed", 2).orderBy("seed").collect()] == [1, 3]
    with pytest.raises(Exception, match="not enough disjoint"):
        selection.select_disjoint(df, "seed", 3).collect()


SPEC = "spec_idx int, n_envs int, seed array<long>, seed_list array<long>"


@pytest.mark.parametrize("row,text", [((0, 3, [1], [5]), "too short"), ((0, 1, [1, 2, 3, 4], None), "1 to 3"), ((0, 1, [5, 2], None), "empty seed range"),
                                      ((0, 9, [1, 2, 2], None), "cannot supply")])
def test_bad_task_specs(spark, row, text):
    with pytest.raises(Exception, match=text):
        contracts.expand_tasks(spark.createDataFrame([row], SPEC)).collect()


def test_task_limits(spark):
    out = contracts.expand_tasks(spark.createDataFrame([(0, 7, [10, 13, 2], None), (1, 5, [1], None), (2, 30, [3, 4], None), (3, 2, [0], [9, 8, 7])], SPEC), block=2).collect()
    by = {k: [r.task_seed for r in out if r.spec_idx == k] for k in range(4)}
    assert len(by[0]) == 7 and all(by[0].count(x) <= 2 and 10 <= x <= 13 for x in by[0])
    assert len(by[1]) == 5 and len(by[2]) == 30 and set(by[2]) == {3, 4} and sorted(by[3]) == [8, 9]
    assert sorted(r.slot for r in out if r.spec_idx == 0) == list(range(7))


def test_registry_names():
    r = Registry("metric")
    f = r.register("a")(lambda rows: rows)
    r.register("a")(f)
    with pytest.raises(ValueError):
        r.register("a")(lambda rows: rows)
    with pytest.raises(KeyError):
        r.get("b")


def test_configs(spark):
    df = spark.createDataFrame([("{}",), ('{"trainer":{"n_gpus_per_node":2},"actor_rollout_ref":{"rollout":{"n":4}},"algorithm":{"adv_estimator":"grpo"}}',)], "config string")
    bad, good = [r.issues for r in contracts.training_config_issues(df).collect()]
    assert good == [] and bad == ["missing trainer", "missing actor_rollout_ref", "missing algorithm"]
    m = spark.createDataFrame([("base", None, None, None, None, False, True), ("grpo_x", None, None, None, None, None, None), ("no_concat_gae", "magic", True, True, 0, None, None), ("concat_grpo", "grpo", None, True, 2, None, None)],
                              "method string, advantage string, concat_multi_turn boolean, critic boolean, rollout_n int, train boolean, eval_only boolean")
    got = {r.method: r.issues for r in contracts.matrix_method_issues(m).collect()}
    assert got == {"base": [], "grpo_x": ["unknown method grpo_x"], "no_concat_gae": ["unknown advantage", "rollout_n must be positive"], "concat_grpo": ["missing keys: concat_multi_turn"]}
    e = spark.createDataFrame([("sokoban", "a", "b", " ", [1, 2], [5, 2], [1]), ("mars", None, None, None, None, None, None)],
                              "environment string, train string, validation string, evaluation string, train_seeds array<int>, validation_seeds array<int>, evaluation_seeds array<int>")
    got = {r.environment: r.issues for r in contracts.matrix_environment_issues(e).collect()}
    assert got["mars"] == ["unknown environment mars"] and got["sokoban"] == [
        "validation_seeds has an invalid range", "evaluation must be a path", "evaluation_seeds must be [start, stop(, step)]"]
    f = spark.createDataFrame([("s", ["concat_grpo", "x"], ["sokoban"], []), ("t", ["concat_grpo"], None, None)], "stage string, methods array<string>, environments array<string>, seeds array<int>")
    got = {r.stage: r.issues for r in contracts.funnel_issues(f, ["concat_grpo"], ["sokoban"]).collect()}
    assert got == {"s": ["unknown methods: x", "seeds must be a non-empty list"], "t": []}
