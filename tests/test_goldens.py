"""Known values of the operators on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from rollframe import distributed
from rollframe.functions import geometry as G
from rollframe.functions import inference as I
from rollframe.functions import scoring
from rollframe.functions import text as X
from rollframe.functions import tokens as T
from rollframe.operators import credit, episodes, exploration, groups, maps, parity, resources, selection, statistics
from rollframe.operators import trajectories as J

TURN = "group_idx string, traj_idx int, turn_idx int, score double, last_turn boolean, traj_success boolean, output string"


def turns(spark, rows):
    return spark.createDataFrame(rows, TURN)


@pytest.fixture(scope="module")
def pair(spark):
    """One failed single-turn trajectory, one of three turns that succeeds at the end."""
    return turns(spark, [("g", 0, 1, 0.0, True, False, "a"), ("g", 1, 1, 0.1, False, False, "b"),
                         ("g", 1, 2, 0.1, False, False, "b"), ("g", 1, 3, 1.1, True, True, "c")])


def scores(df, mode, **options):
    out = credit.trajectory_scores(df, mode, reward="score", success="traj_success", **options)
    return {r.traj_idx: r.trajectory_score for r in out.collect()}


def test_group_advantage(pair):
    adv = credit.group_advantages(credit.trajectory_scores(pair, reward="score", success="traj_success"))
    assert {r.traj_idx: r.advantage for r in adv.collect()} == {0: -1.0, 1: 1.0}


def test_reward_modes(spark):
    df = turns(spark, [("g", 0, 1, 1.1, True, True, ""), ("g", 1, 1, 0.1, False, False, ""), ("g", 1, 2, 0.1, False, False, ""),
                       ("g", 1, 3, 1.1, True, True, ""), ("g", 2, 1, 0.0, False, False, ""), ("g", 2, 2, 1.1, True, True, "")])
    assert scores(df, "outcome") == {0: 1.0, 1: 1.0, 2: 1.0}
    bounded = scores(df, "bounded_process", process_cap=0.2)
    assert bounded[0] == pytest.approx(1.1) and bounded[1] == pytest.approx(1.2)
    gate = scores(df, "format_gate", format_threshold=0.1)
    assert gate[1] == 1.0 and gate[2] == 0.0
    with pytest.raises(ValueError):
        credit.trajectory_scores(df, "bounded_process", process_cap=-1)


@pytest.mark.parametrize("mode,loss", [("token", 4.0), ("turn", 13 / 3), ("trajectory", 3.0)])
def test_loss_weights(spark, mode, loss):
    df = spark.createDataFrame([("g", 0, 1, 1, 1.0), ("g", 1, 1, 2, 3.0), ("g", 1, 2, 1, 9.0)],
                               "group_idx string, traj_idx int, turn_idx int, tokens int, loss double")
    w = credit.loss_weights(df, mode)
    assert w.agg(F.sum(F.col("weight") * F.col("tokens") * F.col("loss"))).first()[0] == pytest.approx(loss)
    assert w.agg(F.sum(F.col("weight") * F.col("tokens"))).first()[0] == pytest.approx(1.0)


def test_weight_mass(spark):
    df = spark.createDataFrame([("g", 0, 1, 2), ("g", 0, 2, 8), ("g", 1, 1, 4)], "group_idx string, traj_idx int, turn_idx int, tokens int")
    mass = lambda m: [r.mass for r in credit.weight_mass(credit.loss_weights(df, m), "traj_idx").orderBy("traj_idx").collect()]
    assert mass("token") == pytest.approx([10 / 14, 4 / 14])
    assert mass("turn") == pytest.approx([2 / 3, 1 / 3])
    assert mass("trajectory") == pytest.approx([0.5, 0.5])


def test_generalized_advantage(spark):
    df = spark.createDataFrame([("g", 0, 1, 0.1, 0.5), ("g", 0, 2, 0.2, 0.4), ("g", 0, 3, 1.1, 0.3)],
                               "group_idx string, traj_idx int, turn_idx int, score double, value double")
    for limit in (None, 5):
        out = credit.generalized_advantages(df, "score", "value", 0.99, 0.95, limit).orderBy("turn_idx").collect()
        assert [r.advantage for r in out] == pytest.approx([0.7948607, 0.8494, 0.8])
        assert [r.turn_return for r in out] == pytest.approx([1.2948607, 1.2494, 1.1])


def test_sparse_targets(spark):
    df = spark.createDataFrame([("g", 0, 1, 0.2, 0.0, [0, 1, 0]), ("g", 0, 2, 1.2, 0.0, [0, 1, 0])],
                               "group_idx string, traj_idx int, turn_idx int, score double, value double, mask array<int>")
    out = credit.generalized_advantages(df, "score", "value", 1.0, 1.0).withColumn("t", T.sparse_targets(F.col("turn_return"), "mask"))
    rows = out.withColumn("e", T.export_targets("t")).withColumn("m", T.value_mask("e")).orderBy("turn_idx").collect()
    assert [r.t for r in rows] == [[None, pytest.approx(1.4), None], [None, pytest.approx(1.2), None]]
    assert [r.m for r in rows] == [[False, True, False]] * 2
    assert rows[0].e[0] == -100.0


def test_analyzer_dedup(spark):
    df = turns(spark, [("g", 0, 1, 0.0, True, False, "a"), ("g", 0, 1, 0.0, True, False, "a"), ("g", 1, 1, 0.5, False, True, "b"), ("g", 1, 2, 0.5, True, True, "c")])
    unique = J.drop_copies(df, ["score", "output", "last_turn", "traj_success"])
    records = J.trajectory_records(unique)
    assert unique.agg(F.sum("copies") - F.count("*")).first()[0] == 1
    assert records.count() == 2 and records.agg(F.avg(F.col("success").cast("int"))).first()[0] == 0.5
    assert groups.comparable_variance(records).first().mean_group_reward_variance == pytest.approx(0.25)


def test_declared_turn_counts(spark):
    df = spark.createDataFrame([("g", 0, 1, 1.0, True, True, "", 4, None), ("g", 1, 1, 1.0, True, True, "", None, 6)], TURN + ", a int, b int")
    out = J.trajectory_records(df, J.declared_turns(F.col("a"), F.col("b")))
    assert out.agg(F.avg("turns")).first()[0] == 5.0


def test_episode_summary(spark):
    df = spark.createDataFrame([(True, 2, 1.2, 2, 2), (False, 4, 0.4, 4, 2)],
                               "success boolean, num_turns int, cumulative_reward double, action_check_count long, valid_action_count long")
    r = episodes.summarize(df).first()
    assert (r.success_rate, r.mean_turns_successful) == (0.5, 2.0) and r.invalid_action_fraction == pytest.approx(2 / 6)
    texts = spark.createDataFrame([("<answer>right</answer>",), ("<action>right</action>",)], "t string")
    assert episodes.template_concentration(texts, X.answer_template(F.col("t"))).first().concentration == 1.0


def test_parity(spark):
    ln = math.log
    df = spark.createDataFrame([([0.0, ln(2)], [0.0, 0.0], [1, 1]), ([ln(0.5), ln(4)], [0.0, 0.0], [1, 0])], "p array<double>, q array<double>, m array<int>")
    r = parity.ratio_statistics(parity.token_ratios(df, "p", "q", "m", []), []).first()
    assert (r.ratio_mean, r.ratio_median, r.ratio_p95, r.ratio_p99) == pytest.approx((3.5 / 3, 1.0, 1.9, 1.98))
    assert r.mean_abs_logprob_delta == pytest.approx(2 * ln(2) / 3) and r.pre_update_clip_fraction == pytest.approx(2 / 3) and r.num_tokens == 3
    gate = parity.parity_gate(parity.ratio_statistics(parity.token_ratios(df, "p", "q", "m", []), [])).first()
    assert not gate.gate_passed and len(gate.failures) == 3


PRE = "group_idx string, traj_idx int, turn_idx int, score double, state_anchor string, action string"


def test_preflight_proceeds(spark):
    df = spark.createDataFrame([("g", 0, 1, 0.0, "s", "left"), ("g", 0, 2, 0.0, "l", "up"), ("g", 1, 1, 0.0, "s", "right"), ("g", 1, 2, 1.0, "r", "up")], PRE)
    r = groups.preflight(df, limits={"min_rows": 4}).first()
    assert r.decision == "proceed" and r.comparable_groups == 1 and r.mean_return_to_go_variance == pytest.approx(0.25)


def test_preflight_stops(spark):
    said = X.normalized_action(F.col("action"))
    df = spark.createDataFrame([("g", 0, 1, 0.0, "s", "<think>a</think><action>Left</action>"), ("g", 1, 1, 0.0, "s", "<think>b</think><action> left</action>")], PRE)
    r = groups.preflight(df.withColumn("action", said), limits={"min_rows": 2}).first()
    assert r.decision == "stop" and r.failed_checks == ["actions_vary", "returns_vary"]


SAMPLE = "run string, gpu_index int, gpu_name string, sample long, elapsed_seconds double, memory_used_mib double, utilization_percent double, power_watts double"


def test_device_summary(spark):
    df = spark.createDataFrame([("r", 0, "a", 1, 0.0, 1024.0, 60.0, 200.0), ("r", 0, "a", 2, 3600.0, 4096.0, 80.0, 300.0),
                                ("r", 1, "a", 3, 0.0, 2048.0, 75.0, 250.0), ("r", 1, "a", 4, 3600.0, 3072.0, 80.0, 350.0)], SAMPLE)
    hours = spark.createDataFrame([("r", 3600.0), ("none", 3600.0)], "run string, duration_seconds double")
    out = {r.run: r for r in resources.run_summary(df, hours).collect()}
    assert out["r"].gpu_hours == 2.0 and out["r"].energy_kwh == pytest.approx(0.55) and out["r"].peak_vram_mib == 4096
    assert out["none"].gpu_hours is None and out["none"].energy_kwh is None
    assert [r.mean_utilization for r in resources.device_summary(df).orderBy("gpu_index").collect()] == [70.0, 77.5]


def test_session_merge(spark):
    samples = spark.createDataFrame([("r", 0, 10.0), ("r", 1, 0.0)], "run string, session int, elapsed_seconds double")
    durations = spark.createDataFrame([("r", 0, 10.0), ("r", 1, 10.0)], "run string, session int, duration_seconds double")
    assert sorted(r.elapsed_seconds for r in resources.merge_sessions(samples, durations).collect()) == [10.0, 10.0]


EP = "rollout_id string, seed int, success boolean, finish_reason string, num_turns int, cumulative_reward double, action_check_count long, valid_action_count long"


def test_failure_classes(spark):
    rows = [("a", 0, False, "model_error", 1, 0.0, 0, 0), ("b", 0, False, "max_turns", 5, 0.6, 0, 0), ("c", 0, False, "max_turns", 5, 0.05, 0, 0),
            ("d", 0, False, "done", 5, 0.0, 5, 0), ("e", 0, False, "done", 5, 0.0, 5, 3), ("f", 0, False, "done", 2, 0.0, 0, 0), ("g", 0, False, "done", 11, 0.0, 0, 0), ("h", 0, True, "done", 2, 1.0, 0, 0)]
    got = {r.rollout_id: r.c for r in spark.createDataFrame(rows, EP).select("rollout_id", episodes.failure_class().alias("c")).collect()}
    assert got == {"a": "infrastructure_error", "b": "timeout_with_high_progress", "c": "timeout_with_no_progress", "d": "all_actions_invalid",
                   "e": "frequent_invalid_actions", "f": "early_termination", "g": "stalled_no_progress", "h": "success"}


def test_failure_patterns(spark):
    rows = [("a", 0, True, "done", 2, 1.0, 0, 0), ("b", 0, False, "max_turns", 9, 0.1, 0, 0), ("c", 0, False, "max_turns", 9, 0.7, 0, 0), ("d", 0, False, "model_error", 1, 0.0, 0, 0)]
    r = episodes.failure_patterns(spark.createDataFrame(rows, EP)).first()
    assert (r.total_failures, r.infrastructure_error_rate, r.failure_rate) == (3, 0.25, 0.75)
    none = episodes.failure_patterns(spark.createDataFrame(rows[:1], EP)).first()
    assert none.total_failures == 0 and none.most_common_failure is None and none.total_episodes == 1


def test_repetition(spark):
    df = spark.createDataFrame([("e0", i, "left") for i in range(5)] + [("e1", i, w) for i, w in enumerate(["up", "down", "left", "right"])], "ep string, pos int, text string")
    runs = episodes.longest_runs(df, "ep", "pos", X.action_word(F.col("text")))
    s = episodes.loop_summary(runs, episodes.repetition_loops(runs)).first()
    assert (s.total_episodes, s.episodes_with_loops, s.loop_rate) == (2, 1, 0.5)


def test_seed_aggregate_and_stability(spark):
    runs = spark.createDataFrame([("m", "e", s, 2, 1, 5.0 + s, 5 + s, 1.0, 10.0, 0.5) for s in range(3)],
                                 "method string, environment string, seed int, trials long, successes long, mean_turns double, turn_sum long, gpu_hours double, peak_vram_mib double, success_rate double")
    r = statistics.seed_aggregate(runs, ["method", "environment"], [0, 1, 2]).first()
    assert (r.success_pooled, r.total_successes, r.total_trials, r.n_seeds, r.issues) == (0.5, 3, 6, 3, [])
    assert statistics.seed_aggregate(runs, ["method"], [0, 1]).first().issues == ["unexpected seed set"]
    steady = lambda rates: statistics.seed_stability(runs.withColumn("success_rate", F.element_at(F.array(*[F.lit(x) for x in rates]), F.col("seed") + 1)), ["method"]).first()
    assert steady([0.48, 0.50, 0.52]).interpretation == "highly_stable"
    assert steady([0.3, 0.7, 0.5]).success_rate_cv > 0.2


def test_paired_deltas(spark):
    split = {0: 1.4, 1: 1.5, 2: 1.4, 3: 1.5, 4: 1.4}
    df = spark.createDataFrame([(s, "packed", 1.2) for s in split] + [(s, "split", v) for s, v in split.items()], "seed int, packing string, reward double")
    d = statistics.paired_deltas(df, "seed", "packing", ["reward"])
    assert [round(r.reward_delta, 6) for r in d.orderBy("seed").collect()] == [0.2, 0.3, 0.2, 0.3, 0.2]
    assert statistics.bias_report(d, "reward_delta").first().positive_share == 1.0


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (45, 100)], "s int, n int").withColumn("w", I.wilson(F.col("s"), F.col("n")))
    zero, half = [r.w for r in df.orderBy("n").collect()]
    assert tuple(zero) == (0.0, 0.0) and tuple(half) == pytest.approx((0.356, 0.548), abs=1e-3)
    with pytest.raises(Exception, match="invalid counts"):
        df.select(I.wilson(F.lit(3), F.lit(2))).collect()


def test_exact_tests(spark):
    one = spark.range(1)
    # Lady tasting tea: 3 of 4 against 1 of 4 has p = 0.4857.
    assert one.select(I.fisher_p(F.lit(3), F.lit(4), F.lit(1), F.lit(4))).first()[0] == pytest.approx(0.485714, abs=1e-6)
    # Samples (1,2,3) and (4,5,6): the most extreme of 20 arrangements, both tails.
    assert one.select(I.mann_whitney_p(F.lit(0.0), F.lit(3), F.lit(3), F.lit(0.0))).first()[0] == pytest.approx(0.1)
    assert one.select(I.mann_whitney_p(F.lit(4.5), F.lit(3), F.lit(3), F.lit(0.0))).first()[0] == pytest.approx(1.0)
    # r = 0.5 of 12 pairs: t = 1.8257 with 10 degrees of freedom.
    assert one.select(I.pearson_p(F.lit(0.5), F.lit(12))).first()[0] == pytest.approx(0.0979, abs=2e-4)
    assert one.select(I.pearson_p(F.lit(1.0), F.lit(2))).first()[0] == 1.0


def test_rank_test_matches_counting(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 7.0], [2.0, 3.0, 4.0]
    df = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b], "x double, side boolean")
    r = statistics.mann_whitney(df, [], "x", "side").first()
    assert r.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b) and (r.n1, r.n2, r.ties) == (5, 3, 24.0)


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", float(x % 5)) for x in range(50)] + [("b", 3.0)], "m string, x double")
    rows = {r.m: r for r in statistics.bootstrap_mean(df, ["m"], "x", resamples=1000).collect()}
    assert rows["a"].ci_low < rows["a"].mean == 2.0 < rows["a"].ci_high and 0.5 < rows["a"].ci_high - rows["a"].ci_low < 1.2
    assert (rows["b"].ci_low, rows["b"].ci_high) == (3.0, 3.0)
    again = {r.m: r for r in statistics.bootstrap_mean(df.repartition(5), ["m"], "x", resamples=1000).collect()}
    assert again["a"].ci_low == pytest.approx(rows["a"].ci_low)


def test_final_aggregates(spark):
    rows = [("e", "m", s, "complete", 2, (2, 2, 1)[s], 10, 1000.0 + s, 10.0 + s, 1.01 + 0.01 * s, 1.02 + 0.01 * s, 0.01 + 0.001 * s, True) for s in range(3)]
    df = spark.createDataFrame(rows, "environment string, method string, seed int, status string, episodes long, successes long, turn_sum long, peak_vram_mib double, gpu_hours double, "
                               "ratio_p95 double, ratio_p99 double, mean_abs_logprob_delta double, gate_passed boolean")
    r = selection.final_aggregates(df, [0, 1, 2]).first()
    assert r.status == "complete" and r.success == pytest.approx(5 / 6) and r.ratio_p95 == pytest.approx(1.03) and r.ratio_p99 == pytest.approx(1.04)
    assert (r.peak_vram_mib, r.gpu_hours, r.gpu_hours_total) == (1002.0, 11.0, 33.0) and r.mean_abs_logprob_delta == pytest.approx(0.012)
    part = selection.final_aggregates(df.filter("seed < 2"), [0, 1, 2]).first()
    assert part.status == "incomplete-artifacts" and part.success is None and part.issues == ["training seeds differ from the expected set"]
    grid = selection.grid_report(selection.final_aggregates(df, [0, 1, 2]), ["e", "f"], ["m"])
    assert {(r.environment, r.presence) for r in grid.collect()} == {("e", "present"), ("f", "missing")}
    assert selection.registry_complete(grid).first()[0] is False
    assert selection.registry_complete(grid.filter("environment = 'e'")).first()[0] is True


def test_checkpoint_choice(spark):
    df = spark.createDataFrame([("r", 1, 4, 4, 0.5, 3.0, True), ("r", 2, 4, 4, 0.5, 2.0, True), ("r", 3, 4, 4, 0.5, None, True), ("r", 4, 3, 4, 0.9, 1.0, True), ("r", 5, 4, 4, 0.9, 1.0, False)],
                               "run string, step int, actual long, expected long, success_rate double, mean_turns double, saved boolean")
    assert selection.select_checkpoint(df).first().step == 2
    with pytest.raises(Exception, match="no eligible checkpoint"):
        selection.select_checkpoint(df.filter("step > 3"), strict=True).collect()


def test_concat_segments(spark):
    rows = [("g", 0, t, [-t, -t], [t] * t, 0.5) for t in range(1, 13)]
    df = spark.createDataFrame(rows, "group_idx string, traj_idx int, turn_idx int, prompts array<int>, responses array<int>, s double").select(
        "*", F.transform("responses", lambda x: F.lit(1)).alias("response_mask"), F.transform("responses", lambda x: F.col("s")).alias("rm_scores"),
        F.array(F.concat(F.lit("img"), F.col("turn_idx").cast("string"))).alias("image_data"), F.create_map(F.lit("k"), F.col("turn_idx").cast("string")).alias("extra"))
    r = J.concat_segments(df).first()
    want = [1] + [x for t in range(2, 13) for x in [-t, -t] + [t] * t]
    assert r.responses == want and r.prompts == [-1, -1] and len(r.image_data) == 12 and r.extra == {"k": "12"}
    assert [m for x, m in zip(r.responses, r.response_mask) if x < 0] == [0] * 22 and sum(r.response_mask) == sum(range(1, 13))
    parts = J.concat_segments(df, width=5).orderBy("segment").collect()
    assert len(parts) == 3 and [x for p in parts for x in p.responses] == want
    lifted = J.lift_extra(J.concat_segments(df), "extra", ["k"])
    assert lifted.first().k == "12"
    with pytest.raises(ValueError):
        J.lift_extra(J.concat_segments(df), "extra", ["turns"])


def test_cells_and_curves(spark):
    cell = lambda *ps: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ps])
    s = spark.range(1).select(maps.cell_scores(cell((1, 1), (2, 2)), cell((1, 1), (3, 3), (4, 4))).alias("s")).first().s
    assert tuple(s) == pytest.approx((0.5, 1 / 3, 0.4))
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 1.0)], "s string, p int, v double")
    assert {r.p: r["mean"] for r in exploration.curve_carry_forward(df, "s", "p", "v").collect()} == {0: 1.0, 1: 2.0}
    assert {r.p: r["mean"] for r in exploration.curve_skip_missing(df, "p", "v").collect()} == {0: 1.0, 1: 3.0}


def test_map_reward_and_bins(spark):
    r = spark.range(1).select(maps.map_reward(F.lit(1.0), F.lit(0.75), F.lit(2.0), F.lit(0.5), F.lit(True)).alias("r")).first().r
    assert r.score == pytest.approx((0.875 + 0.5 + 1.0 + 0.5) / 4) and r.reward == pytest.approx(r.score * 10 - 2)
    names = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (-1.0, 0.0), (0.0, -3.0)], "x double, y double").select(
        G.octant_name(G.bearing(F.col("x"), F.col("y"))).alias("n")).collect()
    assert [r.n for r in names] == ["north", "north east", "east", "west", "south"]


def test_response_formats(spark):
    df = spark.createDataFrame([("<think>t</think> <answer>Up, , left,down,right</answer>",), ("<answer>up</answer>",)], "t string")
    good, bad = [r.p for r in df.select(X.parse_response(F.col("t"), "grid", "free_think").alias("p")).collect()]
    assert good.format_correct and good.actions == ["up", "left", "down"] and good.think == "t"
    assert not bad.format_correct and bad.actions == []
    skill = spark.createDataFrame([("<think>t</think><answer>pick(A)| Place(B) |x</answer>",)], "t string").select(X.parse_response(F.col("t"), "skill", "free_think").alias("p")).first().p
    assert skill.actions == ["pick(A)", "Place(B)"]
    with pytest.raises(ValueError):
        X.parse_response(F.col("t"), "skill", "no_think")


def test_top_p_and_top_k(spark):
    rows = [(g, float(x)) for g, xs in {"a": (0, 10), "b": (0, 4), "c": (0, 2), "d": (1, 1), "e": (3,)}.items() for x in xs]
    v = groups.group_variance(spark.createDataFrame(rows, "group_idx string, reward double"))
    assert {r.group_idx for r in groups.top_k_groups(v, 0.2).collect()} == {"a"}
    assert {r.group_idx for r in groups.top_k_groups(v, 0.21).collect()} == {"a", "b"}
    assert {r.group_idx for r in groups.top_p_groups(v, 0.9).collect()} == {"a", "b"}
    flat = groups.group_variance(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "group_idx string, reward double"))
    assert groups.top_p_groups(flat, 0.5).count() == 2


def test_answer_scores(spark):
    rows = [("RotEvaluationTask", "[a, B c]", "A, b  C", 1.0), ("RotEvaluationTask", "a", "a, b", 0.0), ("DirectionEvaluationTask", "near ne", "north east, mid", 0.5),
            ("DirectionEvaluationTask", "medium; N", "north, mid distance", 1.0), ("BackwardPovVisionEvaluationTask", "North East", "ne", 1.0),
            ("View2LocationTextEvaluationTask", "(3, 4) facing north", "(3, 4)", 1.0), ("View2LocationTextEvaluationTask", "none", "(3, 4)", 0.0),
            ("View2LocationTextEvaluationTask", "(0, 0)", "(3, 4)", math.exp(-1)), ("AlloMappingEvaluationTask", "(1, 1) (2, -3)", "[(1, 1), (2, -3)]", 1.0), ("AlloMappingEvaluationTask", "(1, 1)", "[(1, 1), (2, -3)]", 0.0)]
    df = spark.createDataFrame(rows, "task string, pred string, answer string, want double")
    for r in df.withColumn("got", scoring.score(F.col("task"), F.col("pred"), F.col("answer"))).collect():
        assert r.got == pytest.approx(r.want), r
    with pytest.raises(Exception, match="unknown task evaluator"):
        df.select(scoring.score(F.lit("x"), F.col("pred"), F.col("answer"))).collect()
    lines = spark.range(1).select(scoring.numbered_directions(F.lit("1. (N, E)\n2. (s)\nnote"), F.array(F.array(F.lit("n"), F.lit("e")), F.array(F.lit("S")))).alias("s"),
                                  scoring.degree_sequence(F.lit("[90°, -45 degrees]"), F.array(F.lit(90), F.lit(-45))).alias("d")).first()
    assert (lines.s, lines.d) == (1.0, 1.0)


def test_map_metrics_of_a_sample_are_whole(spark):
    """aggregate_per_sample: means, the last map, and every per-turn list, with nulls where a turn is invalid."""
    metric = lambda v: None if v is None else (v, v, v, v)
    kinds = "struct<dir double, facing double, pos double, overall double>"
    schema = f"sample string, turn int, is_exploration_phase boolean, has_map boolean, local {kinds}, global {kinds}, agent {kinds}, newly {kinds}, full {kinds}, consistency {kinds}, probe struct<precision double, recall double, f1 double>"
    row = lambda s, t, phase, g, full, probe=None, has=True: (
        s, t, phase, has, None, metric(g), metric(g), None, metric(full), None, probe and (probe, probe / 2, probe / 4))
    logs = spark.createDataFrame([
        row("a", 0, True, 0.5, 0.25, 1.0), row("a", 3, True, None, 0.75), row("a", 5, False, 0.9, 0.9), row("a", 7, True, 1.0, None, 0.5), row("a", 9, True, 0.1, 0.1, has=False),
        row("b", 0, False, 1.0, 1.0), row("c", 2, True, 0.5, 0.5), row(None, 1, True, 0.25, 0.25)], schema)
    steady = spark.createDataFrame([("a", 3, 0.5, None), ("a", 7, None, 1.0), ("a", 9, 1.0, 0.0), ("b", 1, 1.0, 1.0), ("x", 1, 1.0, 1.0)], "sample string, turn int, p double, f double").selectExpr(
        "sample", "turn", "p AS position_update", "f AS facing_update", "p AS position_stability", "f AS facing_stability")
    told = spark.createDataFrame([("a", 0, 0.5, 0.5, 0.5, 0.5), ("a", 4, None, None, None, None), ("b", 1, 1.0, 1.0, 1.0, 1.0)], "sample string, turn int, dir double, facing double, pos double, overall double")
    belief = spark.createDataFrame([("b", 0.125)], "sample string, fb_inertia double")
    made = lambda **more: maps.sample_maps(logs, steady, mapped=F.col("has_map"), **more)
    rows = made(belief=belief, unchanged=told).collect()
    own = {r.sample: r for r in rows if r.part == "sample"}
    assert set(own) == {"a", "b", "c", None} and len(own) == sum(r.part == "sample" for r in rows)
    assert (own["a"].global_error_dir, own["a"].correctness_pos, own["a"].probe_f1, own["a"].position_stability_avg, own["a"].facing_update_avg) == (0.75, None, 0.1875, 0.75, 0.5)
    assert (own["b"].global_error_dir, own["b"].correctness_pos, own["b"].position_update_avg, own["b"].fb_inertia) == (None, None, None, 0.125)
    assert own["c"].correctness_dir == 0.5 and own[None].global_error_dir == 0.25

    def listed(sample, part, column):
        got = sorted((r.position, r[column]) for r in rows if r.sample == sample and r.part == part)
        assert [p for p, _ in got] == list(range(len(got)))
        return [v for _, v in got]
    assert listed("a", "turn", "cogmap_update_per_turn_dir") == listed("a", "turn", "self_tracking_per_turn_overall") == [0.5, None, 1.0]
    assert listed("a", "turn", "cogmap_full_per_turn_pos") == [0.25, 0.75, None]
    assert [listed("a", "turn", f"fog_probe_{n}_per_turn") for n in ("p", "r", "f1")] == [[1.0, None, 0.5], [0.5, None, 0.25], [0.25, None, 0.125]]
    assert listed("a", "stability", "position_stability_per_turn") == listed("a", "stability", "position_update_per_turn") == [None, 0.5, None, 1.0]
    assert listed("a", "stability", "facing_stability_per_turn") == [None, None, 1.0, 0.0]
    assert listed("a", "belief", "cogmap_fb_unchanged_per_turn_dir") == [0.5, None] and listed("b", "belief", "cogmap_fb_unchanged_per_turn_dir") == [1.0]
    assert listed("b", "turn", "cogmap_update_per_turn_dir") == listed("b", "stability", "facing_update_per_turn") == []
    assert listed("c", "stability", "facing_update_per_turn") == [None] and listed(None, "turn", "cogmap_full_per_turn_dir") == [0.25]
    assert {r.sample for r in rows} == {"a", "b", "c", None}
    passive = made(kind="passive")
    assert passive.columns == ["sample", "part", "position", *[f"correctness_{m}" for m in maps.METRICS]] and passive.count() == 4
    with pytest.raises(ValueError):
        made(kind="other")


def test_series_of_a_hot_sample_are_the_same(spark, monkeypatch):
    """A sample with more turns than a window may take is numbered in slices."""
    kinds = "struct<dir double, facing double, pos double, overall double>"
    logs = spark.range(600).selectExpr("IF(id % 10 = 0, id % 3, 7) AS sample", "CAST(id AS INT) AS turn", "id % 4 > 0 AS is_exploration_phase", *[
        f"CAST((id / 8, id / 4, id / 2, id * 1.0) AS {kinds}) AS {s}" for s in ("global", "full", "agent")], "CAST((0.5, 0.25, id / 8) AS struct<precision double, recall double, f1 double>) AS probe")
    steady = logs.filter("turn % 3 = 0").select("sample", "turn", *[F.col("global.dir").alias(c) for c in maps.STEADY])
    told = logs.select("sample", "turn", "full.*")
    made = lambda: sorted(map(str, maps.sample_series(logs, steady, unchanged=told).collect()))
    plain = made()
    monkeypatch.setattr(distributed, "WINDOW_ROWS", 1)
    assert made() == plain and len(plain) == 450 + 4 + 200 + 600
