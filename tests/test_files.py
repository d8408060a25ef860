"""Readers and sinks on real files."""

import json

import pytest

from rollframe.operators import runs as R
from rollframe.sources import readers, writers


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_rollout_lines(spark, tmp_path):
    lines = ['{"group_idx":"a","traj_idx":0,"turn_idx":1,"score":1,"last_turn":1.0,"traj_success":true,"odd":{"x":5}}', "", "  ", "[1]", "3", '"text"',
             '{"group_idx":7,"score":null,"last_turn":0.0}']
    put(tmp_path / "rollouts" / "12.jsonl", "\n".join(lines) + "\n")
    put(tmp_path / "rollouts" / "notes.jsonl", '{"score": 2}\n')
    rows = readers.read_rollouts(spark, str(tmp_path / "rollouts"), rescue=True).orderBy("step", "group_idx").collect()
    assert [(r.step, r.group_idx, r.last_turn, r.traj_success) for r in rows] == [(None, None, None, None), (12, "7", False, None), (12, "a", True, True)]
    assert json.loads(rows[2].rescued.toJson())["odd"] == {"x": 5}
    put(tmp_path / "bad" / "1.jsonl", '{"score": \n{"score": 1}\nnot json\n')
    loose = readers.read_rollouts(spark, str(tmp_path / "bad"), strict=False).collect()
    assert sorted(str(r._bad) for r in loose) == ["None", "not json", '{"score":']
    with pytest.raises(Exception, match="invalid JSON in .*1.jsonl"):
        readers.read_rollouts(spark, str(tmp_path / "bad")).collect()


def test_latest_files(spark, tmp_path):
    for name in ("a/rollouts/9", "a/rollouts/10", "a/validation/3", "a/validation/last", "b/rollouts/9", "b/rollouts/10"):
        put(tmp_path / f"{name}.jsonl", json.dumps({"score": 1.0, "output": name}) + "\n")
    rows = readers.read_latest_rollouts(spark, str(tmp_path)).collect()
    assert sorted(r.output for r in rows) == ["a/validation/3", "b/rollouts/10"]
    assert sorted(r.run.rsplit("/", 1)[1] for r in rows) == ["a", "b"]


def test_evaluation_dump(spark, tmp_path):
    flag = lambda *v: [{"metrics": {"turn_metrics": {"action_is_valid": x}}} for x in v]
    put(tmp_path / "t" / "e1" / "metrics.json", {"success": True, "num_turns": 2, "cumulative_reward": 1.2, "infos": flag(True, True), "finish_reason": "done", "env_name": "x",
                                                 "seed": 1, "tag_id": 3, "concat_multi_turn": True})
    put(tmp_path / "t" / "e1" / "assistant_texts.json", ["<answer>right</answer>"])
    put(tmp_path / "t" / "e2" / "metrics.json", {"rollout_id": "two", "infos": flag(True, False, False, True), "terminated": True, "success": True, "seed": 2})
    put(tmp_path / "t" / "e3" / "metrics.json", "{broken")
    put(tmp_path / "t" / "e4" / "metrics.json", "[1]")
    put(tmp_path / "t" / "e4" / "meta.json", {"tag_id": "m"})
    got = {r.rollout_id: r for r in readers.read_episodes(spark, str(tmp_path)).collect()}
    assert set(got) == {"e1", "two"}
    assert (got["e1"].valid_action_count, got["e1"].action_check_count, got["e1"].assistant_texts) == (2, 2, ["<answer>right</answer>"])
    two = got["two"]
    assert (two.valid_action_count, two.action_check_count, two.num_turns, two.cumulative_reward, two.assistant_texts, two.observation_ablation) == (2, 4, 0, 0.0, [], "none")
    done = readers.read_finished(spark, str(tmp_path)).collect()
    assert [(r.env_name, r.seed, r.tag_id, r.concat_multi_turn) for r in done] == [("x", 1, "3", True)]


def test_runs_and_status(spark, tmp_path):
    base = {"commit": "a", "verl_commit": "b", "git_dirty": False, "method": "m", "environment": "e", "n_envs": 2, "evaluation_role": "final_test"}
    put(tmp_path / "r1" / "manifest.json", base)
    put(tmp_path / "r1" / "gpu_metrics" / "gpu_summary.json", {"return_code": 0, "sample_count": 3, "peak_vram_mib": 10, "gpu_hours": 1.5, "sampling_errors": []})
    put(tmp_path / "r2" / "manifest.json", {**base, "evaluation_role": None, "advantage_estimator": "gae"})
    put(tmp_path / "r2" / "parity.json", {"gate_enabled": True, "gate_passed": True, "metrics": {"ratio_p95": 1.1}, "attempts": [{"gate_passed": False}, {"gate_passed": True}]})
    found = readers.read_runs(spark, str(tmp_path))
    more = found.selectExpr("*", "2L AS episodes", "2L AS distinct_seeds", "false AS evaluation_failed", "CAST(NULL AS INT) AS latest_step", "CAST(NULL AS BIGINT) AS trajectories",
                            "verl_commit AS stack_commit", "true AS command_saved", "true AS config_saved", "0.5D AS success_rate", "2.0D AS mean_turns", "'x' AS evidence")
    rows = {r.run.rsplit("/", 1)[1]: r for r in more.select("run", R.run_status().alias("status"), R.resume_state().alias("resume"), "gpu_hours", "ratio_p95").collect()}
    assert (rows["r1"].status, rows["r1"].resume, rows["r1"].gpu_hours, rows["r1"].ratio_p95) == ("complete", "complete", 1.5, None)
    assert (rows["r2"].status, rows["r2"].resume, rows["r2"].gpu_hours, rows["r2"].ratio_p95) == ("failed", "failed-parity", None, 1.1)
    assert R.result_rows(more).columns == R.RESULT_COLUMNS
    assert readers.read_runs(spark, str(tmp_path), role="final_test").count() == 1


def test_device_files(spark, tmp_path):
    put(tmp_path / "s.csv", "elapsed_seconds,gpu_index,gpu_name,memory_used_mib,memory_total_mib,utilization_percent,power_watts\n0.5,0,dev,10,80,,[N/A]\n1.5,0,dev,12,80,55,200.5\n")
    rows = readers.read_gpu_samples(spark, str(tmp_path / "s.csv")).orderBy("elapsed_seconds").collect()
    assert [(r.utilization_percent, r.power_watts) for r in rows] == [(None, None), (55.0, 200.5)]
    lines = spark.createDataFrame([("0, dev A, 10.0, 80.0, 50, [N/A]",), ("0, dev A, 10.0, 80.0, 50",), ("x, dev, 1, 2, 3, 4",), ("1, dev, 1, 2, N/A, ten",)], "value string")
    r = readers.parse_device_lines(lines).collect()
    assert len(r) == 1 and r[0].power_watts is None and r[0].memory_used_mib == 10.0


def test_gated_publication(spark, tmp_path):
    rows, base = spark.createDataFrame([("m", 1.0)], "method string, v double"), str(tmp_path / "pub")
    no, yes = spark.createDataFrame([(False,)], "registry_complete boolean"), spark.createDataFrame([(True,)], "registry_complete boolean")
    with pytest.raises(ValueError, match="refusing"):
        writers.publish(rows, no, base)
    with pytest.raises(ValueError, match="nothing is published"):
        writers.read_published(spark, base)
    first = writers.publish(rows, yes, base)
    writers.publish(rows.selectExpr("method", "v + 1 AS v"), yes, base)
    assert writers.read_published(spark, base).first().v == 2.0
    assert writers.current_pointer(spark, base).previous == first and spark.read.parquet(first).first().v == 1.0


def test_csv_columns(spark, tmp_path):
    writers.write_csv(spark.createDataFrame([(1, 2)], "a int, b int"), str(tmp_path / "c"), ["b", "missing"])
    r = spark.read.csv(str(tmp_path / "c"), header=True).first()
    assert r.asDict() == {"b": "2", "missing": None}


def test_publishers_never_share_a_version(spark, tmp_path):
    """A number that another publisher has claimed, but not yet pointed to, is passed over."""
    base = str(tmp_path / "out")
    rows = spark.createDataFrame([(1.0,)], "v double")
    yes = spark.createDataFrame([(True,)], "registry_complete boolean")
    writers.publish(rows, yes, base)
    (tmp_path / "out" / "claims" / "2").touch()
    writers.publish(rows, yes, base)
    assert writers.current_pointer(spark, base).version == 3
