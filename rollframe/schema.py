"""Declared schemas of the input tables."""

from __future__ import annotations

# Rollout lines; flags arrive as booleans or as 0.0/1.0, so they are read as text.
TURN = """input STRING, output STRING, gts STRING, score DOUBLE, step INT, group_idx STRING, traj_idx INT, turn_idx INT,
  last_turn STRING, traj_success STRING, action_is_valid STRING, state_anchor STRING, request_id STRING,
  num_turns DOUBLE, __num_turns__ DOUBLE, reward_extra_info STRUCT<num_turns: DOUBLE, __num_turns__: DOUBLE>"""
TURN_FLAGS = ["last_turn", "traj_success", "action_is_valid"]

EPISODE = """rollout_id STRING, env_name STRING, tag_id STRING, split STRING, finish_reason STRING, observation_ablation STRING,
  seed BIGINT, max_turns INT, num_turns DOUBLE, success BOOLEAN, terminated BOOLEAN, concat_multi_turn BOOLEAN,
  cumulative_reward DOUBLE, rewards ARRAY<DOUBLE>, infos STRING, error STRING"""

MANIFEST = """method STRING, environment STRING, model STRING, evaluation_role STRING, observation_ablation STRING,
  advantage_estimator STRING, commit STRING, verl_commit STRING, source_run_dir STRING, source_method STRING,
  source_environment STRING, source_selection_manifest STRING, source_export_manifest STRING, seed BIGINT, seed_start BIGINT,
  n_envs BIGINT, total_steps BIGINT, validation_n_envs BIGINT, lora_rank BIGINT, source_train_seed BIGINT,
  source_checkpoint_step BIGINT, git_dirty BOOLEAN, concat_multi_turn BOOLEAN, loss_weighting STRING, expected_seeds ARRAY<BIGINT>"""
PARITY = """gate_enabled BOOLEAN, gate_passed BOOLEAN,
  metrics STRUCT<ratio_mean: DOUBLE, ratio_median: DOUBLE, ratio_p95: DOUBLE, ratio_p99: DOUBLE, mean_abs_logprob_delta: DOUBLE,
    pre_update_clip_fraction: DOUBLE, num_tokens: BIGINT>,
  attempts ARRAY<STRUCT<gate_passed: BOOLEAN, gate_enabled: BOOLEAN, global_step: INT, error: STRING>>"""
GPU_SUMMARY = """return_code INT, sample_count INT, gpu_count INT, expected_device_count INT, peak_vram_mib DOUBLE, gpu_hours DOUBLE,
  duration_seconds DOUBLE, energy_kwh_estimate DOUBLE, sampling_errors ARRAY<STRING>"""

GPU_SAMPLE_COLUMNS = ["elapsed_seconds", "gpu_index", "gpu_name", "memory_used_mib", "memory_total_mib", "utilization_percent", "power_watts"]

_MAP_METRICS = "STRUCT<dir: DOUBLE, facing: DOUBLE, pos: DOUBLE, overall: DOUBLE>"
ENV_LOG = f"""sample STRING, env_turn_logs ARRAY<STRUCT<
  is_exploration_phase: BOOLEAN, info: STRUCT<is_valid_action: BOOLEAN>,
  exploration_log: STRUCT<node_coverage: DOUBLE, edge_coverage: DOUBLE, step: INT, information_gain: DOUBLE, is_action_fail: BOOLEAN,
    action_counts: MAP<STRING, INT>, observed_items: ARRAY<STRING>, possible_positions: MAP<STRING, ARRAY<ARRAY<INT>>>,
    all_candidate_coords: ARRAY<ARRAY<INT>>, all_candidate_dists: ARRAY<DOUBLE>>,
  cogmap_log: STRUCT<global: STRUCT<metrics: {_MAP_METRICS}, metrics_full: {_MAP_METRICS}, metric_agent: {_MAP_METRICS}>,
    local: STRUCT<metrics: {_MAP_METRICS}>, local_newly: STRUCT<metrics: {_MAP_METRICS}>,
    consistency: STRUCT<local_vs_global: {_MAP_METRICS}>>>>"""
