"""Run status and resume state from the artifacts of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: columns of the result table.
RESULT_COLUMNS = ["Method", "Visual Success", "Peak VRAM", "GPU·h", "Mean Turns", "Ratio P95",
                  "Status", "Environment", "Seed", "Commit", "Evidence"]


def _is(c: str, value) -> Column:
    return F.col(c).eqNullSafe(F.lit(value))


def gpu_complete() -> Column:
    return (_is("gpu_return_code", 0) & (F.coalesce("gpu_sample_count", F.lit(0)) > 0) & F.col("peak_vram_mib").isNotNull()
            & F.col("gpu_hours").isNotNull() & (F.coalesce("gpu_sampling_errors", F.lit(0)) == 0)
            & (F.col("expected_device_count").isNull() | F.col("expected_device_count").eqNullSafe(F.col("gpu_count"))))


def parity_failed_once() -> Column:
    return _is("gate_passed", False) | F.coalesce("parity_ever_failed", F.lit(False))


def behavior_complete() -> Column:
    """Evaluation: as many episodes and seeds as declared. Training: the last step, complete."""
    n, total, want = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_envs", "total_steps", "validation_n_envs"))
    evaluated = (n > 0) & (F.col("episodes") == n) & (F.col("distinct_seeds") == n)
    trained = (total > 0) & F.coalesce(F.col("latest_step") == total, F.lit(False)) & (want > 0) & (
        F.coalesce(F.col("trajectories") == want, F.lit(False)))
    return F.when(F.coalesce("episodes", F.lit(0)) > 0, evaluated).otherwise(trained)


def provenance_complete() -> Column:
    """Commits known, clean tree, command and config kept."""
    named = (F.coalesce("commit", F.lit("")) != "") & (F.coalesce("stack_commit", F.lit("")) != "") & _is("git_dirty", False)
    return named & F.coalesce("command_saved", F.lit(False)) & F.coalesce("config_saved", F.lit(False))


def run_status() -> Column:
    """failed, complete, incomplete-artifacts or not-run."""
    training = F.col("advantage_estimator").isNotNull()
    failed = ((F.col("gpu_return_code").isNotNull() & (F.col("gpu_return_code") != 0))
              | F.coalesce("evaluation_failed", F.lit(False)) | (training & parity_failed_once()))
    parity = ~training | (_is("gate_enabled", True) & _is("gate_passed", True))
    anything = (F.coalesce("has_manifest", F.lit(False)) | (F.coalesce("episodes", F.lit(0)) > 0) | F.col("latest_step").isNotNull()
                | F.col("gpu_sample_count").isNotNull() | F.col("gate_passed").isNotNull())
    return (F.when(failed, "failed").when(behavior_complete() & gpu_complete() & parity & provenance_complete(), "complete")
            .when(anything, "incomplete-artifacts").otherwise("not-run"))


def resume_state() -> Column:
    tainted = (F.coalesce("gpu_sampling_errors", F.lit(0)) > 0) | (
        F.col("expected_device_count").isNotNull() & ~F.col("expected_device_count").eqNullSafe(F.col("gpu_count")))
    return (F.when(parity_failed_once(), "failed-parity").when(tainted, "tainted-gpu-metrics")
            .when(run_status() == "complete", "complete").otherwise("resumable"))


def result_rows(runs: DataFrame) -> DataFrame:
    """The eleven columns of the result table."""
    return runs.select(
        F.coalesce("method", F.lit("unknown")).alias("Method"), F.col("success_rate").alias("Visual Success"),
        F.col("peak_vram_mib").alias("Peak VRAM"), F.col("gpu_hours").alias("GPU·h"), F.col("mean_turns").alias("Mean Turns"),
        F.col("ratio_p95").alias("Ratio P95"), run_status().alias("Status"), F.col("environment").alias("Environment"),
        F.coalesce("seed", "seed_start").alias("Seed"), F.col("commit").alias("Commit"), F.col("evidence").alias("Evidence"))
