"""Device samples and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollframe.distributed import ordered, previous, running
from rollframe.operators.trajectories import issues

DEVICE = ["run", "gpu_index"]


def device_summary(samples: DataFrame) -> DataFrame:
    """Per device: name of the first sample, peak memory, mean utilization (unknown ones left out)."""
    return samples.groupBy(*DEVICE).agg(
        F.min_by("gpu_name", F.struct("elapsed_seconds", "sample")).alias("gpu_name"), F.max("memory_used_mib").alias("peak_vram_mib"),
        F.avg("utilization_percent").alias("mean_utilization"), F.count("*").alias("samples"))


def device_energy(samples: DataFrame) -> DataFrame:
    """Trapezoid energy per device; a pair with an unknown end is skipped, no pair gives null."""
    order = ["elapsed_seconds", "sample"]
    slim = samples.select(*DEVICE, *order, "power_watts")
    pairs = previous(ordered(slim, DEVICE, order), DEVICE, order, {"_t": "elapsed_seconds", "_p": "power_watts"})
    wh = (F.col("power_watts") + F.col("_p")) / 2 * (F.col("elapsed_seconds") - F.col("_t")) / 3600
    return pairs.groupBy(*DEVICE).agg((F.sum(wh) / 1000).alias("energy_kwh"))


def run_summary(samples: DataFrame, durations: DataFrame) -> DataFrame:
    """Per run: devices, hours times devices, peak, energy. Without samples everything stays null."""
    devices = device_summary(samples).join(device_energy(samples), DEVICE)
    per = devices.groupBy("run").agg(F.count("*").alias("gpu_count"), F.max("peak_vram_mib").alias("peak_vram_mib"),
                                     F.sum("energy_kwh").alias("energy_kwh"), F.sum("samples").alias("sample_count"))
    return durations.join(per, "run", "left").select(
        "run", "duration_seconds", F.coalesce("gpu_count", F.lit(0)).alias("gpu_count"),
        (F.col("duration_seconds") / 3600 * F.col("gpu_count")).alias("gpu_hours"), "peak_vram_mib", "energy_kwh",
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"))


def merge_sessions(samples: DataFrame, sessions: DataFrame) -> DataFrame:
    """Put the sessions of a run on one time axis: each starts where the earlier ones ended."""
    bad = F.when(F.col("duration_seconds") < 0, F.raise_error(F.lit("duration must not be negative")).cast("boolean"))
    order = ["session"]
    ends = running(ordered(sessions.filter(bad.isNull()), ["run"], order), ["run"], order, {"_end": F.col("duration_seconds")})
    shift = ends.select("run", "session", (F.col("_end") - F.col("duration_seconds")).alias("_shift"))
    return samples.join(shift, ["run", "session"]).withColumn(
        "elapsed_seconds", F.col("elapsed_seconds") + F.col("_shift")).drop("_shift")


def session_inventory_issues(samples: DataFrame) -> DataFrame:
    """Runs whose sessions do not all see the same devices."""
    seen = samples.select("run", "session", "gpu_index", "gpu_name", "memory_total_mib").distinct()
    per = seen.groupBy("run", "gpu_index", "gpu_name", "memory_total_mib").agg(F.count("*").alias("_in"))
    total = seen.groupBy("run").agg(F.countDistinct("session").alias("sessions"))
    return per.join(total, "run").groupBy("run").agg(
        F.max("sessions").alias("sessions"), F.count_if(F.col("_in") < F.col("sessions")).alias("mismatched_devices")).withColumn(
            "issues", issues((F.col("mismatched_devices") > 0, "sessions have different devices")))


def device_count_issues(samples: DataFrame, expected: int) -> DataFrame:
    per = samples.groupBy("run").agg(F.countDistinct("gpu_index").alias("gpu_count"))
    return per.withColumn("issues", issues((F.col("gpu_count") != expected, f"expected {expected} devices")))


def latency_summary(rows: DataFrame, generate: str, tools: str, attributes: list[str], key: str, *by: str) -> DataFrame:
    """Min, max, mean of both phases and the attributes of the slowest row (ties by key)."""
    slow = F.max_by(F.struct(generate, tools, *attributes), F.struct(F.col(generate) + F.col(tools), -F.col(key))).alias("_s")
    out = rows.groupBy(*by).agg(
        *[f(c).alias(f"{c}_{n}") for c in (generate, tools) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))], slow)
    return out.select("*", *[F.col(f"_s.{c}").alias(f"slowest_{c}") for c in (generate, tools, *attributes)]).drop("_s")


def load_rounds(clients: DataFrame) -> DataFrame:
    """Per round of a load test: throughput and mean latencies of the clients that did not fail.

    Step times are summed inside each client row, so nothing is exploded.
    """
    ok = F.col("error").isNull()
    when = lambda c: F.when(ok, c)
    total = F.aggregate("step_times", F.lit(0.0), lambda a, x: a + x)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    agg = clients.groupBy("round").agg(
        F.max("round_time").alias("round_time"), F.count_if(ok).alias("num_successful"), F.count_if(~ok).alias("num_errors"),
        F.coalesce(F.sum(when(F.col("steps_completed"))), F.lit(0)).alias("total_steps"),
        zero(F.avg(when(F.col("reset_time")))).alias("avg_reset_time"), zero(F.avg(when(F.col("close_time")))).alias("avg_close_time"),
        zero(F.sum(when(total)) / F.nullif(F.sum(when(F.size("step_times"))), F.lit(0))).alias("avg_step_time"),
        zero(F.max(when(F.array_max("step_times")))).alias("max_step_time"))
    return agg.withColumn("steps_per_second", F.when(F.col("round_time") > 0, F.col("total_steps") / F.col("round_time")).otherwise(0.0))
