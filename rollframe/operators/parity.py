"""Agreement between rollout and training log-probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollframe.distributed import exact_quantiles, with_row
from rollframe.operators.trajectories import issues

# Fixed value: log-ratios are cut to this range before the exponential.
MAX_LOG_RATIO = 80.0


def token_ratios(turns: DataFrame, train: str, rollout: str, mask: str, by: list[str]) -> DataFrame:
    """One row per valid token: its log-probability delta and ratio. Bad input fails the job."""
    shaped = F.when((F.size(train) != F.size(rollout)) | (F.size(train) != F.size(mask)),
                    F.raise_error(F.lit("log-probabilities and mask differ in shape")).cast("boolean"))
    rows = turns.filter(shaped.isNull()).select(*by, F.explode(F.arrays_zip(
        F.col(train).alias("p"), F.col(rollout).alias("q"), F.col(mask).alias("m"))).alias("z")).filter("z.m != 0")
    delta = F.col("z.p").cast("double") - F.col("z.q").cast("double")
    bad = F.when(delta.isNull() | F.isnan(delta) | (F.abs(delta) == float("inf")),
                 F.raise_error(F.lit("non-finite log-probabilities")).cast("boolean"))
    return rows.filter(bad.isNull()).select(*by, delta.alias("delta")).withColumn(
        "ratio", F.exp(F.greatest(F.lit(-MAX_LOG_RATIO), F.least(F.lit(MAX_LOG_RATIO), F.col("delta")))))


def ratio_statistics(ratios: DataFrame, by: list[str], clip_low: float = 0.8, clip_high: float = 1.2,
                     exact: bool = True) -> DataFrame:
    """Per run: mean, median, p95, p99, mean absolute delta, clipped share, token count.

    ``exact=False`` takes the quantiles from Spark's own sketch (relative rank error 1e-4).
    """
    if not 0 < clip_low < 1 < clip_high:
        raise ValueError("expected 0 < clip_low < 1 < clip_high")
    outside = (F.col("ratio") < clip_low) | (F.col("ratio") > clip_high)
    plain = ratios.groupBy(*by).agg(
        F.avg("ratio").alias("ratio_mean"), F.avg(F.abs("delta")).alias("mean_abs_logprob_delta"),
        F.avg(outside.cast("double")).alias("pre_update_clip_fraction"), F.count("*").alias("num_tokens"))
    probs = {"ratio_median": 0.5, "ratio_p95": 0.95, "ratio_p99": 0.99}
    if exact:
        quantiles = exact_quantiles(ratios, by, "ratio", probs)
    else:
        quantiles = ratios.groupBy(*by).agg(F.percentile_approx("ratio", list(probs.values()), 10000).alias("q")).select(
            *by, *[F.col("q")[i].alias(n) for i, n in enumerate(probs)])
    return plain.join(quantiles, by) if by else with_row(plain, quantiles)


def parity_gate(stats: DataFrame, max_p95_deviation: float | None = None, max_p99_deviation: float = 0.2,
                max_mean_abs_delta: float = 0.1, max_clip_fraction: float = 0.05) -> DataFrame:
    """Add ``failures`` and ``gate_passed``; ``trajectories.fail_on`` makes it strict."""
    rules = []
    if max_p95_deviation is not None:
        rules.append((F.abs(F.col("ratio_p95") - 1) > max_p95_deviation, "ratio p95 deviation too large"))
    rules += [(F.abs(F.col("ratio_p99") - 1) > max_p99_deviation, "ratio p99 deviation too large"),
              (F.col("mean_abs_logprob_delta") > max_mean_abs_delta, "mean absolute logprob delta too large"),
              (F.col("pre_update_clip_fraction") > max_clip_fraction, "pre-update clip fraction too large")]
    return stats.withColumn("failures", issues(*rules)).withColumn("gate_passed", F.size("failures") == 0)


def attempt_history(attempts: DataFrame) -> DataFrame:
    """Per run: latest attempt and whether any attempt ever failed."""
    return attempts.groupBy("run").agg(
        F.count("*").alias("attempts"), F.max("attempt_no").alias("latest_attempt"),
        F.max_by("gate_passed", "attempt_no").alias("latest_passed"),
        F.bool_or(F.col("gate_passed") == False).alias("ever_failed"))  # noqa: E712
