"""Experiment statistics over runs, seeds, methods and environments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollframe.distributed import exact_quantiles, null_safe, ordered, running, with_row
from rollframe.functions import draws as D
from rollframe.functions import inference as I
from rollframe.operators.trajectories import issues

RUN = ["method", "environment", "seed"]


def run_results(episodes: DataFrame, *keys: str) -> DataFrame:
    """Per run: trials, successes, turn moments of successful episodes."""
    t = F.when(F.col("success"), F.col("num_turns"))
    return episodes.groupBy(*(keys or RUN)).agg(
        F.count("*").alias("trials"), F.count_if("success").alias("successes"), F.avg(t).alias("mean_turns"),
        F.sum(t).alias("turn_sum"), (F.sum("num_turns") * 0.01).alias("gpu_hours"),
        (F.max("num_turns") * 100.0).alias("peak_vram_mib")).withColumn("success_rate", F.col("successes") / F.col("trials"))


def bootstrap_mean(values: DataFrame, by: list[str], value: str, confidence: float = 0.95,
                   resamples: int = 10000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean from a Poisson bootstrap.

    Equal values (to 13 digits) are counted first. A value that occurs n times weighs a Poisson
    count of mean n in each resample, drawn by :mod:`rollframe.functions.draws` from the seed, the
    group, the value and the resample, so it depends on no partition, retry or engine. Every
    task adds up its values per resample before anything is shuffled.
    """
    x = F.col(value).cast("double")
    hist = values.filter(F.col(value).isNotNull()).groupBy(*by, D.number_text(x).alias("_text")).agg(F.count("*").alias("_n"), F.min(x).alias("_x"))
    seeded = hist.withColumn("_seed", D.text_seed(F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("_text")))
    every = seeded.select(*by, "_n", "_x", "_seed", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_b"))
    drawn = D.poisson_draws(every, "_n", "_seed", "_b", "_w")
    means = drawn.groupBy(*by, "_b").agg((F.sum(F.col("_w") * F.col("_x")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_m"))
    alpha = (1 - confidence) / 2
    # One value per resample: the group has a fixed size.
    ends = means.groupBy(*by).agg(F.percentile("_m", F.array(F.lit(alpha), F.lit(1 - alpha))).alias("q"))
    point = hist.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("mean"))
    both = null_safe(point, ends, by) if by else with_row(point, ends)
    single = F.col("n") == 1
    return both.select(*by, "n", "mean", F.when(single, F.col("mean")).otherwise(F.col("q")[0]).alias("ci_low"),
                       F.when(single, F.col("mean")).otherwise(F.col("q")[1]).alias("ci_high"))


def mann_whitney(values: DataFrame, by: list[str], value: str, side: str, method: str = "auto") -> DataFrame:
    """U of the ``side = true`` sample against the other, with sizes, tie sum, z and p (by ``method``).

    Values are counted per side first; the running count of the other side then gives U
    without ranking single rows.
    """
    first = F.col(side)
    hist = values.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("x")).agg(
        F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    ranked = running(ordered(hist, by, ["x"]), by, ["x"], {"cum_b": F.col("b")})
    t = (F.col("a") + F.col("b")).cast("double")
    stats = ranked.groupBy(*by).agg(
        F.sum("a").alias("n1"), F.sum("b").alias("n2"),
        F.sum(F.col("a") * (F.col("cum_b") - F.col("b") + 0.5 * F.col("b"))).alias("u"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0)))
    top = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    return stats.withColumn("z", F.when(var > 0, (top - n1 * n2 / 2 - 0.5) / F.sqrt(var))).withColumn(
        "p_value", I.mann_whitney_p("u", "n1", "n2", "ties", method))


def _pairs(spark, names: list[str]) -> DataFrame:
    """Each unordered pair of the given names, one row per member."""
    rows = [(a, b, m, m == a) for i, a in enumerate(names) for b in names[i + 1:] for m in (a, b)]
    return spark.createDataFrame(rows, "first string, second string, member string, is_first boolean")


def compare_success(runs: DataFrame, member: str, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Success of each pair of methods or modes: rates, intervals, differences, Fisher test.

    The pair list comes from the given names, and rows are pooled per name before pairing.
    """
    by = by or []
    pooled = runs.groupBy(*by, F.col(member).alias("member")).agg(F.sum("successes").alias("s"), F.sum("trials").alias("n"))
    both = pooled.join(F.broadcast(_pairs(runs.sparkSession, names)), "member").groupBy(*by, "first", "second").agg(*[
        F.coalesce(F.sum(F.when(F.col("is_first") == flag, F.col(c))), F.lit(0)).alias(f"{c}{i}")
        for i, flag in ((1, True), (2, False)) for c in ("s", "n")])
    rate = lambda i: F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")).otherwise(0.0)
    out = both.withColumn("rate1", rate(1)).withColumn("rate2", rate(2))
    for i in (1, 2):
        ci = I.wilson(F.col(f"s{i}"), F.col(f"n{i}"))
        out = out.withColumn(f"ci_low{i}", ci["low"]).withColumn(f"ci_high{i}", ci["high"])
    counts = [F.col(c) for c in ("s1", "n1", "s2", "n2")]
    return out.select("*", (F.col("rate1") - F.col("rate2")).alias("difference"),
                      F.when(F.col("rate2") > 0, F.col("rate1") / F.col("rate2") - 1).otherwise(float("inf")).alias("relative"),
                      I.odds_ratio(*counts).alias("odds_ratio"), I.fisher_p(*counts).alias("p_value")).withColumn(
                          "significant", F.col("p_value") < 0.05)


def compare_turns(episodes: DataFrame, member: str, names: list[str], value: str = "num_turns",
                  resamples: int = 10000) -> DataFrame:
    """Turns of successful episodes per pair: means, intervals, effect size, rank test."""
    won = episodes.filter("success").select(F.col(member).alias("member"), F.col(value).cast("double").alias("x"))
    hist = won.groupBy("member", "x").agg(F.count("*").alias("c"))
    moments = won.groupBy("member").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))
    ci = bootstrap_mean(won, ["member"], "x", resamples=resamples).select("member", "ci_low", "ci_high")
    pairs = F.broadcast(_pairs(episodes.sparkSession, names))
    cols = ["n", "mean", "var", "ci_low", "ci_high"]
    wide = moments.join(ci, "member").join(pairs, "member").groupBy("first", "second").agg(*[
        F.max(F.when(F.col("is_first") == flag, F.col(c))).alias(f"{c}{i}") for i, flag in ((1, True), (2, False)) for c in cols])
    tests = weighted_mann_whitney(hist.join(pairs, "member"), ["first", "second"])
    d = I.cohens_d(*[F.col(c) for c in ("n1", "mean1", "var1", "n2", "mean2", "var2")])
    return wide.join(tests, ["first", "second"]).withColumn("cohens_d", d).withColumn("effect", I.effect_label(d)).withColumn(
        "significant", F.col("p_value") < 0.05).drop("var1", "var2")


def weighted_mann_whitney(counted: DataFrame, by: list[str]) -> DataFrame:
    """The rank test over value counts ``(x, c, is_first)``."""
    hist = counted.groupBy(*by, "x").agg(F.coalesce(F.sum(F.when(F.col("is_first"), F.col("c"))), F.lit(0)).alias("a"),
                                         F.coalesce(F.sum(F.when(~F.col("is_first"), F.col("c"))), F.lit(0)).alias("b"))
    ranked = running(ordered(hist, by, ["x"]), by, ["x"], {"cum_b": F.col("b")})
    t = (F.col("a") + F.col("b")).cast("double")
    return ranked.groupBy(*by).agg(
        F.sum("a").alias("_n1"), F.sum("b").alias("_n2"),
        F.sum(F.col("a") * (F.col("cum_b") - 0.5 * F.col("b"))).alias("u"), F.sum(t * t * t - t).alias("_t")).withColumn(
            "p_value", I.mann_whitney_p("u", "_n1", "_n2", "_t")).drop("_n1", "_n2", "_t")


def seed_aggregate(runs: DataFrame, by: list[str], expected_seeds: list[int] | None = None) -> DataFrame:
    """Across seeds: macro mean and spread, pooled rate, turns, hours, memory, and what is inconsistent."""
    stats = runs.groupBy(*by).agg(
        F.count("*").alias("n_seeds"), F.avg("success_rate").alias("success_mean"),
        F.coalesce(F.stddev_samp("success_rate"), F.lit(0.0)).alias("success_std"),
        (F.sum("successes") / F.nullif(F.sum("trials"), F.lit(0))).alias("success_pooled"),
        F.sum("successes").alias("total_successes"), F.sum("trials").alias("total_trials"),
        F.avg("mean_turns").alias("turns_mean"), F.coalesce(F.stddev_samp("mean_turns"), F.lit(0.0)).alias("turns_std"),
        (F.sum("turn_sum") / F.nullif(F.sum("successes"), F.lit(0))).alias("turns_pooled"),
        F.avg("gpu_hours").alias("gpu_hours_mean"), F.coalesce(F.stddev_samp("gpu_hours"), F.lit(0.0)).alias("gpu_hours_std"),
        F.sum("gpu_hours").alias("gpu_hours_total"), F.max("peak_vram_mib").alias("peak_vram_max"),
        F.countDistinct("seed").alias("_distinct"), F.count("seed").alias("_seeds"),
        F.countDistinct("method").alias("_methods"), F.countDistinct("environment").alias("_envs"),
        F.sum((F.lit(expected_seeds is not None) & ~F.coalesce(F.col("seed").isin(expected_seeds or [-1]), F.lit(False))).cast("int")).alias("_odd"))
    rules = [(F.col("_methods") > 1, "multiple methods"), (F.col("_envs") > 1, "multiple environments")]
    if expected_seeds is not None:
        rules += [(F.col("n_seeds") != F.col("_distinct"), "duplicate or missing seeds"),
                  ((F.col("_odd") > 0) | (F.col("_distinct") != len(set(expected_seeds))), "unexpected seed set")]
    return stats.withColumn("issues", issues(*rules)).drop("_distinct", "_seeds", "_methods", "_envs", "_odd")


def environment_gap(aggregates: DataFrame, by: str = "method") -> DataFrame:
    """Easiest and hardest environment of each method and the gap between them (ties by name)."""
    rate, env = F.col("success_pooled"), F.col("environment")
    return aggregates.groupBy(by).agg(
        F.min_by(env, F.struct(-F.coalesce(rate, F.lit(0.0)), env)).alias("easier"),
        F.min_by(env, F.struct(F.coalesce(F.nullif(rate, F.lit(0.0)), F.lit(1.0)), env)).alias("harder"),
        (F.max(F.coalesce(rate, F.lit(0.0))) - F.min(F.coalesce(rate, F.lit(0.0)))).alias("gap"))


def matrix_aggregate(runs: DataFrame, groupings: tuple[str, ...] = ("method", "environment", "seed")) -> DataFrame:
    """Runs grouped by method, by environment and by seed in one pass, mixed groups flagged."""
    keyed = runs.select("*", *[F.col(g).cast("string").alias(f"_g_{g}") for g in groupings])
    grouped = keyed.groupingSets([[F.col(f"_g_{g}")] for g in groupings], *[F.col(f"_g_{g}") for g in groupings]).agg(
        F.grouping_id().alias("_id"), F.count("*").alias("runs"), F.avg("success_rate").alias("success_mean"),
        (F.sum("successes") / F.sum("trials")).alias("success_pooled"), F.sum("gpu_hours").alias("gpu_hours_total"),
        F.countDistinct("method").alias("_m"), F.countDistinct("environment").alias("_e"))
    full = 2 ** len(groupings) - 1
    kind = F.lit(None).cast("string")
    for i, g in enumerate(groupings):
        kind = F.when(F.col("_id") == full - 2 ** (len(groupings) - 1 - i), g).otherwise(kind)
    out = grouped.select(kind.alias("group_by"), F.coalesce(*[F.col(f"_g_{g}") for g in groupings], F.lit("unknown")).alias("group_key"),
                         "runs", "success_mean", "success_pooled", "gpu_hours_total",
                         issues((F.col("_m") > 1, "multiple methods"), (F.col("_e") > 1, "multiple environments")).alias("issues"))
    return out


def seed_stability(runs: DataFrame, by: list[str]) -> DataFrame:
    """Coefficient of variation and range over seeds, with a label; one seed says nothing."""
    stats = runs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("success_rate").alias("m"), F.stddev_samp("success_rate").alias("s"),
        F.avg("mean_turns").alias("tm"), F.stddev_samp("mean_turns").alias("ts"),
        F.min("success_rate").alias("lo"), F.max("success_rate").alias("hi"))
    enough = F.col("n") >= 2
    cv = F.when(enough, F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(float("inf")))
    tcv = F.when(enough, F.when(F.col("tm") > 0, F.col("ts") / F.col("tm")).otherwise(float("inf")))
    label = (F.when(~enough, "insufficient_seeds").when(cv < 0.1, "highly_stable").when(cv < 0.2, "stable")
             .when(cv < 0.5, "moderate_variance").otherwise("high_variance"))
    return stats.select(*by, cv.alias("success_rate_cv"), tcv.alias("mean_turns_cv"),
                        F.when(enough, F.col("hi") - F.col("lo")).alias("success_rate_range"),
                        F.when(enough, F.col("lo")).alias("success_rate_min"), F.when(enough, F.col("hi")).alias("success_rate_max"),
                        label.alias("interpretation"))


def rank_modes(aggregates: DataFrame, mode: str) -> DataFrame:
    """Modes ranked by success, compute efficiency and turns. There are only as many rows as modes."""
    table = aggregates.withColumn("compute_efficiency", F.when(
        F.col("gpu_hours_total") > 0, F.col("success_pooled") / F.col("gpu_hours_total")))

    def place(column: str, best_high: bool) -> Column:
        order = F.col(column).desc_nulls_last() if best_high else F.col(column).asc_nulls_last()
        return F.when(F.col(column).isNotNull(), F.rank().over(Window.partitionBy(F.lit(1)).orderBy(order)))
    return table.select(mode, "success_pooled", "compute_efficiency", "turns_pooled",
                        place("success_pooled", True).alias("rank_success"),
                        place("compute_efficiency", True).alias("rank_efficiency"), place("turns_pooled", False).alias("rank_turns"))


def verdict(success: DataFrame, efficiency_ratio: Column) -> DataFrame:
    """A sentence per pair from the test result and the compute-efficiency ratio."""
    winner = F.when(F.col("difference") > 0, F.col("first")).otherwise(F.col("second"))
    first = F.when(F.col("significant"), F.concat(winner, F.lit(" has significantly higher success rate (p="),
                                                  F.format_number("p_value", 3), F.lit(")"))).otherwise("No significant difference in success rates")
    second = F.when(efficiency_ratio > 1.2, F.concat(F.col("first"), F.lit(" is "), F.format_number(efficiency_ratio, 1), F.lit("x more compute-efficient"))).when(
        efficiency_ratio < 0.833, F.concat(F.col("second"), F.lit(" is "), F.format_number(1 / efficiency_ratio, 1), F.lit("x more compute-efficient")))
    return success.withColumn("verdict", F.concat_ws("; ", first, second))


def gradient_stability(log: DataFrame, mode: str, line: str) -> DataFrame:
    """Gradient-norm statistics per mode from log lines; the lowest variation is the most stable."""
    value = F.regexp_extract(F.col(line), r"grad_norm[^:]*:\s*([^\s,]+)", 1).try_cast("double")
    named = F.col(line).contains("actor_grad_norm") | F.col(line).contains("policy_grad_norm")
    norms = log.filter(named).select(mode, value.alias("g")).filter(F.col("g").isNotNull())
    stats = norms.groupBy(mode).agg(F.avg("g").alias("mean"), F.stddev_pop("g").alias("std"), F.max("g").alias("max"),
                                    F.count("*").alias("n_samples"), (F.stddev_pop("g") / F.avg("g")).alias("cv"))
    out = stats.join(exact_quantiles(norms, [mode], "g", {"median": 0.5}), mode)
    best = stats.agg(F.min_by(mode, F.struct("cv", mode)).alias("_best"))
    return with_row(out, best).withColumn("most_stable", F.col(mode) == F.col("_best")).drop("_best")


def experiment_overview(runs: DataFrame) -> DataFrame:
    """One row: runs by status, hours, best complete method, findings."""
    done = F.col("status") == "complete"
    per = runs.filter(done).groupBy("method").agg((F.sum("successes") / F.sum("trials")).alias("rate"))
    best = per.agg(F.max_by("method", F.struct("rate", "method")).alias("best_method"), F.max("rate").alias("best_rate"))
    counts = runs.agg(F.count("*").alias("total_runs"), F.count_if(done).alias("complete_runs"),
                      F.count_if(F.col("status") == "failed").alias("failed_runs"),
                      F.count_if(F.col("status") == "incomplete-artifacts").alias("incomplete_runs"),
                      F.sum("gpu_hours").alias("total_gpu_hours"))
    findings = F.array_compact(F.array(
        F.when(F.col("best_method").isNotNull(), F.concat(F.lit("best method: "), F.col("best_method"))),
        F.when(F.col("failed_runs") > 0, F.concat(F.col("failed_runs").cast("string"), F.lit(" failed runs"))),
        F.when(F.col("complete_runs") < F.col("total_runs"), F.lit("matrix is incomplete"))))
    return with_row(counts, best).withColumn("key_findings", F.concat_ws("; ", findings))


def paired_deltas(rows: DataFrame, seed: str, packing: str, scores: list[str]) -> DataFrame:
    """Split minus packed per seed and score."""
    wide = rows.groupBy(seed).pivot(packing, ["packed", "split"]).agg(*[F.first(c).alias(c) for c in scores])
    if len(scores) == 1:
        wide = wide.withColumnRenamed("packed", f"packed_{scores[0]}").withColumnRenamed("split", f"split_{scores[0]}")
    return wide.select(seed, *[(F.col(f"split_{c}") - F.col(f"packed_{c}")).alias(f"{c}_delta") for c in scores])


def bias_report(deltas: DataFrame, column: str) -> DataFrame:
    d = F.col(column)
    return deltas.filter(d.isNotNull()).agg(
        F.avg(d).alias("mean_delta"), F.min(d).alias("min_delta"), F.max(d).alias("max_delta"),
        F.avg((d > 0).cast("double")).alias("positive_share"))


def pearson(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation and p per group; pairs with a missing side are dropped, fewer than two give null."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    stats = rows.filter(ok(x) & ok(y)).groupBy(*by).agg(
        F.count("*").alias("n"), F.when(F.count("*") >= 2, F.corr(F.col(x).cast("double"), F.col(y).cast("double"))).alias("r"))
    return stats.withColumn("p_value", I.pearson_p("r", "n"))


def correlation_table(map_score: DataFrame, task_accuracy: DataFrame, overall: DataFrame, gain: DataFrame,
                      sample: str = "sample") -> DataFrame:
    """Map score against accuracy per task, overall accuracy and final information gain.

    Each input has the sample and a ``value``; ``task_accuracy`` also names the ``task``.
    """
    long = (task_accuracy.select(sample, "task", "value")
            .unionByName(overall.select(sample, F.lit("avg_accuracy").alias("task"), "value"))
            .unionByName(gain.select(sample, F.lit("final_information_gain").alias("task"), "value")))
    scores = map_score.select(sample, F.col("value").alias("_score"))
    return pearson(long.join(scores, sample), ["task"], "_score", "value")
