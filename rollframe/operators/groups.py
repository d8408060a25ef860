"""Group reward variance: metrics, filters, and the state-relative preflight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollframe.distributed import SLICE, exact_quantiles, ordered, running, with_row
from rollframe.operators.trajectories import issues, return_to_go
from rollframe.session import stage

# Default limits of the state-relative preflight.
PREFLIGHT_LIMITS = {
    "min_rows": 64,
    "max_missing_anchor_fraction": 0.01,
    "min_comparable_row_fraction": 0.20,
    "min_action_diversity_fraction": 0.10,
    "min_mean_return_to_go_variance": 1e-4,
}


def group_variance(rows: DataFrame, group: str = "group_idx", reward: str = "reward", ddof: int = 0,
                   first_seen: str | None = None) -> DataFrame:
    """Reward variance of each group; a single sample counts as 0."""
    var = F.var_samp(reward) if ddof else F.var_pop(reward)
    extra = [F.min(first_seen).alias("first_seen")] if first_seen else []
    return rows.groupBy(group).agg(F.coalesce(var, F.lit(0.0)).alias("variance"), F.count("*").alias("samples"), *extra)


def mean_group_variance(rows: DataFrame, group: str = "group_idx", reward: str = "reward", ddof: int = 0) -> DataFrame:
    return group_variance(rows, group, reward, ddof).agg(
        F.coalesce(F.avg("variance"), F.lit(0.0)).alias("reward_variance"))


def _ranked(variances: DataFrame, group: str) -> DataFrame:
    """Groups by falling variance (ties by group), with rank and running variance mass."""
    tie = "first_seen" if "first_seen" in variances.columns else group
    # Rounding makes the order independent of the order of additions.
    keyed = variances.withColumn("_down", -F.round("variance", 12))
    order = ["_down", tie, group] if tie != group else ["_down", group]
    spread = ordered(keyed, [], order)
    return running(spread, [], order, {"rank": F.lit(1), "mass": F.col("variance")}).drop("_down", SLICE)


def top_k_groups(variances: DataFrame, share: float = 0.2, group: str = "group_idx") -> DataFrame:
    """The ``max(1, ceil(groups * share))`` groups of highest variance."""
    ranked = stage(_ranked(variances, group))
    total = ranked.agg(F.count("*").alias("_n"))
    keep = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(share)))
    return with_row(ranked, total).filter(F.col("rank") <= keep).drop("_n")


def top_p_groups(variances: DataFrame, share: float = 0.9, group: str = "group_idx") -> DataFrame:
    """Groups by falling variance while the mass before them is below ``share`` of the total.

    With zero total variance every group stays; the first group always does.
    """
    ranked = stage(_ranked(variances, group))
    total = ranked.agg(F.sum("variance").alias("total_variance"), F.count("*").alias("total_groups"))
    before = F.col("mass") - F.col("variance")
    limit = F.lit(share) * F.col("total_variance")
    keep = (F.col("total_variance") <= 0) | (F.col("rank") == 1) | (before < limit - F.lit(1e-12))
    return with_row(ranked, total).filter(keep)


def filter_rows(rows: DataFrame, kept: DataFrame, group: str = "group_idx") -> DataFrame:
    """Rows of the kept groups. Spark decides by measured size whether to broadcast them."""
    return rows.join(kept.select(group), group, "left_semi")


def filter_report(variances: DataFrame, kept: DataFrame) -> DataFrame:
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(F.avg("variance").alias(f"mean_{tag}"), F.min("variance").alias(f"min_{tag}"),
                      F.max("variance").alias(f"max_{tag}"), F.count("*").alias(f"groups_{tag}"),
                      F.sum("samples").alias(f"rows_{tag}"), F.sum("variance").alias(f"_mass_{tag}"))
    both = with_row(side(variances, "before"), side(kept, "after"))
    return both.withColumn("mass_ratio", F.when(F.col("_mass_before") > 0, F.col("_mass_after") / F.col("_mass_before"))
                           ).withColumn("loss_scale", F.sqrt(F.col("groups_after") / F.col("groups_before"))
                                        ).drop("_mass_before", "_mass_after")


def comparable_variance(trajectories: DataFrame) -> DataFrame:
    """Variance over groups of two or more trajectories, and the share that is exactly flat."""
    var = group_variance(trajectories).filter("samples >= 2")
    spread = trajectories.groupBy("group_idx").agg((F.max("reward") == F.min("reward")).alias("flat"))
    return var.join(spread, "group_idx").agg(
        F.avg("variance").alias("mean_group_reward_variance"),
        F.avg(F.col("flat").cast("int")).alias("zero_variance_group_fraction"))


def state_groups(unique_turns: DataFrame, action: str = "action") -> DataFrame:
    """Per (group, anchor): rows, distinct actions, return-to-go variance."""
    slim = unique_turns.select("group_idx", "traj_idx", "turn_idx", "score", "state_anchor", action)
    rtg = return_to_go(slim)
    return rtg.filter(F.coalesce(F.length("state_anchor"), F.lit(0)) > 0).groupBy("group_idx", "state_anchor").agg(
        F.count("*").alias("rows"), F.countDistinct(action).alias("actions"),
        F.var_pop("return_to_go").alias("rtg_variance"))


def preflight(unique_turns: DataFrame, action: str = "action", limits: dict[str, float] | None = None) -> DataFrame:
    """One row: can a state-relative advantage be told apart at all, and which checks fail."""
    lim = {**PREFLIGHT_LIMITS, **(limits or {})}
    # Read by the totals and by every pass of the quantiles: worked out once.
    groups = stage(state_groups(unique_turns, action))
    totals = unique_turns.agg(
        F.count("*").alias("rows"),
        F.count_if(F.coalesce(F.length("state_anchor"), F.lit(0)) == 0).alias("missing_anchors"))
    many = F.col("rows") >= 2
    stats = groups.agg(
        F.count("*").alias("state_groups"), F.count_if(~many).alias("singletons"),
        F.count_if(many).alias("comparable_groups"), F.sum(F.when(many, F.col("rows")).otherwise(0)).alias("comparable_rows"),
        F.count_if(many & (F.col("actions") >= 2)).alias("diverse_groups"),
        F.avg(F.when(many, F.col("rtg_variance"))).alias("mean_rtg_variance"), F.max("rows").alias("max_group_rows"))
    sizes = exact_quantiles(groups, [], "rows", {"group_rows_p50": 0.5, "group_rows_p95": 0.95})
    one = with_row(with_row(totals, stats), sizes)

    def ratio(a: str, b: str):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    one = one.select(
        "*", F.when(F.col("rows") > 0, F.col("missing_anchors") / F.col("rows")).otherwise(1.0)
        .alias("missing_anchor_fraction"),
        F.when(F.col("state_groups") > 0, F.col("singletons") / F.col("state_groups")).otherwise(1.0)
        .alias("singleton_fraction"),
        F.when(F.col("rows") > F.col("missing_anchors"), F.col("comparable_rows")
               / (F.col("rows") - F.col("missing_anchors"))).otherwise(0.0).alias("comparable_row_fraction"),
        ratio("diverse_groups", "comparable_groups").alias("action_diversity_fraction"),
        F.coalesce("mean_rtg_variance", F.lit(0.0)).alias("mean_return_to_go_variance")).drop("mean_rtg_variance")
    failed = issues(
        (F.col("rows") < lim["min_rows"], "enough_rows"),
        (F.col("missing_anchor_fraction") > lim["max_missing_anchor_fraction"], "anchors_present"),
        (F.col("comparable_row_fraction") < lim["min_comparable_row_fraction"], "enough_comparable_rows"),
        (F.col("action_diversity_fraction") < lim["min_action_diversity_fraction"], "actions_vary"),
        (F.col("mean_return_to_go_variance") < lim["min_mean_return_to_go_variance"], "returns_vary"))
    return one.withColumn("failed_checks", failed).withColumn(
        "decision", F.when(F.size("failed_checks") == 0, "proceed").otherwise("stop"))
