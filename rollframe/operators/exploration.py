"""Exploration logs: coverage, cost, information gain, curves, task accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollframe.distributed import SLICE, ordered, running

# The actions that are counted, and those that cost something.
ACTIONS = ["move", "rotate", "return", "observe", "term", "forced_term"]
ACTION_COSTS = {"observe": 1}
# Tasks (short and class names) left out of a sample's overall accuracy.
EXCLUDED_TASKS = ["rot_dual", "bwd_pov_vision", "bwd_nav_vision", "bwd_loc_vision", "RotDualEvaluationTask",
                  "BackwardPovVisionEvaluationTask", "View2ActionVisionEvaluationTask", "View2LocationVisionEvaluationTask",
                  "Location2ActionVisionEvaluationTask"]


def action_cost(counts: Column) -> Column:
    """Cost of an action-count map."""
    cost = F.lit(0).cast("long")
    for action, c in ACTION_COSTS.items():
        cost = cost + F.coalesce(F.try_element_at(counts, F.lit(action)), F.lit(0)) * c
    return cost


def sample_exploration(logs: DataFrame, sample: str = "sample", turn: str = "turn") -> DataFrame:
    """Per sample: values of the last exploration turn, final gain, failure and validity shares.

    Gains stay in the long table; their order is the turn. Shares count all turns.
    """
    phase = F.col("is_exploration_phase")
    last = lambda c: F.max_by(c, F.when(phase, F.col(turn)))
    gain = F.when(phase & F.col("information_gain").isNotNull(), F.col(turn))
    out = logs.groupBy(sample).agg(
        last("node_coverage").alias("last_node_coverage"), last("edge_coverage").alias("last_edge_coverage"),
        last("step").alias("n_exploration_steps"), last("action_counts").alias("_counts"), F.bool_or(phase).alias("_any"),
        F.max_by("information_gain", gain).alias("final_information_gain"),
        F.avg((phase & F.coalesce("is_action_fail", F.lit(False))).cast("double")).alias("action_fail_ratio"),
        F.avg(F.coalesce("is_valid_action", F.lit(True)).cast("double")).alias("valid_action_ratio"))
    empty = F.create_map().cast("map<string,int>")
    counts = F.when(F.col("_any"), F.coalesce("_counts", empty))
    return out.withColumn("_counts", counts).select(
        sample, "last_node_coverage", "last_edge_coverage", "n_exploration_steps", action_cost(F.col("_counts")).alias("action_cost"),
        "final_information_gain", "action_fail_ratio", "valid_action_ratio",
        F.map_from_entries(F.when(F.col("_any"), F.array(*[
            F.struct(F.lit(a), F.coalesce(F.try_element_at(F.col("_counts"), F.lit(a)), F.lit(0)).cast("int")) for a in ACTIONS]))).alias("action_counts"))


def group_exploration(samples: DataFrame, *by: str) -> DataFrame:
    """Means over samples; a sample without a value does not count for it."""
    cols = {"last_node_coverage": "avg_node_coverage", "last_edge_coverage": "avg_edge_coverage", "n_exploration_steps": "avg_exploration_steps",
            "action_cost": "avg_action_cost", "action_fail_ratio": "avg_action_fail_ratio", "valid_action_ratio": "avg_valid_action_ratio",
            "final_information_gain": "avg_final_information_gain"}
    return samples.groupBy(*by).agg(*[F.avg(c).alias(n) for c, n in cols.items()],
                                    *[F.avg(F.col("action_counts")[a]).alias(f"avg_{a}") for a in ACTIONS])


def curve_carry_forward(values: DataFrame, sample: str, position: str, value: str) -> DataFrame:
    """Mean per position, where a finished sample keeps counting with its last value.

    Instead of stretching every list to the longest one, the last values of the lists that
    ended are added up over positions.
    """
    ends = values.groupBy(sample).agg((F.max(position) + 1).alias("_p"), F.max_by(value, position).alias("_last"))
    ended = ends.groupBy("_p").agg(F.sum("_last").alias("_es"), F.count("_last").alias("_en"))
    here = values.groupBy(F.col(position).alias("_p")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    both = here.join(ended, "_p", "full_outer").na.fill(0)
    total = running(ordered(both, [], ["_p"]), [], ["_p"], {"_cs": F.col("_es"), "_cn": F.col("_en")}).drop(SLICE)
    # The last position of the longest list is the last with values of its own.
    live = total.filter("_n > 0 OR _s <> 0").select(
        F.col("_p").alias(position), ((F.col("_s") + F.col("_cs")) / F.nullif(F.col("_n") + F.col("_cn"), F.lit(0))).alias("mean"))
    return live


def curve_skip_missing(values: DataFrame, position: str, value: str, *by: str) -> DataFrame:
    """Mean per position over the samples that have a value there; null if none has."""
    return values.groupBy(*by, position).agg(F.avg(value).alias("mean"))


def exploration_summary(logs: DataFrame, sample: str = "sample", turn: str = "turn") -> DataFrame:
    gain = F.coalesce("information_gain", F.lit(0.0))
    rows = logs.filter("is_exploration_phase")
    return rows.groupBy(sample).agg(
        F.max_by("node_coverage", turn).alias("node_coverage"), F.max_by("edge_coverage", turn).alias("edge_coverage"),
        F.count("*").alias("n_exploration_steps"), action_cost(F.max_by("action_counts", turn)).alias("exploration_cost"),
        F.sum(gain).alias("acc_info_gain"), F.avg(gain).alias("avg_info_gain"))


def exploration_quality(counts: DataFrame, cells: str, count: str, name: str, *by: str) -> DataFrame:
    """``sum log2(M/C) / (N log2 M)`` over the objects except the start marker; 0 for a one-cell grid."""
    m = F.col(cells).cast("double")
    left = F.log2(m / F.greatest(F.col(count).cast("double"), F.lit(1.0)))
    return counts.filter(F.col(name) != "initial_pos").groupBy(*by).agg(F.coalesce(
        F.sum(left) / F.nullif(F.count("*") * F.log2(F.max(m)), F.lit(0.0)), F.lit(0.0)).alias("quality"))


def sample_accuracy(answers: DataFrame, sample: str = "sample", task: str = "task", score: str = "score") -> DataFrame:
    """Per sample and task, and over the sample without the excluded tasks (task = ``overall``)."""
    s = F.coalesce(score, F.lit(0.0))
    per = answers.groupBy(sample, task).agg(F.count("*").alias("n_total"), F.sum(s).alias("task_score"))
    counted = ~F.col(task).isin(EXCLUDED_TASKS)
    overall = per.groupBy(sample).agg(F.coalesce(F.sum(F.when(counted, F.col("n_total"))), F.lit(0)).alias("n_total"),
                                      F.coalesce(F.sum(F.when(counted, F.col("task_score"))), F.lit(0.0)).alias("task_score"))
    both = per.unionByName(overall.withColumn(task, F.lit("overall")))
    return both.withColumn("avg_accuracy", F.col("task_score") / F.nullif(F.col("n_total"), F.lit(0)))


def group_accuracy(answers: DataFrame, task: str = "task", score: str = "score") -> DataFrame:
    """Per task and overall, each question weighing the same; the overall leaves excluded tasks out."""
    s = F.coalesce(score, F.lit(0.0))
    per = answers.groupBy(task).agg(F.count("*").alias("total_count"), F.sum(s).alias("task_score"))
    counted = per.filter(~F.col(task).isin(EXCLUDED_TASKS)).agg(F.coalesce(F.sum("total_count"), F.lit(0)).alias("total_count"),
                                                                F.coalesce(F.sum("task_score"), F.lit(0.0)).alias("task_score"))
    both = per.unionByName(counted.withColumn(task, F.lit("overall")))
    return both.withColumn("accuracy", F.coalesce(F.col("task_score") / F.nullif(F.col("total_count"), F.lit(0)), F.lit(0.0)))
