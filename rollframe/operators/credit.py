"""Credit assignment: trajectory scores, advantages, loss weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollframe.distributed import affine_suffix, has_hot_key, null_safe, with_row
from rollframe.functions import tokens as T
from rollframe.operators.trajectories import KEY, TRAJECTORY, drop_copies, fail_on, sequence_issues, sequence_stats
from rollframe.session import stage

# Spread below which a group counts as constant, slack of the format gate.
MIN_STD = 1e-6
GATE_SLACK = 1e-6


def turn_rewards(turns: DataFrame, rewards: str = "token_level_rewards", mask: str = "response_mask") -> DataFrame:
    return turns.withColumn("turn_reward", T.masked_sum(rewards, mask))


def trajectory_scores(turns: DataFrame, mode: str = "outcome", reward: str = "turn_reward",
                      success: str = "success", process_cap: float = 0.2, success_bonus: float = 1.0,
                      format_threshold: float = 0.1, with_issues: bool = False) -> DataFrame:
    """One score per trajectory.

    ``outcome`` is success of any turn. ``bounded_process`` adds the process rewards clipped
    to the cap. ``format_gate`` is the outcome only if every process reward reaches the
    threshold. Process rewards leave out the success bonus of the last turn. With
    ``with_issues`` the same pass checks that turns run from 1 and end with one terminal.
    """
    if mode not in ("outcome", "bounded_process", "format_gate"):
        raise ValueError(f"unknown reward mode: {mode}")
    if process_cap < 0:
        raise ValueError("process_cap must not be negative")
    bonus = F.when(F.col("last_turn") & F.col("_win"), F.lit(success_bonus)).otherwise(F.lit(0.0))
    won = turns.withColumn("_win", F.coalesce(F.col(success), F.lit(False)))
    outcome = F.bool_or("_win").cast("double")
    # A trajectory is won if any of its turns is, so the bonus is settled after aggregation.
    agg = won.groupBy(*TRAJECTORY).agg(
        outcome.alias("_outcome"), F.sum(reward).alias("_sum"), F.count("*").alias("turns"),
        F.min(F.when(~F.col("last_turn"), F.col(reward))).alias("_min_inner"),
        F.min(F.when(F.col("last_turn"), F.col(reward))).alias("_last"), *(sequence_stats() if with_issues else []))
    earned = F.when(F.col("_outcome") == 1.0, F.lit(success_bonus)).otherwise(F.lit(0.0))
    if mode == "outcome":
        score = F.col("_outcome")
    elif mode == "bounded_process":
        score = F.col("_outcome") + F.greatest(F.lit(-process_cap), F.least(F.lit(process_cap), F.col("_sum") - earned))
    else:
        floor = F.lit(format_threshold - GATE_SLACK)
        passed = (F.coalesce("_min_inner", floor) >= floor) & (F.coalesce(F.col("_last") - earned, floor) >= floor)
        score = F.when(passed, F.col("_outcome")).otherwise(0.0)
    checked = [sequence_issues().alias("issues")] if with_issues else []
    return agg.select(*TRAJECTORY, "turns", score.alias("trajectory_score"), *checked)


def group_advantages(scores: DataFrame, group: str = "group_idx", score: str = "trajectory_score",
                     sample_std: bool = False, normalize: bool = True, eps: float = 0.0, min_std: float = MIN_STD) -> DataFrame:
    """Center each score by its group and divide by the group's spread.

    The group table is aggregated first and joined back, so a hot group is never one task.
    With ``sample_std`` this is the published group-relative form (a lone sample keeps its
    score, ``eps`` is added to the spread); else the population form with zero for groups whose
    spread is at most ``min_std``. Without ``normalize`` scores are centered and no more. A null
    group is a group.
    """
    spread = F.stddev_samp(score) if sample_std else F.stddev_pop(score)
    stats = scores.groupBy(group).agg(F.avg(score).alias("group_mean"), spread.alias("group_std"),
                                      F.count("*").alias("group_size"))
    centered = F.col(score) - F.col("group_mean")
    if sample_std:
        lone = F.col("group_size") == 1
        mean, std = F.when(lone, 0.0).otherwise(F.col("group_mean")), F.when(lone, 1.0).otherwise(F.col("group_std"))
        value = (F.col(score) - mean) / (std + eps) if normalize else F.col(score) - mean
    elif normalize:
        value = F.when(F.col("group_std") <= min_std, 0.0).otherwise(centered / F.col("group_std"))
    else:
        value = centered
    return null_safe(scores, stats, [group]).withColumn("advantage", value)


def whole_groups(scores: DataFrame, group: str = "group_idx", trajectory: str = "traj_idx", expected: int | None = None) -> DataFrame:
    """Scores of the groups that are whole: no trajectory has an issue, and ids run from 0.

    One broken or missing trajectory voids its group, as the others' baseline would be wrong.
    """
    stats = scores.groupBy(group).agg(
        F.max(F.size("issues")).alias("_issues"), F.count("*").alias("_n"), F.min(trajectory).alias("_low"), F.max(trajectory).alias("_high"))
    whole = (F.col("_issues") == 0) & (F.col("_low") == 0) & (F.col("_high") == F.col("_n") - 1)
    if expected is not None:
        whole = whole & (F.col("_n") == expected)
    return null_safe(scores, stats.filter(whole).select(group), [group])


def episode_advantages(turns: DataFrame, payload: list[str], mode: str = "outcome", strict: bool = False, **options) -> DataFrame:
    """Group-relative advantages from raw rollout rows: fold copies, check, score, void broken groups.

    With ``strict`` a broken trajectory fails the job instead of voiding its group.
    """
    unique = drop_copies(turns, payload)
    scores = trajectory_scores(unique, mode, with_issues=True, **options)
    # A row per trajectory, read by both group tables and what they are joined to: the turns are folded once.
    return group_advantages(whole_groups(stage(fail_on(scores) if strict else scores)))


def advantage_to_tokens(turns: DataFrame, advantages: DataFrame, mask: str = "response_mask") -> DataFrame:
    """Put the trajectory advantage on each valid token; an empty response is an error."""
    empty = F.when(T.mask_size(mask) == 0, F.raise_error(F.lit("turn has an empty response")).cast("boolean"))
    joined = null_safe(turns, advantages.select(*TRAJECTORY, "advantage"), TRAJECTORY)
    return joined.filter(empty.isNull()).withColumn("advantages", T.spread(F.col("advantage"), mask))


def loss_weights(turns: DataFrame, mode: str, tokens: str = "tokens") -> DataFrame:
    """Per-token loss weight so that each token, turn or trajectory counts the same."""
    if mode not in ("token", "turn", "trajectory"):
        raise ValueError(f"unknown weighting: {mode}")
    empty = F.when(F.col(tokens) <= 0, F.raise_error(F.lit("active turn has no tokens")).cast("boolean"))
    active = turns.filter(empty.isNull())
    if mode == "trajectory":
        per = active.groupBy(*TRAJECTORY).agg(F.sum(tokens).alias("_tokens"))
        total = per.agg(F.count("*").alias("_units"))
        sized = null_safe(active, per, TRAJECTORY)
    else:
        total = active.agg((F.sum(tokens) if mode == "token" else F.count("*")).alias("_units"))
        sized = active.withColumn("_tokens", F.lit(1) if mode == "token" else F.col(tokens))
    return with_row(sized, total).withColumn(
        "weight", F.lit(1.0) / (F.col("_units") * F.col("_tokens"))).drop("_units", "_tokens")


def weight_mass(weighted: DataFrame, *by: str, tokens: str = "tokens") -> DataFrame:
    return weighted.groupBy(*by).agg(F.sum(F.col("weight") * F.col(tokens)).alias("mass"))


def generalized_advantages(turns: DataFrame, reward: str, value: str, gamma: float = 1.0, lam: float = 1.0,
                           max_turns: int | None = None) -> DataFrame:
    """Turn-level generalized advantage estimates and returns.

    With ``b(t) = lam*r + (1-lam)*V + gamma*lam*b(t+1)`` the estimate is
    ``r - V + gamma*b(t+1)``, so one backward recurrence gives both without a look-ahead.
    """
    r, v = F.coalesce(reward, F.lit(0.0)).cast("double"), F.coalesce(value, F.lit(0.0)).cast("double")
    folded = affine_suffix(turns, TRAJECTORY, "turn_idx", F.lit(lam) * r + F.lit(1 - lam) * v, F.lit(gamma * lam), max_turns)
    advantage = r - v + F.lit(gamma) * F.col("after")
    return folded.withColumn("advantage", advantage).withColumn("turn_return", advantage + v).drop("suffix", "after")


def whiten(turns: DataFrame, advantage: str = "advantage", tokens: str = "tokens",
           eps: float = 1e-8, bessel: bool = True, shift_mean: bool = True) -> DataFrame:
    """Whiten a per-turn value as if it stood on each of the turn's tokens."""
    a, n = F.col(advantage), F.col(tokens)
    # Moments of the rows of each token count come from one pass, and are merged as Spark merges
    # those of tasks: squares of the values themselves would cancel.
    parts = turns.groupBy(n.alias("t")).agg(F.count("*").alias("rows"), F.count(a).alias("c"), F.avg(a).alias("m"), F.var_pop(a).alias("v"))
    sum_of = lambda value: F.aggregate("_parts", F.lit(0.0), lambda s, p: s + F.coalesce(value(p), F.lit(0.0)))
    gaps = parts.filter("t IS NOT NULL").agg(F.collect_list(F.struct("t", "rows", "c", "m", "v")).alias("_parts")).select(
        "_parts", sum_of(lambda p: p["t"] * p["rows"]).alias("_n")).filter("_n > 0")
    gaps = gaps.withColumn("_m", sum_of(lambda p: p["t"] * p["c"] * p["m"]) / F.col("_n"))
    gaps = gaps.select("_n", "_m", sum_of(lambda p: p["t"] * p["c"] * (p["v"] + (p["m"] - F.col("_m")) * (p["m"] - F.col("_m")))).alias("_q"))
    var = F.col("_q") / F.col("_n")
    if bessel:
        var = F.when(F.col("_n") > 1, F.col("_q") / (F.col("_n") - 1)).otherwise(var)
    white = (a - F.col("_m")) / F.sqrt(var + F.lit(eps))
    return with_row(turns, gaps).withColumn(
        "whitened", white if shift_mean else white + F.col("_m")).drop("_n", "_m", "_q")


def back_to_copies(all_rows: DataFrame, unique: DataFrame, columns: list[str]) -> DataFrame:
    """Give every padded copy the results computed on the row it copies."""
    return null_safe(all_rows, unique.select(*KEY, *columns), KEY)


def advantages_of_copies(all_rows: DataFrame, payload: list[str], carry: list[str], reward: str, value: str,
                         gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Key, ``carry``, ``advantage`` and ``turn_return`` of every row, padded copies among them.

    Where no trajectory is hot the rows move once: a trajectory's rows come together, copies are
    folded with what is to be carried, and the recurrence runs where they are. Else copies are
    folded before the shuffle and get the results back by a join.
    """
    if has_hot_key(all_rows, TRAJECTORY):
        unique = drop_copies(all_rows, payload)
        done = generalized_advantages(unique.select(*KEY, reward, value), reward, value, gamma, lam)
        return back_to_copies(all_rows.select(*KEY, *carry), done, ["advantage", "turn_return"])
    low, high = all_rows.agg(F.min("turn_idx"), F.max("turn_idx")).first()
    dealt = all_rows.select(*dict.fromkeys([*KEY, *payload, reward, value, *carry])).repartition(*TRAJECTORY)
    unique = drop_copies(dealt, payload, more={"_carry_all": F.collect_list(F.struct(*[F.col(c) for c in carry]))})
    done = generalized_advantages(unique.select(*KEY, reward, value, "_carry_all"), reward, value, gamma, lam,
                                  high if (low or 0) >= 0 and high is not None else None)
    return done.select(*KEY, F.explode("_carry_all").alias("_c"), "advantage", "turn_return").select(
        *KEY, *[F.col(f"_c.{c}").alias(c) for c in carry], "advantage", "turn_return")


def advantage_diagnostics(turns: DataFrame, scores: DataFrame, dropped_groups: Column | int = 0) -> DataFrame:
    """One row of counts: rows, copies, trajectories, groups, constant groups."""
    rows = turns.groupBy(*KEY).agg(F.count("*").alias("c")).agg(
        F.sum("c").alias("rows"), (F.sum("c") - F.count("*")).alias("duplicates"))
    groups = scores.groupBy("group_idx").agg(
        F.count("*").alias("n"), (F.stddev_pop("trajectory_score") <= MIN_STD).alias("flat"))
    counts = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("trajectories"),
                        F.count_if("flat").alias("zero_variance_groups"))
    dropped = dropped_groups if isinstance(dropped_groups, Column) else F.lit(dropped_groups).cast("long")
    return with_row(rows, counts).withColumn("dropped_groups", dropped)
