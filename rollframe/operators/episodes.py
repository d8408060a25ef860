"""Evaluation episodes: summaries, templates, failures, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rollframe.distributed import ordered, previous, running, with_row
from rollframe.functions import inference as I
from rollframe.functions import text as X
from rollframe.operators.groups import comparable_variance
from rollframe.operators.trajectories import drop_copies, trajectory_records
from rollframe.session import stage

# Finish reasons.
NORMAL_FINISH = ["done", "max_turns"]
INFRASTRUCTURE = ["model_error", "env_error", "error"]
# Ways of hiding the picture from the agent.
ABLATIONS = ["none", "remove", "shuffle_tiles"]


def episode_success(infos: Column, rewards: Column, terminated: Column, threshold: float = 0.0) -> Column:
    """First success key of the last info, else terminated with a final reward above the threshold."""
    last = F.try_element_at(infos, F.lit(-1))
    stated = F.coalesce(last["success"], last["is_success"], last["solved"], F.lit(False))
    return F.coalesce(stated, F.lit(False)) | F.coalesce(terminated & (F.try_element_at(rewards, F.lit(-1)) > threshold), F.lit(False))


def repaired_finish(finish: Column, terminated: Column, success: Column) -> Column:
    return F.coalesce(F.nullif(finish, F.lit("")), F.when(terminated & success, "done"))


def must_rerun(finish: Column) -> Column:
    """Rows to purge before a rerun; missing metrics count."""
    return finish.isNull() | ~finish.isin(NORMAL_FINISH)


def infrastructure_failure(error: Column, finish: Column) -> Column:
    return (F.coalesce(error, F.lit("")) != "") | must_rerun(finish)


def checked_ablation(ablation: Column) -> Column:
    value = F.coalesce(ablation, F.lit("none"))
    return F.when(value.isin(ABLATIONS), value).otherwise(
        F.raise_error(F.concat(F.lit("unknown observation ablation: "), value)).cast("string"))


def _correlation(x: str, y: str) -> list[Column]:
    enough = (F.count("*") >= 2) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return [F.when(enough, F.corr(x, y)).alias("reward_turn_correlation"),
            F.when(enough, F.regr_slope(y, x)).alias("reward_per_extra_turn_slope")]


def summarize(episodes: DataFrame, *by: str) -> DataFrame:
    """Success, turns, reward, invalid actions and the reward-turn relation."""
    won = F.col("success")
    checks = F.sum("action_check_count")
    return episodes.groupBy(*by).agg(
        F.count("*").alias("episodes"), F.avg(won.cast("double")).alias("success_rate"),
        F.avg("num_turns").alias("mean_turns"), F.avg(F.when(won, F.col("num_turns"))).alias("mean_turns_successful"),
        F.avg("cumulative_reward").alias("mean_cumulative_reward"),
        F.when(checks > 0, 1 - F.sum("valid_action_count") / checks).alias("invalid_action_fraction"),
        checks.alias("action_checks"), *_correlation("num_turns", "cumulative_reward"))


def summarize_with_total(episodes: DataFrame, by: str) -> DataFrame:
    """Per value of ``by`` and over all, in one pass (``all`` marks the total)."""
    won = F.col("success")
    out = episodes.rollup(by).agg(
        F.grouping(by).alias("_total"), F.count("*").alias("episodes"), F.avg(won.cast("double")).alias("success_rate"),
        F.avg(F.when(won, F.col("num_turns"))).alias("mean_turns_successful"))
    return out.withColumn(by, F.when(F.col("_total") == 1, "all").otherwise(F.col(by))).drop("_total")


def tag_summary(episodes: DataFrame, tag: str) -> DataFrame:
    """Per tag and in total: counts, means and the number of rollouts that ended abnormally."""
    bad = ~F.coalesce(F.col("finish_reason").isin([*NORMAL_FINISH, "skipped_resume"]), F.lit(False))
    out = episodes.rollup(tag).agg(
        F.grouping(tag).alias("_total"), F.count("*").alias("n_episodes"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("cumulative_reward").alias("avg_cumulative_reward"), F.avg("num_turns").alias("avg_turns"),
        F.count_if(bad).alias("error_rollouts"))
    return out.withColumn(tag, F.when(F.col("_total") == 1, "all").otherwise(F.col(tag))).drop("_total")


def error_rollouts(episodes: DataFrame, tag: str) -> DataFrame:
    """The abnormal rollouts themselves, one row each: such a list has no size bound."""
    bad = ~F.coalesce(F.col("finish_reason").isin([*NORMAL_FINISH, "skipped_resume"]), F.lit(False))
    return episodes.filter(bad).select(tag, "rollout_id", "finish_reason").distinct()


def template_concentration(texts: DataFrame, template: Column, *by: str) -> DataFrame:
    """Share of the most common template and share of distinct templates; empties are left out."""
    counts = texts.select(*by, template.alias("_t")).filter(F.length("_t") > 0).groupBy(*by, "_t").agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg((F.max("_n") / F.sum("_n")).alias("concentration"),
                                   (F.count("*") / F.sum("_n")).alias("unique_fraction"))


def training_summary(rows: DataFrame) -> DataFrame:
    """The training report, one row: unique rows make the trajectories, all rows count for
    templates and validity.

    Copies are dropped and trajectories built once; the trajectory table, far smaller than
    the rows, is staged because several figures are taken from it.
    """
    valid = F.col("action_is_valid").cast("double")
    unique = drop_copies(rows, ["score", "output", "last_turn", "traj_success"], more={"valid": F.sum(valid), "checked": F.count(valid)})
    built = trajectory_records(unique, None, F.sum("copies").alias("all_rows"), F.count("*").alias("own_rows"), F.sum("valid").alias("valid"), F.sum("checked").alias("checked"))
    # Rounding keeps equal sums equal in every order of additions.
    records = stage(built.withColumn("reward", F.round("reward", 6)))
    won = F.col("success")
    total = records.agg(
        F.sum("all_rows").alias("rows"), F.sum("own_rows").alias("unique_rows"), (F.sum("all_rows") - F.sum("own_rows")).alias("padding_duplicates"),
        F.count("*").alias("trajectories"), F.countDistinct("group_idx").alias("groups"), F.avg(won.cast("double")).alias("success_rate"),
        F.avg(F.when(won, F.col("turns"))).alias("mean_turns_successful"), (1 - F.sum("valid") / F.nullif(F.sum("checked"), F.lit(0))).alias("invalid_action_fraction"),
        *_correlation("turns", "reward"))
    for part in (comparable_variance(records), template_concentration(rows, X.answer_template(F.col("output")))):
        total = with_row(total, part)
    return total


def representative_failures(episodes: DataFrame, limit: int = 10, semantic_first: bool = False) -> DataFrame:
    """Failed episodes for review: infrastructure errors first, then turns and reward falling."""
    infra = F.coalesce(F.col("finish_reason").isin(INFRASTRUCTURE), F.lit(False))
    return episodes.filter(~F.col("success")).orderBy(
        infra.asc() if semantic_first else infra.desc(), F.col("num_turns").desc(),
        F.round("cumulative_reward", 9).desc(), "rollout_id").limit(limit)


def learning_curve(trajectories: DataFrame) -> DataFrame:
    won = F.col("success")
    return trajectories.groupBy("run", "step").agg(
        F.avg(won.cast("double")).alias("success_rate"), F.avg(F.when(won, F.col("turns"))).alias("mean_turns_successful"),
        F.avg("reward").alias("mean_reward"))


def reward_histogram(rows: DataFrame, by: str, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between each run's extremes; a constant run is one unit wide."""
    ends = rows.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    ends = ends.select(by, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                       F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    place = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    return rows.join(ends, by).groupBy(by, F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def validation_metrics(samples: DataFrame, source: str, prompt: str, variables: list[str]) -> DataFrame:
    """mean, best and majority at N per data source, named by importance.

    The mean is over all samples of a prompt, N of them. Best and majority are taken at N and
    at every power of two below it: there they are the expected best and the expected winner of
    a vote among as many samples drawn without repetition, over all subsets and without
    resampling. The core variable is ``acc`` if present, else ``reward``; its metrics at the
    largest N are the core ones. A tied vote goes to the larger value. Samples are counted by
    value first; what is worked on per prompt is its table of votes.
    """
    core = "acc" if "acc" in variables else "reward"
    long = samples.select(source, prompt, F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables])).alias("z")).select(
            source, prompt, "z.*").filter("x IS NOT NULL")
    keys = [source, prompt, "variable"]
    votes = long.groupBy(*keys, "x").agg(F.count("*").alias("n"))
    # Read by the distinct tables and by what they are joined to: folded once.
    per = stage(votes.groupBy(*keys).agg(F.sum("n").alias("N"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"),
                                   F.sort_array(F.collect_list(F.struct("x", "n"))).alias("votes")))
    # Equal tables of votes, most of them for a yes-or-no variable, are worked out once.
    tables = per.select("votes").distinct().withColumn("drawn", I.drawn_metrics("votes"))
    drawn = per.join(tables, "votes").select(source, "variable", "N", "mean", F.explode("drawn").alias("d"))
    at_n = stage(drawn.groupBy(source, "variable", F.col("d.size").cast("long").alias("size")).agg(
        F.avg(F.when(F.col("d.size") == F.col("N"), F.col("mean"))).alias("mean"), F.avg("d.best").alias("best"), F.avg("d.maj").alias("maj")))
    top = at_n.groupBy(source, "variable").agg(F.max("size").alias("_top"))
    section = F.when((F.col("variable") == core) & (F.col("size") == F.col("_top")), "val-core").otherwise("val-aux")
    return at_n.join(top, [source, "variable"]).select(section.alias("_s"), source, "variable", "size", F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.col(m).alias("metric_value")) for m in ("mean", "best", "maj")])).alias("z")).filter(
            "z.metric_value IS NOT NULL").select(F.concat_ws("/", "_s", source, "variable", F.concat("z.m", F.lit("@"), "size")).alias("metric"), "z.metric_value")


def sample_for_logging(rows: DataFrame, text: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable draw of ``n`` rows."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(text))), text).limit(n)


def failure_class() -> Column:
    """The first rule that fits."""
    finish, turns, reward = F.coalesce("finish_reason", F.lit("unknown")), F.col("num_turns"), F.col("cumulative_reward")
    checks, valid = F.col("action_check_count"), F.col("valid_action_count")
    invalid = F.coalesce((checks > 0) & (valid < checks), F.lit(False))
    timeout = finish == "max_turns"
    return (F.when(F.coalesce("success", F.lit(False)), "success")
            .when(finish.isin(INFRASTRUCTURE), "infrastructure_error")
            .when(invalid & (valid == 0), "all_actions_invalid").when(invalid, "frequent_invalid_actions")
            .when(timeout & (reward > 0.5), "timeout_with_high_progress")
            .when(timeout & (reward >= 0.1), "timeout_with_partial_progress").when(timeout, "timeout_with_no_progress")
            .when(turns < 3, "early_termination").when((turns > 10) & (reward < 0.1), "stalled_no_progress")
            .otherwise("other_failure"))


def failure_counts(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy(failure_class().alias("category")).agg(F.count("*").alias("episodes"))


def failure_patterns(episodes: DataFrame) -> DataFrame:
    """One row: totals, rates and the most common class (ties by class name)."""
    counts = failure_counts(episodes)
    failed, infra = F.col("category") != "success", F.col("category") == "infrastructure_error"
    n = F.col("episodes")
    out = counts.agg(
        F.sum("episodes").alias("total_episodes"), F.sum(F.when(failed, n).otherwise(0)).alias("total_failures"),
        F.sum(F.when(infra, n).otherwise(0)).alias("_infra"),
        F.min_by(F.when(failed, F.col("category")), F.when(failed, F.struct(-n, F.col("category")))).alias("most_common_failure"))
    total = F.col("total_episodes")
    return out.select("total_episodes", "total_failures", (F.col("total_failures") / total).alias("failure_rate"),
                      (F.col("_infra") / total).alias("infrastructure_error_rate"),
                      ((F.col("total_failures") - F.col("_infra")) / total).alias("actionable_failure_rate"),
                      "most_common_failure")


def failure_details(episodes: DataFrame) -> DataFrame:
    """The failed episodes with their class, one row each."""
    return episodes.withColumn("category", failure_class()).filter("category <> 'success'").select(
        "category", "rollout_id", "seed", "num_turns", "cumulative_reward", "finish_reason")


def error_lines(transcripts: DataFrame, text: str, source: str, words: list[str] = X.ERROR_WORDS) -> DataFrame:
    """One row per error line: its folded pattern and where it came from."""
    lines = transcripts.select(F.col(source).alias("source"), F.explode(F.split(F.lower(F.col(text)), "\n")).alias("line"))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col("line").contains(w)
    return lines.filter(hit).select("source", X.error_pattern(F.col("line")).alias("pattern")).filter("pattern <> ''")


def top_error_patterns(lines: DataFrame, limit: int = 10, examples: int = 3) -> DataFrame:
    """The most frequent patterns with a few sources each."""
    per = lines.groupBy("pattern", "source").agg(F.count("*").alias("n"))
    top = per.groupBy("pattern").agg(F.sum("n").alias("lines")).orderBy(F.col("lines").desc(), "pattern").limit(limit)
    # ``top`` has at most ``limit`` rows; only the first sources of each pattern reach the list.
    near = per.join(F.broadcast(top), "pattern")
    first = near.withColumn("_r", F.row_number().over(Window.partitionBy("pattern").orderBy("source"))).filter(F.col("_r") <= examples)
    return first.groupBy("pattern", "lines").agg(F.array_sort(F.collect_list("source")).alias("examples"))


def longest_runs(texts: DataFrame, episode: str, position: str, action: Column) -> DataFrame:
    """Per episode: the longest run of one action (the first of equal ones) and the text count."""
    order = [position]
    named = texts.select(episode, position, action.alias("action"))
    spread = previous(ordered(named, [episode], order), [episode], order, {"_prev": "action"})
    change = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("action")), 1).otherwise(0)
    islands = running(spread.withColumn("_new", change), [episode], order, {"_island": F.col("_new")})
    runs = islands.groupBy(episode, "_island").agg(F.count("*").alias("n"), F.any_value("action").alias("action"))
    return runs.groupBy(episode).agg(
        F.max("n").alias("max_repetition"), F.max_by("action", F.struct("n", -F.col("_island"))).alias("repeated_action"),
        F.sum("n").alias("texts"))


def repetition_loops(runs: DataFrame, threshold: int = 5) -> DataFrame:
    """Episodes whose longest run reaches the threshold."""
    return runs.filter((F.col("texts") >= threshold) & (F.col("max_repetition") >= threshold))


def loop_summary(episodes: DataFrame, loops: DataFrame) -> DataFrame:
    totals = with_row(episodes.agg(F.count("*").alias("total_episodes")), loops.agg(F.count("*").alias("episodes_with_loops")))
    return totals.withColumn("loop_rate", F.when(
        F.col("total_episodes") > 0, F.col("episodes_with_loops") / F.col("total_episodes")).otherwise(0.0))
