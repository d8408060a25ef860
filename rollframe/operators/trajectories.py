"""Trajectory identity: copies, ids, reconstruction and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollframe.distributed import affine_suffix, in_order, null_safe, row_numbers

KEY = ["group_idx", "traj_idx", "turn_idx"]
TRAJECTORY = ["group_idx", "traj_idx"]


def issues(*rules: tuple[Column, str | Column]) -> Column:
    """The messages of the rules that are broken, as an array."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(False)), F.lit(text) if isinstance(text, str) else text)
        for broken, text in rules]))


def fail_on(df: DataFrame, issue_column: str = "issues") -> DataFrame:
    """Strict mode: the first row that carries an issue stops the job with its messages."""
    checked = F.when(F.size(issue_column) > 0, F.raise_error(F.concat_ws("; ", issue_column)).cast("boolean"))
    return df.filter(checked.isNull())


def drop_padding(rows: DataFrame, sentinel: str = "_is_padding") -> DataFrame:
    """Rows that are not padding; a missing sentinel is an error."""
    missing = F.raise_error(F.lit("padding sentinel is missing")).cast("boolean")
    return rows.filter(F.when(F.col(sentinel).isNull(), missing).otherwise(~F.col(sentinel)))


def copy_report(turns: DataFrame, payload: list[str], key: list[str] = KEY) -> DataFrame:
    """Per key: how many copies there are and whether they agree on ``payload``."""
    digest = F.xxhash64(*payload, *[F.col(c).isNull() for c in payload])
    return (turns.withColumn("_h", digest).groupBy(*key)
            .agg(F.count("*").alias("copies"), (F.min("_h") != F.max("_h")).alias("conflict")))


def drop_copies(turns: DataFrame, payload: list[str], key: list[str] = KEY, strict: bool = True, more: dict[str, Column] | None = None) -> DataFrame:
    """One row per key. Copies are folded before the shuffle, so a hot key costs one row per task.
    ``more`` are aggregates over all copies.

    With ``strict`` a key whose copies disagree on ``payload`` fails the job. Columns are
    taken one by one, so those that nobody uses later are not even read.
    """
    rest, more = [c for c in turns.columns if c not in key], more or {}
    digest = F.xxhash64(*payload, *[F.col(c).isNull() for c in payload])
    kept = turns.withColumn("_h", digest).groupBy(*key).agg(
        *[F.first(c).alias(c) for c in rest], F.count("*").alias("copies"),
        F.min("_h").alias("_lo"), F.max("_h").alias("_hi"), *[a.alias(n) for n, a in more.items()])
    if strict:
        kept = kept.filter(F.when(F.col("_lo") != F.col("_hi"), F.raise_error(F.concat(
            F.lit("conflicting copies of "), F.to_json(F.struct(*key)))).cast("boolean")).isNull())
    return kept.select(*key, *rest, "copies", *more)


def drop_copies_ungrouped(turns: DataFrame, payload: list[str], row_id: str, strict: bool = True) -> DataFrame:
    """As :func:`drop_copies`; rows without a full identity stay, each as its own trajectory."""
    whole = F.col("group_idx").isNotNull() & F.col("traj_idx").isNotNull() & F.col("turn_idx").isNotNull()
    grouped = drop_copies(turns.filter(whole), payload, strict=strict)
    alone = turns.filter(~whole).withColumn("copies", F.lit(1).cast("long"))
    alone = alone.withColumn("group_idx", F.concat(F.lit("ungrouped-"), F.col(row_id).cast("string")))
    return grouped.unionByName(alone.withColumn("traj_idx", F.coalesce("traj_idx", F.lit(0)))
                               .withColumn("turn_idx", F.coalesce("turn_idx", F.lit(1))).select(*grouped.columns))


def first_copy_mask(turns: DataFrame, order: str, mask: str | None = None, key: list[str] = KEY) -> DataFrame:
    """Flag the first copy of each key; with ``mask``, zero the mask of the later ones."""
    first = turns.groupBy(*key).agg(F.min(order).alias("_first"))
    flagged = null_safe(turns, first, key).withColumn("is_first", F.col(order) == F.col("_first")).drop("_first")
    if mask:
        flagged = flagged.withColumn(mask, F.when(F.col("is_first"), F.col(mask)).otherwise(
            F.transform(mask, lambda m: F.lit(0).cast("int"))))
    return flagged


def sequence_stats(turn: str = "turn_idx") -> list[Column]:
    """Aggregates that decide whether the turns of a trajectory are whole."""
    t = F.col(turn)
    return [F.min(t).alias("first_turn"), F.max(t).alias("final_turn"), F.count_if("last_turn").alias("terminals"),
            F.max(F.when(F.col("last_turn"), t)).alias("terminal_turn")]


def sequence_issues(distinct: Column | None = None) -> Column:
    """Issues from :func:`sequence_stats` and ``turns``. Without repeated turns (deduplicated
    rows) first, last and count settle contiguity; else pass the distinct count."""
    whole = (F.col("first_turn") == 1) & (F.col("final_turn") == F.col("turns"))
    if distinct is not None:
        whole = whole & (distinct == F.col("turns"))
    return issues(
        (~whole, "turns are not contiguous from 1"), (F.col("terminals") != 1, "expected exactly one terminal turn"),
        ((F.col("terminals") == 1) & (F.col("terminal_turn") != F.col("final_turn")), "terminal marker is not on the final turn"))


def trajectory_report(turns: DataFrame, turn: str = "turn_idx") -> DataFrame:
    """Per trajectory: turn range, terminal markers and what is wrong with them.

    Rows are counted per turn first, which takes repeated turns out of the second pass.
    """
    per = turns.groupBy(*TRAJECTORY, turn).agg(F.count("*").alias("_n"), F.count_if("last_turn").alias("_l"))
    t, end = F.col(turn), F.col("_l") > 0
    stats = per.groupBy(*TRAJECTORY).agg(
        F.min(t).alias("first_turn"), F.max(t).alias("final_turn"), F.sum("_n").alias("turns"), F.count("*").alias("distinct_turns"),
        F.sum("_l").alias("terminals"), F.max(F.when(end, t)).alias("terminal_turn"))
    return stats.withColumn("issues", sequence_issues(F.col("distinct_turns")))


def group_report(trajectories: DataFrame, expected: int | None = None) -> DataFrame:
    """Per group: trajectory ids must be exactly 0..n-1 (and n as declared, if it is)."""
    stats = trajectories.select(*TRAJECTORY).distinct().groupBy("group_idx").agg(
        F.count("*").alias("trajectories"), F.min("traj_idx").alias("low"), F.max("traj_idx").alias("high"))
    rules = [((F.col("low") != 0) | (F.col("high") != F.col("trajectories") - 1), "trajectory ids are not 0..n-1")]
    if expected is not None:
        rules.append((F.col("trajectories") != expected, f"expected {expected} trajectories"))
    return stats.withColumn("issues", issues(*rules))


def keep_whole_groups(turns: DataFrame, report: DataFrame) -> DataFrame:
    """Drop every row of a group that has an issue."""
    bad = report.filter(F.size("issues") > 0).select(F.col("group_idx").alias("_bad"))
    return turns.join(bad, F.col("group_idx").eqNullSafe(F.col("_bad")), "left_anti")


def assign_ids(tasks: DataFrame, uid: str, order: list[str], name: str = "traj_idx", within: DataFrame | None = None) -> DataFrame:
    """Number the rows of each uid 0..n-1 in ``order`` (a total order)."""
    return row_numbers(tasks, [uid], order, name, within).withColumn(name, (F.col(name) - 1).cast("int"))


def turn_count(rows: str = "rows", low: str = "low", high: str = "high") -> Column:
    """Declared turn count if usable, else the row count; the declared range comes pre-aggregated."""
    declared = F.when(F.col(low) != F.col(high), F.raise_error(
        F.lit("conflicting trajectory turn counts")).cast("int")).otherwise(F.col(high))
    return F.when(declared.isNotNull() & ((F.col(rows) == 1) | (declared >= F.col(rows))), declared
                  ).otherwise(F.col(rows)).cast("long")


def declared_turns(*columns: Column) -> Column:
    """First positive whole number among the places where a turn count may be written."""
    return F.coalesce(*[F.when((c > 0) & (c == F.floor(c)), c.cast("long")) for c in columns])


def trajectory_records(turns: DataFrame, declared: Column | None = None, *more: Column) -> DataFrame:
    """Per trajectory: reward sum, turn count, success of any turn, and further aggregates."""
    d = declared if declared is not None else F.lit(None).cast("long")
    agg = turns.groupBy(*TRAJECTORY).agg(
        F.sum(F.coalesce("score", F.lit(0.0))).alias("reward"), F.count("*").alias("rows"),
        F.min(d).alias("low"), F.max(d).alias("high"), F.bool_or(F.coalesce("traj_success", F.lit(False))).alias("success"), *more)
    return agg.withColumn("turns", turn_count()).drop("rows", "low", "high")


def return_to_go(turns: DataFrame, score: str = "score", max_turns: int | None = None) -> DataFrame:
    """Sum of this and all later scores of the trajectory."""
    return affine_suffix(turns, TRAJECTORY, "turn_idx", F.coalesce(score, F.lit(0.0)), F.lit(1.0), max_turns).withColumnRenamed(
        "suffix", "return_to_go").drop("after")


def concat_segments(turns: DataFrame, width: int | None = None) -> DataFrame:
    """Join the turns of a trajectory into token sequences.

    A turn contributes its own prompt (masked out, score 0; the first turn's prompt stays
    apart) and its response. A trajectory is one row, whatever its length. With ``width``,
    every so many turns start a new segment, and rows are told apart by ``segment``.
    Expects trimmed ``prompts``, ``responses``, ``response_mask``, ``rm_scores`` and
    optionally ``image_data`` and ``extra``.
    """
    first = F.col("turn_idx") <= 1
    zeros = F.transform("prompts", lambda p: F.lit(0))
    body = turns.select(
        *TRAJECTORY, "turn_idx", (F.floor((F.greatest("turn_idx", F.lit(1)) - 1) / width) if width else F.lit(0)).cast("int").alias("segment"),
        F.when(first, F.col("prompts")).alias("prompt"),
        F.when(first, F.col("responses")).otherwise(F.concat("prompts", "responses")).alias("r"),
        F.when(first, F.col("response_mask")).otherwise(F.concat(zeros, F.col("response_mask"))).alias("m"),
        F.when(first, F.col("rm_scores").cast("array<double>")).otherwise(
            F.concat(zeros.cast("array<double>"), F.col("rm_scores").cast("array<double>"))).alias("s"),
        F.coalesce(F.col("image_data"), F.array().cast("array<string>")).alias("g") if "image_data" in turns.columns
        else F.array().cast("array<string>").alias("g"),
        F.col("extra").alias("x") if "extra" in turns.columns else F.lit(None).cast("string").alias("x"))
    packed = body.groupBy(*TRAJECTORY, "segment").agg(in_order(body, "turn_idx", "prompt", "r", "m", "s", "g", "x").alias("p"))
    return packed.select(
        *TRAJECTORY, "segment", F.size("p").alias("turns"),
        F.when(F.col("segment") == 0, F.col("p")[0]["prompt"]).alias("prompts"),
        F.flatten("p.r").alias("responses"), F.flatten("p.m").alias("response_mask"),
        F.flatten("p.s").alias("rm_scores"), F.flatten("p.g").alias("image_data"),
        F.element_at(F.col("p.x"), -1).alias("extra"))


def lift_extra(concatenated: DataFrame, extra: str, fields: list[str]) -> DataFrame:
    """Copy the fields of a map column to the top level; a name clash is an error."""
    clash = sorted(set(fields) & set(concatenated.columns))
    if clash:
        raise ValueError(f"extra fields clash with columns: {clash}")
    return concatenated.select("*", *[F.col(extra)[f].alias(f) for f in fields])


def turn_zero_list(episodes: DataFrame, id_columns: list[str]) -> DataFrame:
    """One row per turn with turn 0 for the reset info.

    With one more info than rewards the infos are shifted by one. Success is what the
    turn's own info says, else false.
    """
    shift = F.when(F.size("infos") == F.size("rewards") + 1, 1).otherwise(0)

    def success(i: Column) -> Column:
        return F.coalesce(i["success"], i["is_success"], i["solved"], F.lit(False))

    reset = F.when(F.size("infos") >= 1, F.array(F.struct(
        F.lit(0).alias("turn"), F.lit(None).cast("double").alias("reward"),
        success(F.col("infos")[0]).alias("success")))).otherwise(
            F.array().cast("array<struct<turn:int,reward:double,success:boolean>>"))
    steps = F.transform("rewards", lambda r, i: F.struct(
        (i + 1).cast("int").alias("turn"), r.cast("double").alias("reward"),
        F.coalesce(success(F.try_element_at(F.col("infos"), (i + 1 + shift).cast("int"))), F.lit(False)).alias("success")))
    return episodes.select(*id_columns, F.inline(F.concat(reset, steps)))


def is_last_turn(done: Column, success: Column, turn: Column, max_turns: Column,
                 tokens: Column, max_tokens: Column) -> Column:
    """A turn ends the episode on done, success, the turn limit or the token limit."""
    return F.coalesce(done, F.lit(False)) | F.coalesce(success, F.lit(False)) | (turn >= max_turns) | (tokens >= max_tokens)
