"""Turn rewards re-derived from logged turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollframe.distributed import SLICE, ordered, previous
from rollframe.operators.trajectories import TRAJECTORY


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def navigation_reward(turns: DataFrame, format_reward: float = 0.5, per_turn_format_reward: float = 0.0,
                      success_reward: float = 10.0) -> DataFrame:
    """Turn bonus, success bonus, and an end bonus if no turn so far was malformed.

    Needs ``format_correct``, ``valid_actions`` (count) and ``success``. The running flag is
    a comparison with the trajectory's first malformed turn, so no ordered pass is needed.
    """
    ok = _flag(F.col("format_correct"))
    first_bad = turns.groupBy(*TRAJECTORY).agg(F.min(F.when(~ok, F.col("turn_idx"))).alias("_bad"))
    clean = F.col("_bad").isNull() | (F.col("turn_idx") < F.col("_bad"))
    reward = (F.when(ok & (F.col("valid_actions") > 0), per_turn_format_reward).otherwise(0.0)
              + F.when(_flag(F.col("success")), F.lit(success_reward) + F.when(clean, format_reward).otherwise(0.0)).otherwise(0.0))
    return turns.join(first_bad, TRAJECTORY).withColumn("reward", reward).drop("_bad")


def staged_reward(format_correct: Column, valid_actions: Column, actions: Column, stage_reward: Column, success: Column,
                  format_reward: float = 0.1, success_reward: float = 10.0) -> Column:
    all_valid = _flag(format_correct) & (valid_actions > 0) & (valid_actions == actions)
    return (F.when(all_valid, format_reward).otherwise(0.0) + F.coalesce(stage_reward, F.lit(0.0))
            + F.when(_flag(success), success_reward).otherwise(0.0))


def grid_reward(valid_actions: Column, success: Column, format_reward: float, success_reward: float,
                format_correct: Column | None = None) -> Column:
    """Success and format bonus; one grid family also asks for a correct format."""
    shaped = valid_actions > 0
    if format_correct is not None:
        shaped = shaped & _flag(format_correct)
    return F.when(_flag(success), success_reward).otherwise(0.0) + F.when(shaped, format_reward).otherwise(0.0)


def stage_level(success: Column, stage_flags: Column) -> Column:
    """10 on success, else twice the number of the highest stage done (stages count from 0)."""
    done = F.transform(stage_flags, lambda f, i: F.when(f, i + 1).otherwise(0))
    return F.when(_flag(success), 10.0).otherwise(F.coalesce(F.array_max(done), F.lit(0)) * 2.0)


def stage_progress(steps: DataFrame, episode: str, step: str, level: str) -> DataFrame:
    """Change of the stage level since the previous step of the episode."""
    spread = previous(ordered(steps, [episode], [step]), [episode], [step], {"_prev": level})
    return spread.withColumn("stage_reward", F.col(level) - F.coalesce("_prev", F.lit(0.0))).drop("_prev", SLICE)
