"""Extension points: filters, metrics and advantage estimators by name.

A filter maps ``(rows, **options)`` to ``(rows, report)``; a metric maps rows to an aggregate
column or to a one-row DataFrame; an estimator maps turns to turns with ``advantage`` and
``turn_return``; an expander is a table function class that makes rows out of rows.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from rollframe.distributed import null_safe, with_row
from rollframe.functions import tokens as T
from rollframe.operators import credit, groups
from rollframe.operators.trajectories import drop_copies
from rollframe.session import stage

log = logging.getLogger(__name__)


class Registry:
    """Names to functions; a name cannot be given to a second function."""

    def __init__(self, kind: str):
        self.kind, self.entries = kind, {}

    def register(self, name: str) -> Callable:
        def add(fn: Callable) -> Callable:
            if self.entries.get(name, fn) is not fn:
                raise ValueError(f"{self.kind} {name} is already registered")
            self.entries[name] = fn
            return fn
        return add

    def get(self, name: str) -> Callable:
        if name not in self.entries:
            raise KeyError(f"unknown {self.kind}: {name} (known: {sorted(self.entries)})")
        return self.entries[name]


filters, metrics, estimators, expanders = Registry("filter"), Registry("metric"), Registry("estimator"), Registry("expander")


@filters.register("reward_variance")
def top_k_filter(rows: DataFrame, topk: float = 0.2, ddof: int = 0, **_) -> tuple[DataFrame, DataFrame]:
    variances = stage(groups.group_variance(rows, ddof=ddof))
    kept = groups.top_k_groups(variances, topk)
    return groups.filter_rows(rows, kept), groups.filter_report(variances, kept)


@filters.register("reward_variance_top_p")
def top_p_filter(rows: DataFrame, top_p: float = 0.9, ddof: int = 0, **_) -> tuple[DataFrame, DataFrame]:
    """Also scales an ``advantage`` column by the square root of the kept share of groups."""
    variances = stage(groups.group_variance(rows, ddof=ddof))
    kept = groups.top_p_groups(variances, top_p)
    out, report = groups.filter_rows(rows, kept), groups.filter_report(variances, kept)
    if "advantage" in rows.columns:
        out = with_row(out, report.select("loss_scale")).withColumn(
            "advantage", F.col("advantage") * F.coalesce("loss_scale", F.lit(1.0))).drop("loss_scale")
    return out, report


@metrics.register("reward_variance")
def reward_variance(rows: DataFrame, ddof: int = 0) -> DataFrame:
    return groups.mean_group_variance(rows, ddof=ddof)


def _payload(turns: DataFrame) -> list[str]:
    """The columns in which copies of a turn must agree."""
    return [c for c in ("score", "value", "output", "last_turn", "traj_success") if c in turns.columns]


def _turn_gae(turns: DataFrame, last: bool, gamma: float, lam: float, whiten: bool) -> DataFrame:
    """Turn advantages on unique turns, whitened over valid tokens, given back to every copy.

    A turn's value is column ``value``; where token ``values`` with a ``response_mask`` are
    there instead, it is the one at the first or last valid token.
    """
    own = turns
    if "values" in turns.columns and "value" not in turns.columns:
        own = turns.withColumn("value", T.value_at_anchor("values", "response_mask", last=last))
    slim = [c for c in (*credit.KEY, *_payload(own), "value", "tokens", "response_mask") if c in own.columns]
    unique = drop_copies(own.select(*dict.fromkeys(slim)), _payload(own))
    done = credit.generalized_advantages(unique, "score", "value", gamma, lam)
    if whiten:
        size = F.col("tokens") if "tokens" in own.columns else T.mask_size("response_mask") if "response_mask" in own.columns else F.lit(1)
        done = credit.whiten(done.withColumn("_size", size), tokens="_size").withColumn("advantage", F.col("whitened"))
    return credit.back_to_copies(turns, done, ["advantage", "turn_return"])


@estimators.register("no_concat_gae")
def turn_gae(turns: DataFrame, gamma: float = 1.0, lam: float = 1.0, whiten: bool = True, **_) -> DataFrame:
    return _turn_gae(turns, False, gamma, lam, whiten)


@estimators.register("no_concat_gae_last")
def turn_gae_last(turns: DataFrame, gamma: float = 1.0, lam: float = 1.0, whiten: bool = True, **_) -> DataFrame:
    return _turn_gae(turns, True, gamma, lam, whiten)


def _to_rows(turns: DataFrame, advantages: DataFrame) -> DataFrame:
    adv = advantages.select(*credit.TRAJECTORY, "advantage")
    return null_safe(turns, adv, credit.TRAJECTORY).withColumn("turn_return", F.col("advantage"))


@estimators.register("no_concat_episode_grpo")
def episode_relative(turns: DataFrame, **options) -> DataFrame:
    """Rows of whole groups only: a broken trajectory voids its group."""
    mode = options.pop("mode", "outcome")
    return _to_rows(turns, credit.episode_advantages(turns, _payload(turns), mode, reward="score", success="traj_success", **options))


@estimators.register("grpo")
def group_relative(turns: DataFrame, eps: float = 1e-6, **_) -> DataFrame:
    unique = drop_copies(turns.select(*dict.fromkeys([*credit.KEY, *_payload(turns)])), _payload(turns))
    totals = unique.groupBy(*credit.TRAJECTORY).agg(F.sum("score").alias("trajectory_score"))
    return _to_rows(turns, credit.group_advantages(totals, sample_std=True, eps=eps))


def all_metrics(rows: DataFrame, prefix: str = "custom_metrics", by: list[str] | None = None, known: Registry = metrics) -> DataFrame:
    """Every registered metric as one long table; one that cannot be planned is skipped with a warning.

    Aggregate columns are fused: all of them are one aggregate of one pass over the rows, per
    group of ``by`` if that is given. Metrics that come as tables are for the rows as a whole.
    """
    by, out, fused = by or [], None, {}
    for name, fn in sorted(known.entries.items()):
        try:
            one = fn(rows)
            if isinstance(one, Column):
                rows.groupBy(*by).agg(one)  # plans it, so that a bad one is known by name
                fused[name] = one.cast("double")
                continue
            if by:
                continue
            part = one.select(F.lit(f"{prefix}/{name}").alias("metric"), F.col(one.columns[0]).cast("double").alias("metric_value"))
        except Exception as error:  # noqa: BLE001
            log.warning("metric %s skipped: %s", name, error)
            continue
        out = part if out is None else out.unionByName(part)
    if fused:
        together = rows.groupBy(*by).agg(*[c.alias(f"m{i}") for i, c in enumerate(fused.values())])
        listed = F.array(*[F.struct(F.lit(f"{prefix}/{n}").alias("metric"), F.col(f"m{i}").alias("metric_value")) for i, n in enumerate(fused)])
        part = together.select(*by, F.inline(listed))
        out = part if out is None else out.unionByName(part)
    return out


@expanders.register("slots")
class Slots:
    """A row for each of the ``count`` column's slots, numbered from 0; a null or negative count gives none."""

    @staticmethod
    def analyze(row: AnalyzeArgument, count: AnalyzeArgument) -> AnalyzeResult:
        if not row.isTable or count.value not in row.dataType.fieldNames():
            raise ValueError("slots takes a table and the name of one of its columns")
        return AnalyzeResult(StructType(list(row.dataType.fields)).add("slot", IntegerType()))

    def eval(self, row, count):
        for slot in range(row[count] or 0):
            yield (*row, slot)


def expand_rows(rows: DataFrame, name: str, *options) -> DataFrame:
    """What a registered table function makes of the rows, where they are.

    The function says from the rows' own schema what it returns (``analyze``); its work is done
    by the tasks that hold the rows, and nothing is shuffled.
    """
    return F.udtf(expanders.get(name))(rows.asTable(), *[F.lit(o) for o in options])
