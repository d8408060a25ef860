"""Column expressions over token arrays (no explode, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the marker that training code writes into value targets to be ignored.
IGNORED_TARGET = -100.0


def response_mask(attention_mask: str, responses: str) -> Column:
    """The attention mask restricted to the response, which sits at its end."""
    n = F.size(responses)
    return F.when(n == 0, F.slice(attention_mask, 1, 0)).otherwise(F.slice(F.col(attention_mask), -n, n))


def value_mask(returns: str, ignore_value: float = IGNORED_TARGET, half_precision: bool = False) -> Column:
    """True where a value target is real rather than the ignore marker."""
    eps = 1e-2 if half_precision else 1e-6
    return F.transform(returns, lambda r: F.coalesce(F.abs(r.cast("double") - F.lit(ignore_value)) >= eps, F.lit(False)))


def trim_right(tokens: str, pad: int) -> Column:
    """Drop the run of pads at the end; pads inside stay."""
    from_end = F.array_position(F.reverse(F.transform(tokens, lambda t: t != pad)), True)
    keep = F.when(from_end == 0, 0).otherwise(F.size(tokens) - from_end + 1).cast("int")
    return F.slice(tokens, F.lit(1), keep)


def trim_left(tokens: str, pad: int) -> Column:
    """Drop the run of pads at the start; an all-pad array becomes empty."""
    first = F.array_position(F.transform(tokens, lambda t: t != pad), True).cast("int")
    return F.when(first == 0, F.slice(tokens, 1, 0)).otherwise(F.slice(F.col(tokens), first, F.size(tokens)))


def masked_sum(values: str, mask: str) -> Column:
    return F.aggregate(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m")), F.lit(0.0),
                       lambda a, z: a + F.when(z["m"] != 0, z["v"].cast("double")).otherwise(0.0))


def mask_size(mask: str) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda a, m: a + F.when(m != 0, 1).otherwise(0))


def spread(scalar: Column, mask: str) -> Column:
    """A scalar on every valid token, zero elsewhere."""
    return F.transform(mask, lambda m: F.when(m != 0, scalar).otherwise(F.lit(0.0)))


def anchor_position(mask: str, last: bool) -> Column:
    """1-based position of the first or last valid token, 0 if there is none."""
    valid = F.transform(mask, lambda m: m != 0)
    if not last:
        return F.array_position(valid, True).cast("int")
    from_end = F.array_position(F.reverse(valid), True)
    return F.when(from_end == 0, 0).otherwise(F.size(mask) - from_end + 1).cast("int")


def value_at_anchor(values: str, mask: str, last: bool = False) -> Column:
    pos = anchor_position(mask, last)
    return F.when(pos > 0, F.try_element_at(F.col(values), pos)).otherwise(F.lit(0.0)).cast("double")


def sparse_targets(target: Column, mask: str, last: bool = False) -> Column:
    """The target at the anchor token and null elsewhere."""
    pos = anchor_position(mask, last)
    return F.transform(mask, lambda m, i: F.when(i + 1 == pos, target))


def export_targets(targets: str) -> Column:
    """Null targets written as the ignore marker, for consumers that expect it."""
    return F.transform(targets, lambda t: F.coalesce(t, F.lit(IGNORED_TARGET)))


def kl_penalized(scores: str, log_probs: str, ref_log_probs: str, mask: str, beta: float) -> Column:
    """Token reward minus ``beta`` times the log-ratio on valid tokens."""
    z = F.arrays_zip(F.col(scores).alias("s"), F.col(log_probs).alias("p"),
                     F.col(ref_log_probs).alias("q"), F.col(mask).alias("m"))
    return F.transform(z, lambda t: t["s"].cast("double") - F.when(
        t["m"] != 0, F.lit(beta) * (t["p"].cast("double") - t["q"].cast("double"))).otherwise(0.0))


def masked_mean_kl(log_probs: str, ref_log_probs: str, mask: str) -> Column:
    z = F.arrays_zip(F.col(log_probs).alias("p"), F.col(ref_log_probs).alias("q"), F.col(mask).alias("m"))
    total = F.aggregate(z, F.lit(0.0), lambda a, t: a + F.when(
        t["m"] != 0, t["p"].cast("double") - t["q"].cast("double")).otherwise(0.0))
    n = mask_size(mask)
    return F.when(n > 0, total / n)
