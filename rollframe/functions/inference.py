"""Intervals and tests: column arithmetic where Spark has the functions, and small pandas
helpers over already aggregated rows where it does not (normal tail, incomplete beta,
hypergeometric terms)."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType


def wilson(successes: Column, trials: Column, confidence: float = 0.95) -> Column:
    """Struct of the interval ends; zero trials give (0, 0), impossible counts are an error."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie in (0, 1)")
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    n, p = trials.cast("double"), successes / trials
    scale = 1 + F.lit(z * z) / n
    center = (p + F.lit(z * z / 2) / n) / scale
    margin = F.lit(z) * F.sqrt((p * (1 - p) + F.lit(z * z / 4) / n) / n) / scale
    bad = F.when((successes < 0) | (trials < 0) | (successes > trials), F.raise_error(F.lit("invalid counts")).cast("double"))

    def end(value: Column) -> Column:
        return F.when((successes < 0) | (trials < 0) | (successes > trials), bad).when(trials == 0, 0.0).otherwise(value)
    return F.struct(end(F.greatest(F.lit(0.0), center - margin)).alias("low"),
                    end(F.least(F.lit(1.0), center + margin)).alias("high"))


def cohens_d(n1: Column, mean1: Column, var1: Column, n2: Column, mean2: Column, var2: Column, pooled: bool = True) -> Column:
    """Standardized mean difference from counts, means and sample variances."""
    spread = F.sqrt(((n1 - 1) * F.coalesce(var1, F.lit(0.0)) + (n2 - 1) * F.coalesce(var2, F.lit(0.0))) / F.nullif(n1 + n2 - 2, F.lit(0))) \
        if pooled else F.sqrt(var1)
    return F.when((n1 > 0) & (n2 > 0) & (spread > 0), (mean1 - mean2) / spread).otherwise(0.0)


def effect_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def efficiency(rate: Column, hours: Column) -> Column:
    some = hours > 0
    return F.struct(F.when(some, rate / hours).otherwise(0.0).alias("success_per_gpu_hour"),
                    F.when(some, hours / F.greatest(rate, F.lit(1e-6))).otherwise(float("inf")).alias("gpu_hours_per_success_point"))


#: The smaller sample up to which the tail has a closed form of bounded size.
CLOSED_FORM = 10


@functools.cache
def _box_counts(m: int) -> tuple[int, list[int]]:
    """Period and numerator of 1 / ((1 - q) (1 - q) ... (1 - q**m)), over the power m + 1 of (1 - q**period)."""
    period = math.lcm(*range(1, m + 1))
    numerator = [1]
    for i in (1, *range(1, m + 1)):
        out = numerator + [0] * (period - i)
        for at in range(i, len(out)):  # over (1 - q**i)
            out[at] += out[at - i]
        for at in range(len(out) - 1, period - 1, -1):  # times (1 - q**period)
            out[at] -= out[at - period]
        numerator = out
    return period, numerator


def exact_u_tail(u: float, n1: int, n2: int) -> float:
    """P(U >= u) of two samples without ties, in whole numbers and bounded memory.

    The distribution is symmetric, so the tail has ``d = n1 n2 - ceil(u)`` as its last value
    when counted from the other end. Up to ``CLOSED_FORM`` in the smaller sample, the number of
    arrangements with U of ``d`` at most is a signed sum of binomials, whatever the larger sample.
    Beyond, a recurrence runs over the tail alone, in memory proportional to ``d``.
    """
    m, n = min(n1, n2), max(n1, n2)
    d = m * n - math.ceil(u)
    if d < 0:
        return 0.0
    every = math.comb(m + n, m)
    if m > CLOSED_FORM:
        ways = [1] + [0] * d
        for i in range(1, m + 1):
            for at in range(d, n + i - 1, -1):
                ways[at] -= ways[at - n - i]
            for at in range(i, d + 1):
                ways[at] += ways[at - i]
        return sum(ways) / every
    period, numerator = _box_counts(m)
    # Signed sizes of the sets of factors (1 - q**(n + i)): count of members, sum of their i.
    signs = {(0, 0): 1}
    for i in range(1, m + 1):
        for (k, total), sign in list(signs.items()):
            signs[k + 1, total + i] = signs.get((k + 1, total + i), 0) - sign
    found = 0
    for (k, total), sign in signs.items():
        left = d - k * n - total
        for j in range(left % period, min(len(numerator), left + 1), period) if left >= 0 else ():
            found += sign * numerator[j] * math.comb((left - j) // period + m, m)
    return found / every


def mann_whitney_p(u: Column | str, n1: Column | str, n2: Column | str, ties: Column | str, method: str = "auto") -> Column:
    """Two-sided p from U, sizes and the tie sum.

    ``exact`` takes the distribution of samples without ties, ``normal`` the normal form with
    corrections for ties and continuity. ``auto`` is the reference rule: exact where there are no
    ties and the smaller sample has at most 8 values.
    """
    if method not in ("auto", "exact", "normal"):
        raise ValueError("method must be auto, exact or normal")
    return _rank_test_p(u, n1, n2, ties, F.lit(method))


@F.pandas_udf(DoubleType())
def _rank_test_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series, method: pd.Series) -> pd.Series:
    out = []
    for uu, a, b, t, how in zip(u, n1, n2, ties, method):
        a, b = int(a), int(b)
        if a < 1 or b < 1:
            out.append(1.0)
            continue
        top = max(uu, a * b - uu)
        if how == "exact" or how == "auto" and min(a, b) <= 8 and t == 0:
            out.append(min(1.0, 2 * exact_u_tail(top, a, b)))
            continue
        n = a + b
        var = a * b / 12.0 * ((n + 1) - t / (n * (n - 1.0)))
        z = (top - a * b / 2.0 - 0.5) / math.sqrt(var) if var > 0 else 0.0
        out.append(min(1.0, math.erfc(z / math.sqrt(2.0))) if var > 0 else 1.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def fisher_p(s1: pd.Series, n1: pd.Series, s2: pd.Series, n2: pd.Series) -> pd.Series:
    """Two-sided Fisher exact p. Terms beyond 60 deviations of the mode vanish in doubles."""
    out = []
    for a, m, c, n in zip(s1, n1, s2, n2):
        a, m, c, n = int(a), int(m), int(c), int(n)
        k, total = a + c, m + n
        lo, hi = max(0, k - n), min(k, m)
        if total == 0 or lo == hi:
            out.append(1.0)
            continue
        mean = k * m / total
        sd = math.sqrt(max(1.0, mean * (1 - m / total) * (total - k) / max(1, total - 1)))
        x = np.arange(max(lo, int(mean - 60 * sd)), min(hi, int(mean + 60 * sd)) + 1)
        steps = np.log((m - x[:-1]) * 1.0) + np.log((k - x[:-1]) * 1.0) - np.log(x[:-1] + 1.0) - np.log(n - k + x[:-1] + 1.0)
        logs = np.concatenate([[0.0], np.cumsum(steps)])
        pmf = np.exp(logs - logs.max())
        pmf /= pmf.sum()
        here = pmf[a - x[0]] if x[0] <= a <= x[-1] else 0.0
        out.append(float(min(1.0, pmf[pmf <= here * (1 + 1e-7)].sum())))
    return pd.Series(out, dtype="float64")


def odds_ratio(s1: Column, n1: Column, s2: Column, n2: Column) -> Column:
    top, bottom = s1 * (n2 - s2), (n1 - s1) * s2
    return F.when(bottom > 0, top / bottom).when(top > 0, float("inf")).otherwise(float("nan"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularized incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 20_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"the incomplete beta function did not converge at {a}, {b}, {x}")


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation from the t distribution with n-2 degrees of freedom."""
    out = []
    for rr, nn in zip(r, n):
        if rr is None or math.isnan(rr) or nn < 2:
            out.append(None)
        elif nn == 2:
            out.append(1.0)
        else:
            out.append(incomplete_beta((nn - 2) / 2.0, 0.5, max(0.0, 1.0 - rr * rr)))
    return pd.Series(out, dtype="float64")


def _majority(votes: list[tuple[float, int]], size: int) -> float:
    """Expected winner of a vote among ``size`` of the samples, all subsets alike; ties go to the larger value.

    For every number of votes that a value may win with, the ways to draw the rest are the
    coefficient of a product of polynomials: smaller values may have as many votes, larger ones fewer.
    """
    def times(poly: list[int], count: int, most: int, degree: int) -> list[int]:
        ways = [math.comb(count, j) for j in range(min(count, most, degree) + 1)]
        out = [0] * min(degree + 1, len(poly) + len(ways) - 1)
        for i, a in enumerate(poly):
            for j, b in enumerate(ways[: len(out) - i]):
                out[i + j] += a * b
        return out

    total = 0.0
    every = math.comb(sum(n for _, n in votes), size)
    for k in range(1, min(size, max(n for _, n in votes)) + 1):
        degree = size - k
        above = [[1]]
        for _, n in votes[:0:-1]:
            above.append(times(above[-1], n, k - 1, degree))
        below = [1]
        for (x, n), high in zip(votes, above[::-1]):
            if n >= k:
                rest = sum(a * high[degree - i] for i, a in enumerate(below) if 0 <= degree - i < len(high))
                total += x * (math.comb(n, k) * rest / every)
            below = times(below, n, k, degree)
    return total


def _best(votes: list[tuple[float, int]], size: int) -> float:
    """Expected largest of ``size`` of the samples: every value weighs the share of subsets it tops."""
    every, before, upto, total = math.comb(sum(n for _, n in votes), size), 0, 0, 0.0
    for x, n in votes:
        upto += n
        ways = math.comb(upto, size)
        total += x * ((ways - before) / every)
        before = ways
    return total


_DRAWN = ArrayType(StructType([StructField("size", IntegerType()), StructField("best", DoubleType()), StructField("maj", DoubleType())]))


@F.pandas_udf(_DRAWN)
def drawn_metrics(votes: pd.Series) -> pd.Series:
    """Expected best and majority of N samples drawn without repetition, for N = 1, 2, 4, ... below
    the number of samples, and for all of them. Takes (value, count) by ascending value. Exact."""
    out = []
    for row in votes:
        table = [(float(v["x"]), int(v["n"])) for v in row]
        count = sum(n for _, n in table)
        sizes = [2 ** i for i in range(count.bit_length()) if 2 ** i < count] + [count]
        out.append([{"size": s, "best": _best(table, s), "maj": _majority(table, s)} for s in sizes])
    return pd.Series(out)
