"""Random draws that are functions of their place: the same on every machine, retry and engine.

A draw comes from a seed number by mixing 31-bit whole numbers, which any SQL engine with
64-bit integers repeats. Nothing is drawn in Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = (1 << 31) - 1
#: Shifts and odd factors of the mixing rounds.
ROUNDS = ((15, 739982445), (12, 1911520717), (15, 1432512553))
#: What a resample and a stream add to the seed.
STEP, STREAM = 1640531527, 1013904223
#: Counts below this are drawn from the distribution's own table.
TABLE = 64


def mixed(seed: Column) -> Column:
    """31 bits spread from a whole number below 2**62."""
    h = seed.bitwiseAND(F.lit(MASK))
    for shift, factor in ROUNDS:
        h = (h.bitwiseXOR(F.shiftright(h, shift)) * F.lit(factor)).bitwiseAND(F.lit(MASK))
    return h.bitwiseXOR(F.shiftright(h, 16))


def mixed_sql(seed: str) -> str:
    h = f"(({seed}) & {MASK})"
    for shift, factor in ROUNDS:
        h = f"((xor({h}, {h} >> {shift}) * {factor}) & {MASK})"
    return f"xor({h}, {h} >> 16)"


def text_seed(*parts: Column) -> Column:
    """28 bits of a digest of texts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("long")


def number_text(x: Column) -> Column:
    """A number to 13 digits: sums that differ by the order of additions have one text."""
    return F.format_string("%.12e", x.cast("double") + F.lit(0.0))


def poisson_steps(rate: int) -> list[int]:
    """The distribution function of a Poisson count at 0, 1, ..., in units of 2**-31, as far as it is below one."""
    total, out = 0.0, []
    for k in range(rate + 12 * math.isqrt(rate) + 24):
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate else float(k == 0)
        out.append(math.floor(total * (MASK + 1)))
    return [t for t in out if t <= MASK]


def poisson_draws(rows: DataFrame, rate: str, seed: str, resample: str, name: str) -> DataFrame:
    """Add one Poisson count per row, of whole mean ``rate``, fixed by ``seed`` and ``resample``.

    The mean is cut into a multiple of ``TABLE`` and a rest. The rest is drawn by inverting its
    distribution function; the multiple by a normal draw with its first correction for skewness,
    whose distribution function is off by less than 0.002 from a mean of ``TABLE`` on.
    """
    spark = rows.sparkSession
    steps = spark.createDataFrame([(r, poisson_steps(r)) for r in range(TABLE)], "_rest int, _steps array<long>")
    at = lambda stream: mixed(F.col(seed) + F.col(resample).cast("long") * STEP + stream * STREAM)
    whole = F.col(rate) - F.col(rate) % TABLE
    drawn = rows.withColumn("_rest", (F.col(rate) % TABLE).cast("int")).join(F.broadcast(steps), "_rest")
    drawn = drawn.withColumn("_u", at(0)).withColumn("_m", whole.cast("double")).withColumn(
        "_z", F.sqrt(-2 * F.log((at(1) + 1) / F.lit(float(MASK + 1)))) * F.cos(F.lit(2 * math.pi) * (at(2) / F.lit(float(MASK + 1)))))
    small = F.size(F.filter("_steps", lambda t: t <= F.col("_u")))
    large = F.when(F.col("_m") > 0, F.greatest(F.lit(0.0), F.floor(F.col("_m") + F.sqrt("_m") * F.col("_z") + (F.col("_z") * F.col("_z") - 1) / 6 + 0.5))).otherwise(0.0)
    return drawn.select(*rows.columns, (small + large).alias(name))


def poisson_draws_sql(source: str, rate: str, seed: str, resample: str, name: str) -> str:
    """The same over a table ``source``, as a query."""
    at = lambda stream: mixed_sql(f"{seed} + {resample} * {STEP} + {stream} * {STREAM}")
    return f"""SELECT * EXCLUDE (_u, _m, _z, _rest, _steps), len(list_filter(_steps, lambda t: t <= _u)) + CASE WHEN _m > 0 THEN greatest(0.0, floor(_m + sqrt(_m) * _z + (_z * _z - 1) / 6 + 0.5)) ELSE 0.0 END AS {name}
  FROM (SELECT *, {rate} % {TABLE} AS _rest, {at(0)} AS _u, CAST({rate} - {rate} % {TABLE} AS DOUBLE) AS _m,
    sqrt(-2 * ln(({at(1)} + 1) / {float(MASK + 1)})) * cos(2 * pi() * ({at(2)} / {float(MASK + 1)})) AS _z FROM {source}) d
  JOIN (SELECT r AS _rest, list(t ORDER BY k) AS _steps FROM (SELECT r, k, CAST(floor(sum(CASE WHEN r = 0 THEN CAST(k = 0 AS INTEGER) ELSE exp(-r + k * ln(greatest(r, 1)) - lgamma(k + 1)) END)
    OVER (PARTITION BY r ORDER BY k) * {MASK + 1}) AS BIGINT) AS t FROM range({TABLE}) a(r), range(200) b(k)) WHERE t <= {MASK} OR k = 0 GROUP BY r) s USING (_rest)"""
