"""Order-dependent computations that stay spread out when one key holds most of the rows.

A plain window sends every row of a key to one task. The helpers here range-partition on
``keys + order`` instead, so a hot key covers many slices, work inside a slice, and carry
totals across slice borders. A border splits at most one key, so the table of carries has
fewer rows than there are slices: it is always safe to broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollframe.session import stage

SLICE = "_slice"
FOLD_WIDTH = 64
SLICE_BYTES = 256 << 20
#: The planner multiplies sizes over joins, so its number is not followed beyond this.
MOST_SLICES = 20_000


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row result to every row.

    The row is a scalar subquery: Spark runs it once, fails if it has a second row, and
    puts its values into the plan, so no join is involved.
    """
    value = one_row.select(F.struct(*one_row.columns).alias("_row")).scalar()
    return df.withColumn("_row", value).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in one_row.columns])


def slice_count(df: DataFrame) -> int:
    """Slices of about ``SLICE_BYTES``, by the planner's size of ``df``, but no fewer than shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_SLICES, -(-size // SLICE_BYTES)))


def ordered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range-partitioned copy of ``df`` with its slice number, fixed by staging."""
    slices = slice_count(df)
    ranged = df.repartitionByRange(slices, *[F.col(c) for c in [*keys, *order]])
    return stage(ranged.withColumn(SLICE, F.spark_partition_id()))


def _attach(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    on = [SLICE, *keys]
    renamed = carry.select(*[F.col(c).alias(f"_c_{c}") for c in on],
                           *[c for c in carry.columns if c not in on])
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return df.join(F.broadcast(renamed), match, "left").drop(*[f"_c_{c}" for c in on])


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums over an :func:`ordered` table."""
    per_slice = df.groupBy(SLICE, *keys).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slice.select(
        SLICE, *keys,
        F.row_number().over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_nth"),
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in sums],
    ).filter("_nth > 1").drop("_nth")
    inside = (Window.partitionBy(SLICE, *keys).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = df.select("*", *[F.sum(e).over(inside).alias(n) for n, e in sums.items()])
    joined = _attach(local, carry, keys)
    for n in sums:
        joined = joined.withColumn(n, F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)))
    return joined.drop(*[f"_o_{n}" for n in sums])


def previous(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """The previous row's values over an :func:`ordered` table; null on a key's first row."""
    last = df.groupBy(SLICE, *keys).agg(
        F.max_by(F.struct(*[F.col(c).alias(n) for n, c in values.items()]),
                 F.struct(*order)).alias("_last"))
    carry = last.select(
        SLICE, *keys,
        F.lag("_last").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_before"),
    ).filter("_before is not null")
    inside = Window.partitionBy(SLICE, *keys).orderBy(*order)
    local = df.select(
        "*", F.row_number().over(inside).alias("_pos"),
        *[F.lag(c).over(inside).alias(n) for n, c in values.items()])
    joined = _attach(local, carry, keys)
    for n in values:
        joined = joined.withColumn(n, F.when(F.col("_pos") == 1, F.col(f"_before.{n}")).otherwise(F.col(n)))
    return joined.drop("_before", "_pos")


#: Rows that a plain window may take of one key, and the hash buckets by which they are bounded.
WINDOW_ROWS = 1_000_000
HASH_BUCKETS = 1 << 16


def has_hot_key(df: DataFrame, keys: list[str]) -> bool:
    """Whether a key may have more than ``WINDOW_ROWS`` rows. Counts by hash bucket bound those of
    a key from above, and a task hands on at most one per bucket, however many keys there are."""
    if not keys:
        return True
    buckets = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(HASH_BUCKETS)).alias("_bucket")).agg(F.count("*").alias("_n"))
    return (buckets.agg(F.max("_n")).first()[0] or 0) > WINDOW_ROWS


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str = "rn", within: DataFrame | None = None) -> DataFrame:
    """``row_number`` from 1 inside ``keys``; ``order`` must be total and ascending.

    Without a hot key it is a plain window: one shuffle, and nothing is written in between.
    ``within`` is a table that holds all these rows and is cheaper to count.
    """
    if has_hot_key(df if within is None else within, keys):
        return running(ordered(df, keys, order), keys, order, {name: F.lit(1)}).drop(SLICE)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def in_order(rows: DataFrame, first: str, *rest: str) -> Column:
    """The rows of a group as an array of structs ordered by ``first`` (unique in the group)."""
    items = F.collect_list(F.struct(first, *rest))
    kinds = " ".join(t for n, t in rows.dtypes if n in rest)
    if "map<" not in kinds and "variant" not in kinds:
        return F.sort_array(items)
    # Maps and variants cannot be compared, so only the first field may be looked at.
    return F.array_sort(items, lambda a, b: F.when(a[first] < b[first], -1).when(a[first] > b[first], 1).otherwise(0))


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal names, taking null as a value; the result has the names once."""
    renamed = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in right.columns if c not in on])
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(renamed, match, how).drop(*[f"_on_{c}" for c in on])


def affine_suffix(df: DataFrame, keys: list[str], index: str, value: Column, factor: Column,
                  max_index: int | None = None) -> DataFrame:
    """Backward recurrence ``s(i) = value(i) + factor(i) * s(next i)`` inside ``keys``.

    Adds ``suffix`` (s at the row) and ``after`` (s at the next row, 0 on the last one).
    Rows are folded in blocks of at most ``FOLD_WIDTH`` index values, and the blocks' own
    totals are folded the same way, so no task ever holds a whole long key. The range of the
    index decides how many levels that takes, and nothing else: the largest one is measured,
    unless ``max_index`` states that it runs from 0 to that; any other index then fails the job.

    Any whole numbers will do as index, with gaps too. A row without an index comes before
    all others of its key; a null key is a key. An index that a key repeats fails the job.
    """
    if max_index is None:
        low, high = df.agg(F.min(index), F.max(index)).first()
        low, high = low or 0, high or 0
    else:
        low, high = 0, max_index
        over = F.when(~F.col(index).between(0, max_index), F.raise_error(F.concat(
            F.lit("index beyond max_index: "), F.col(index).cast("string"))).cast("boolean"))
        df = df.filter(over.isNull())
    rows = df.withColumn("_v", value.cast("double")).withColumn("_f", factor.cast("double")).withColumn(
        "_i", F.coalesce(F.col(index).cast("long") - F.lit(low) + 1, F.lit(0).cast("long")))
    return _fold(rows, keys, "_i", high - low + 1).select(*df.columns, "suffix", "after")


def _fold(rows: DataFrame, keys: list[str], index: str, top: int) -> DataFrame:
    """Fold rows whose index runs from 0 to ``top``."""
    payload = [c for c in rows.columns if c not in keys and c not in (index, "_b")]
    rows = rows.withColumn("_b", F.floor(F.col(index) / FOLD_WIDTH))
    packed = rows.groupBy(*keys, "_b").agg(in_order(rows, index, *payload).alias("_rows"))
    repeated = F.size(F.array_distinct(F.transform("_rows", lambda r: r[index]))) < F.size("_rows")
    packed = packed.withColumn("_rows", F.when(repeated, F.raise_error(F.concat(
        F.lit("repeated index in "), F.to_json(F.struct(*keys))))).otherwise(F.col("_rows")))

    # From the last row of a block back to its first, a row is looked at once. The tails then
    # stand in the order of the rows, with the empty one at the end.
    start = F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("p"))

    def before(tails, r):
        last = F.element_at(tails, -1)
        return F.array_append(tails, F.struct((r["_v"] + r["_f"] * last["s"]).alias("s"), (r["_f"] * last["p"]).alias("p")))

    packed = packed.withColumn("_in", F.reverse(F.aggregate(F.reverse("_rows"), F.array(start), before)))
    if top >= FOLD_WIDTH:
        blocks = packed.select(*keys, F.col("_b").alias("_i"),
                               F.col("_in")[0]["s"].alias("_v"), F.col("_in")[0]["p"].alias("_f"))
        carries = _fold(blocks, keys, "_i", top // FOLD_WIDTH).select(
            *keys, F.col("_i").alias("_b"), F.col("after").alias("_carry"))
        packed = null_safe(packed, carries, [*keys, "_b"])
    else:
        packed = packed.withColumn("_carry", F.lit(0.0))
    # What follows a row is the tail of the next one.
    steps = F.transform("_rows", lambda r, i: F.struct(r.alias("_row"), F.col("_in")[i].alias("_in"), F.col("_in")[i + 1].alias("_ex")))
    out = packed.select(*keys, "_carry", F.explode(steps).alias("_z"))
    return out.select(
        *keys, F.col(f"_z._row.{index}").alias(index),
        *[F.col(f"_z._row.{c}").alias(c) for c in payload],
        (F.col("_z._in.s") + F.col("_z._in.p") * F.col("_carry")).alias("suffix"),
        (F.col("_z._ex.s") + F.col("_z._ex.p") * F.col("_carry")).alias("after"))


#: Accuracy of the rank sketches (errors of about one row in so many) and half the width, as a
#: share of the rows, of the brackets they give.
SKETCH = 10_000
BRACKET = 1 / 2_500
#: Ranks that a bracket spans to either side at least, whatever its share of the rows.
LEAST_RANKS = 4


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles, by bracketed selection.

    A rank sketch per key, merged from the tasks' own, bounds each quantile from both sides. A
    second pass counts the rows between the brackets and, by value, those inside: only these
    counts are written and put in order. They also tell whether a rank fell outside its
    bracket; then all brackets are widened, in the end to all values.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    width = BRACKET
    while True:
        found = stage(_between_brackets(rows, keys, value, probs, width))
        if width >= 1 or not found.filter("_missed").head(1):
            return found.drop("_missed")
        width *= 64


def _between_brackets(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], width: float) -> DataFrame:
    ends = [e for p in probs.values() for e in (max(0.0, p - width), min(1.0, p + width))]
    sketched = rows.groupBy(*keys).agg(
        F.count("*").alias("_total"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.percentile_approx("_v", ends, SKETCH).alias("_q"))
    few = (F.col("_total") * width < LEAST_RANKS) | F.lit(width >= 1)
    names = [f"_{side}{i}" for i in range(len(probs)) for side in ("lo", "hi")]
    brackets = stage(sketched.select(*keys, "_total", *[
        F.when(few, F.col("_least" if j % 2 == 0 else "_most")).otherwise(F.col("_q")[j]).alias(n) for j, n in enumerate(names)]))
    both = null_safe(rows, brackets, keys) if keys else with_row(rows, brackets)
    passed = [(F.col("_v") >= F.col(f"_lo{i}"), F.col("_v") > F.col(f"_hi{i}")) for i in range(len(probs))]
    inside = reduce(lambda a, b: a | b, [low & ~high for low, high in passed])
    # The number of bracket ends passed grows with the value, so it orders brackets and gaps alike.
    cell = sum((e.cast("int") for pair in passed for e in pair), F.lit(0))
    cells = stage(both.select(*keys, "_total", cell.alias("_cell"), F.when(inside, F.col("_v")).alias("_v")).groupBy(*keys, "_total", "_cell", "_v").agg(F.count("*").alias("_n")))
    ranked = running(ordered(cells, keys, ["_cell", "_v"]), keys, ["_cell", "_v"], {"_up": F.col("_n")})
    picks, missed = [], []
    for name, p in probs.items():
        spot = F.lit(p) * (F.col("_total") - 1)
        for tag, rank in (("lo", F.floor(spot)), ("up", F.ceil(spot))):
            here = (rank < F.col("_up")) & (rank >= F.col("_up") - F.col("_n"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}_{tag}"))
            missed.append(here & F.col("_v").isNull())
    found = ranked.groupBy(*keys).agg(F.first("_total").alias("_total"), F.bool_or(reduce(lambda a, b: a | b, missed)).alias("_missed"), *picks)
    part = {n: F.lit(p) * (F.col("_total") - 1) - F.floor(F.lit(p) * (F.col("_total") - 1)) for n, p in probs.items()}
    return found.select(*keys, "_missed", *[
        (F.col(f"_{n}_lo") + part[n] * (F.col(f"_{n}_up") - F.col(f"_{n}_lo"))).alias(n) for n in probs])


def first_rows(df: DataFrame, order: str, count: int, unique: str | None = None, without: DataFrame | None = None) -> DataFrame:
    """The first ``count`` rows by ``order`` with their number (``_pos``, from 1), by bounded selection.

    With ``unique``, only the first row of each of its values counts, and not if ``without``
    holds the value. A rank sketch of ``order`` bounds the rows that are looked at; they alone
    are made, compared and numbered. If too few of them count, the bound moves up by ranks in
    geometric progression, so the work stays in proportion to the rows that are needed. Rows
    without an order take no part.
    """
    df = df.filter(F.col(order).isNotNull())
    kind, bounds = dict(df.dtypes)[order], []
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp") or kind.startswith("decimal"):
        shares = [4.0 ** -i for i in range(6, 0, -1)]
        n, bounds = df.agg(F.count(order), F.percentile_approx(order, shares, SKETCH)).first()
        bounds = sorted({b for b, share in zip(bounds or [], shares) if share * n >= 2 * count})
    for bound in [*bounds, None]:
        some = df if bound is None else df.filter(F.col(order) <= F.lit(bound))
        if unique is not None:
            # The first holder overall, if it lies below the bound at all.
            some = some.groupBy(unique).agg(F.min(order).alias(order))
            if without is not None:
                some = stage(some)
                taken = stage(without.select(unique).join(some.select(unique), unique, "left_semi").distinct())
                some = some.join(taken, unique, "left_anti")
        some = stage(some)
        if bound is None or some.count() >= count:
            return row_numbers(some, [], [order], "_pos").filter(F.col("_pos") <= count)
