"""Source divergence audit: smoothed term shares of every source against all others of its language.

1. Terms are counted where the texts are: a task adds up its own counts per (language, source,
   term) in bounded tables and hands on partial rows. Terms in at least ``MIN_DOCS`` documents of
   a language are kept and numbered in the order of their bytes.
2. Every source's counts become arrays of (term id, count) sorted by id, one per block of
   ``BLOCK`` ids, so no array grows with the vocabulary. A source without terms in a block has
   empty arrays there.
3. One task per unordered pair of tiles of ``TILE`` sources and block: the two tiles' arrays are
   co-grouped and every unordered pair of sources in them is merged. The shorter array gallops
   through the longer one; common terms are priced by both counts, one-sided terms against the
   other source's price of an absent term, and terms of neither by the two absent prices.
   Partial sums of the blocks are added up.
4. Terms that stand out in a source are its ``TOP`` largest surpluses over its language.

The price of a count is 1 + floor(10**9 * (count + 5) / (N + 5 V)), in whole numbers; exact as
long as N + 5 V stays below 9.2 * 10**15.

Defined cases: null text, language and source are empty; a repeated row counts as a document of
its own; a source without terms has count 0 for all; a language that keeps no term has pairs of
value 0 and no terms; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollframe.distributed import row_numbers
from rollframe.llm.common import query, small_batches, staged, table
from rollframe.llm.words import slices

MIN_DOCS = 30
TOP = 50
SMOOTH = 5
BLOCK = 1 << 15
TILE = 16
#: Rows a task holds before it hands on its partial counts, and bytes of a text taken at once.
HELD = 1 << 17
PIECE = 1 << 20
#: Needles that start from one bisected place.
RUN = 32
#: Bytes of terms: letters, A-Z in lower case, and everything outside ASCII; others part terms.
_CLEAN = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of it at a time."""
    clean, at = text.translate(_CLEAN), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (occurrences, documents) per language, source and term."""
    number: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def flush():
        for (lang, source), own in number.items():
            have = docs[lang, source]
            names = list(own)
            for a in range(0, len(names), 10_000):
                part = names[a: a + 10_000]
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar(lang, pa.string()), len(part)), pa.repeat(pa.scalar(source, pa.string()), len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array(list(map(own.__getitem__, part)), pa.int64()), pa.array(list(map(have.__getitem__, part)), pa.int64())], schema=_COUNTS)
        number.clear()
        docs.clear()

    for piece in slices(batches):
        texts = piece.column("text").cast(pa.binary()).to_pylist()
        for lang, source, text in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), texts):
            own, have = number.setdefault((lang, source), Counter()), docs.setdefault((lang, source), Counter())
            seen: set[bytes] = set()
            for terms in terms_of(text):
                own.update(terms)
                seen.update(terms)
            have.update(seen)
        if sum(map(len, number.values())) > HELD:
            yield from flush()
    yield from flush()


def price(count: str, total: str, kept: str) -> Column:
    """The price of a count, in whole numbers: a long division, three digits at a time."""
    whole, rest, out = f"({total} + {SMOOTH} * {kept})", f"({count} + {SMOOTH})", "0L"
    for _ in range(3):
        out, rest = f"({out} * 1000 + {rest} * 1000 div {whole})", f"({rest} * 1000 % {whole})"
    return F.expr(f"{out} + 1")


def prices(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """As :func:`price`, of an array; 0 where the language keeps no term."""
    whole = total + SMOOTH * kept
    rest, out = counts.astype(np.int64) + SMOOTH, np.zeros(len(counts), np.int64)
    if not whole:
        return out
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return out + 1


def gallop(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """First place in ``hay`` not below each needle; both ascend.

    The first needle of each run is found by bisection; the others start there, double their
    step until they are beyond their place, and halve it again.
    """
    low = np.repeat(np.searchsorted(hay, needles[::RUN]), RUN)[: len(needles)]
    high, step = low.copy(), 1
    going = np.flatnonzero(high < len(hay))
    going = going[hay[high[going]] < needles[going]]
    while len(going):
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step, len(hay))
        step *= 2
        going = going[high[going] < len(hay)]
        going = going[hay[high[going]] < needles[going]]
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) >> 1
        below = hay[middle] < needles[going]
        low[going[below]] = middle[below] + 1
        high[going[~below]] = middle[~below]
        going = going[low[going] < high[going]]
    return low


def merge(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], terms: int) -> int:
    """Sum of price differences over ``terms`` ids; a side is (ids, prices, price of an absent term)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (short, p, p0), (long, q, q0) = a, b
    at = gallop(short, long)
    hit = at < len(long)
    hit[hit] = long[at[hit]] == short[hit]
    alone = np.ones(len(long), bool)
    alone[at[hit]] = False
    absent = terms - len(short) - int(alone.sum())
    return (int(np.abs(p[hit] - q[at[hit]]).sum()) + int(np.abs(p[~hit] - q0).sum())
            + int(np.abs(q[alone] - p0).sum()) + absent * abs(int(p0) - int(q0)))


def _tile(rows: pa.Table) -> list[tuple[str, tuple]]:
    out = []
    for r in rows.select(["source", "total", "kept", "ids", "counts"]).to_batches(max_chunksize=1):
        ids, counts = (np.asarray(r.column(c)[0].values.to_numpy(zero_copy_only=False), np.int64) for c in ("ids", "counts"))
        total, kept = r.column("total")[0].as_py(), r.column("kept")[0].as_py()
        out.append((r.column("source")[0].as_py(), (ids, prices(counts, total, kept), int(prices(np.zeros(1), total, kept)[0]))))
    return out


def compare_tiles(left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial sums of every unordered pair of sources of two tiles, in one block of terms."""
    one = left.slice(0, 1).to_pylist()[0]
    same, rows = one["i"] == one["j"], []
    others = _tile(right)
    for name, mine in _tile(left):
        rows += [(name, other, merge(mine, its, one["terms"])) for other, its in others if not same or name < other]
    return pa.table({"lang": pa.array([one["lang"]] * len(rows), pa.string()), "a": pa.array([r[0] for r in rows], pa.string()),
                     "b": pa.array([r[1] for r in rows], pa.string()), "value": pa.array([r[2] for r in rows], pa.int64())})


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank; ``block`` and ``tile`` only deal the work."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    small_batches(docs.sparkSession)
    # A task has added up what it could: its rows are dealt as they are, and added where they meet.
    counts = staged(plain.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
                    .repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs)
    vocabulary = staged(row_numbers(kept.select("lang", "term", "lang_n"), ["lang"], ["term"], "id"))
    own = staged(counts.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]))

    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = plain.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept", "lang_total", "total")])
    groups = staged(row_numbers(groups, ["lang"], ["source"], "place").withColumn("tile", F.floor((F.col("place") - 1) / tile)))

    priced = own.join(groups.select("lang", "source", "kept", "lang_total", "total"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), (price("n", "total", "kept") - price("lang_n", "lang_total", "kept")).alias("value"))
    terms = _ranked(priced.filter("value > 0"), top)

    arrays = own.groupBy("lang", "source", F.floor((F.col("id") - 1) / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("have"))
    tiles = groups.groupBy("lang").agg(F.max("tile").alias("last"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("kept") / block) - 1, F.lit(0).cast("long"))))
    empty = F.array().cast("array<bigint>")
    vectors = staged(groups.join(tiles, "lang").withColumn("block", blocks).join(arrays, ["lang", "source", "block"], "left").select(
        "lang", "source", "kept", "total", "tile", "last", "block", F.least(F.lit(block).cast("long"), F.col("kept") - F.col("block") * block).alias("terms"), F.coalesce("have.id", empty).alias("ids"), F.coalesce("have.n", empty).alias("counts")))
    keys = ["lang", "i", "j", "block"]
    left = vectors.withColumn("i", F.col("tile")).withColumn("j", F.explode(F.sequence("tile", "last")))
    right = vectors.withColumn("j", F.col("tile")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "tile")))
    wanted = [*keys, "source", "kept", "total", "terms", "ids", "counts"]
    merged = left.select(wanted).groupBy(*keys).cogroup(right.select(wanted).groupBy(*keys)).applyInArrow(
        compare_tiles, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = merged.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p"), "value")
    pairs = _ranked(both.select("lang", "p.*", "value"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + {SMOOTH})) // (g.total + {SMOOTH} * v) AS p,
        1 + (CAST(1000000000 AS HUGEINT) * (k.n + {SMOOTH})) // (v.total + {SMOOTH} * v) AS q
      FROM g JOIN v ON g.lang = v.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM r WHERE part = 'pair' OR k <= {TOP}"""


@query("op11_source_divergence", ORACLE)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return audit(table(spark, sf, "documents"))
