"""Line dedup with levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without ASCII blanks at its ends, with A-Z lower-cased. A key of at
least ``MIN_CHARS`` code points that occurs in at least ``MIN_DOCS`` documents keeps its lines
in the largest doc_id that holds it and loses them everywhere else.

1. Texts are scanned once. What is written is 12 bytes a line: two hashes of its key (96 bits).
2. Documents arrive in ``BATCHES`` ranges of descending doc_id. The keys of a batch are counted
   first (a key that half of all documents hold costs one row per task), then merge-anti-joined
   with every run of the index. What no run knows is seen for the first time, so its largest
   doc_id is in this batch; it becomes a run of level 0.
3. ``FANOUT`` runs of a level are compacted into one run of the next. Runs are tables bucketed and
   sorted by hash in the shared folder: joining a batch to them does not shuffle them again.
4. Counts of all batches tell the frequent keys, the runs tell who keeps them. Lines are looked
   up by hash, and the places to drop, at most the lines of one text, go back to the texts.

The index grows with the distinct lines; a batch is a share of the table, never one task's work.

Defined cases: a null or empty text is one empty line; every row is a document, also if rows
repeat or share a doc_id, and all rows of the largest doc_id keep a line; a null doc_id is one
id, before all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe.llm.common import NO_ID, key_of, query, staged, table
from rollframe.session import stage_path

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
KEY = ["h", "g"]
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(line: Column) -> Column:
    """A-Z in lower case; the engine's own ``lower`` does that where there is ASCII only."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Per line the two hashes of its key, null for a key that is too short."""
    bare = F.transform(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))
    keys = F.transform(bare, lambda line: F.when(F.length(line) >= min_chars, folded(line)))
    return F.transform(keys, lambda k: F.when(k.isNotNull(), F.struct(F.xxhash64(k).alias("h"), F.hash(k).alias("g"))))


def _named(docs: DataFrame) -> DataFrame:
    """doc (null ids before all others), text, and what tells texts of one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(key_of("doc_id").alias("doc"), text.alias("text"), F.xxhash64(text).alias("fp"), F.hash(text).alias("gp"))


class LineIndex:
    """Runs by level. Every key is in one run at most, with the document that keeps it."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.tables: list[str] = []

    def write(self, rows: DataFrame) -> str:
        """A table bucketed and sorted by hash, kept in the shared folder."""
        name = f"rollframe_lines_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", stage_path(self.spark, "llm")).saveAsTable(name)
        self.tables.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, arrived: DataFrame) -> DataFrame:
        """Take in the counted keys (h, g, n, keeper) of a batch; returns those not known before."""
        new = arrived
        for run in self.runs():
            new = new.join(run, KEY, "left_anti")
        first = name = self.write(new.select(*KEY, "keeper"))
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return self.spark.table(first)
            name = self.write(self._union(self.levels[level]).repartition(self.buckets, *KEY))
            self.levels[level] = []
            level += 1

    def _union(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def keepers(self, keys: DataFrame) -> DataFrame:
        """``keys`` with the document that keeps each."""
        found = [keys.join(run, KEY) for run in self.runs()]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def close(self) -> None:
        """Forget the tables; their files are staged ones."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _batches(docs: DataFrame, count: int) -> Column:
    """Number of the batch of ``doc``: 0 has the largest ids. Equal ids share a batch."""
    borders = docs.agg(F.percentile_approx("doc", [i / count for i in range(1, count)], 1000).alias("q")).first().q if count > 1 else []
    return sum((F.col("doc") <= F.lit(b)).cast("int") for b in sorted(set(borders or []))) + F.lit(0)


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc, fp, gp and the places (from 0) of the lines to drop, for the texts that lose any."""
    spark = docs.sparkSession
    named = _named(docs)
    path = stage_path(spark, "llm")
    scanned = named.select("doc", "fp", "gp", line_hashes(F.col("text"), min_chars).alias("keys"), _batches(named, batches).alias("batch"))
    scanned.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    lines = spark.read.schema(scanned.schema).parquet(path)
    index, arrivals = LineIndex(spark, fanout), []
    try:
        for batch in range(batches):
            own = lines.filter(F.col("batch") == batch).select("doc", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("k"))
            counted = own.select("doc", "k.h", "k.g").groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
            arrivals.append(index.write(counted))
            index.add(spark.table(arrivals[-1]))
        counts = index._union(arrivals).groupBy(*KEY).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)
        frequent = staged(index.keepers(counts.select(*KEY)))
    finally:
        index.close()
    places = lines.select("doc", "fp", "gp", F.posexplode("keys").alias("pos", "k")).filter("k IS NOT NULL").select("doc", "fp", "gp", "pos", "k.h", "k.g")
    return (places.join(frequent, KEY).filter("doc <> keeper").groupBy("doc", "fp", "gp").agg(F.collect_set("pos").alias("drop")))


def drop_repeated_lines(docs: DataFrame, **limits) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, and the text of the lines that stay."""
    drop = staged(repeated_lines(docs, **limits))
    named = _named(docs)
    rows = named.join(drop, ["doc", "fp", "gp"], "left")
    # The split text is bound to a variable, so it is made once per text.
    kept = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "drop"), lambda i: F.get(lines, i)), "\n"))
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return rows.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), (breaks + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept[0]).alias("text"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, coalesce(doc_id, {NO_ID}) AS doc, i, lines[i] AS line,
        translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k
      FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
f AS (SELECT k, max(doc) AS keeper FROM (SELECT DISTINCT r, doc, k FROM l WHERE length(k) >= {MIN_CHARS}) GROUP BY k HAVING count(*) >= {MIN_DOCS}),
m AS (SELECT l.*, coalesce(doc <> keeper, false) AS gone FROM l LEFT JOIN f USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r"""


@query("op12_line_dedup", ORACLE)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
