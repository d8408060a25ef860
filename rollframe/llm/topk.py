"""Exact top-k by inner product with one KD-tree per shard.

Vectors are dealt over shards, queries over blocks. A (shard, block) pair is one group: it
builds the shard's tree (median splits on the widest dimension, tight boxes around every
node) and walks it best first for each query. A box bounds the inner product from above by
taking, per dimension, the better end for the query's sign; a node below the k-th score so
far is never opened. Each block first searches its home shard; the k-th scores found there
go along to the other shards, where most boxes then fall short.

Shards hold about ``SHARD_ROWS`` vectors and blocks about ``BLOCK_ROWS`` queries, so a group is
bounded whatever the table's size; groups grow in number. Every vector is compared or ruled
out by a bound: the result is exact.

Defined cases: vectors that are null, or hold null or non-finite components, take no part;
vectors of different length are never compared; every row but the query's own is a candidate,
also rows that share its id or have none; every row with a query's id asks for itself; equal
scores go by smaller id, null ids last; fewer candidates than k give fewer rows. Scores beyond
the range of long are cut to it.
"""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollframe.llm.common import query, staged, table

SHARD_ROWS = 1 << 14
BLOCK_ROWS = 1 << 11
LEAF_ROWS = 128
SCALE = 1024
_LONG = (1 << 63) - 1


class Tree:
    """Median-split tree over whole-number vectors; leaves are ranges of ``order``."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int):
        self.order = np.arange(len(vectors))
        self.low, self.high, self.nodes = [], [], []
        todo = [(0, len(vectors), None)]
        while todo:
            a, b, parent = todo.pop()
            own = vectors[self.order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            at = len(self.nodes)
            self.low.append(low)
            self.high.append(high)
            self.nodes.append([a, b, None, None])
            if parent is not None:
                self.nodes[parent][3 if self.nodes[parent][2] is not None else 2] = at
            wide = int(np.argmax(high - low))
            if b - a > leaf_rows and high[wide] > low[wide]:
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, wide], middle)]
                todo += [(a, a + middle, at), (a + middle, b, at)]
        self.low, self.high = np.array(self.low), np.array(self.high)


def search(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, floors: np.ndarray,
           k: int, leaf_rows: int = LEAF_ROWS) -> tuple[list[int], list[int], list[int]]:
    """The k best candidates of each query at or above its floor: places of query and candidate, scores.

    Equal scores go by id, then by row; a row is no candidate of its own.
    """
    tree = Tree(vectors, leaf_rows)
    ids, rows, vectors = ids[tree.order], rows[tree.order], vectors[tree.order]
    bounds = np.maximum(queries, 0).dot(tree.high.T) + np.minimum(queries, 0).dot(tree.low.T)
    out: tuple[list, list, list] = ([], [], [])
    for i, q in enumerate(queries):
        least, heap = floors[i], [(-bounds[i, 0], 0)]
        scores, names = np.zeros(0, vectors.dtype), np.zeros(0, np.int64)
        while heap and -heap[0][0] >= least:
            a, b, left, right = tree.nodes[heapq.heappop(heap)[1]]
            if left is not None:
                for child in (left, right):
                    if bounds[i, child] >= least:
                        heapq.heappush(heap, (-bounds[i, child], child))
                continue
            got = vectors[a:b].dot(q)
            keep = np.flatnonzero((got >= least) & (rows[a:b] != query_rows[i]))
            if len(keep):
                scores, names = np.concatenate([scores, got[keep]]), np.concatenate([names, a + keep])
                best = np.lexsort((rows[names], ids[names], -scores))[:k]
                scores, names = scores[best], names[best]
                if len(best) == k:
                    least = max(least, scores[-1])
        out[0].extend([i] * len(names))
        out[1].extend(tree.order[names].tolist())
        out[2].extend(int(min(max(s, -_LONG - 1), _LONG)) for s in scores)
    return out


def whole(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Arrow lists of one length as rows of floor(scale * x)."""
    lists = column.combine_chunks()
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return flat.reshape(len(lists), -1)


def _pairs(vectors: DataFrame, queries: DataFrame, shards: int, blocks: int, home: bool, k: int, leaf_rows: int, scale: int) -> DataFrame:
    """Search the home pairs, or all the others."""
    def side(df: DataFrame, own: str, other: str, n: int) -> DataFrame:
        at_home = F.pmod("block", F.lit(shards)) == F.col("shard")
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).filter(at_home if home else ~at_home)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left.num_rows and right.num_rows and key[0].as_py():
            v, q = whole(left.column("embedding"), scale), whole(right.column("probe"), scale)
            if np.abs(v).max() * np.abs(q).max() * v.shape[1] >= 2.0**53:
                v, q = (np.array([[int(x) for x in r] for r in m.tolist()], object) for m in (v, q))
            floors = [-float("inf") if f is None else f for f in right.column("floor").to_pylist()]
            ids = pc.fill_null(left.column("vec_id"), _LONG).to_numpy()  # null ids come last
            found = search(ids, left.column("row").to_numpy(), v, right.column("query_row").to_numpy(), q, floors, k, leaf_rows)
        at, of, score = (pa.array(r, pa.int64()) for r in found)
        return pa.table({"query_row": right.column("query_row").take(at), "query_id": right.column("query_id").take(at),
                         "row": left.column("row").take(of), "vec_id": left.column("vec_id").take(of), "score": score})

    # Other names on the query side, as both sides come from one table.
    asking = side(queries, "block", "shard", shards).select(
        F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard"), F.col("block").alias("q_block"), F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"),
        F.col("embedding").alias("probe"), "floor")
    return (side(vectors, "shard", "block", blocks).groupBy("dim", "shard", "block")
            .cogroup(asking.groupBy("q_dim", "q_shard", "q_block"))
            .applyInArrow(run, "query_row long, query_id long, row long, vec_id long, score long"))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, shard_rows: int = SHARD_ROWS,
                block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query row."""
    one = "exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    base = staged(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(f"embedding is not null and not {one}")
                  .withColumn("dim", F.size("embedding")).withColumn("asks", F.coalesce(is_query, F.lit(False))).withColumn("row", F.monotonically_increasing_id()))
    n, asking = base.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, ceil(n / shard_rows)), max(1, ceil(asking / block_rows))
    candidates = base.select("row", "vec_id", "embedding", "dim", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))
    asked = base.filter("asks").select("row", "vec_id", "embedding", "dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    first = staged(_pairs(candidates, asked.withColumn("floor", F.lit(None).cast("long")), shards, blocks, True, k, leaf_rows, scale))
    found = first
    if shards > 1:
        reached = first.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        found = first.unionByName(_pairs(candidates, asked.join(reached, "row", "left"), shards, blocks, False, k, leaf_rows, scale))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.r <> q.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 10"""


@query("op7_exact_top_k", SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return exact_top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)
