"""Connected components of an edge table, by alternating stars, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollframe.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``root`` for every end of ``edges(a, b)``; the root is the component's smallest id.

    Large-star links every larger neighbour of a node to the node's smallest neighbour;
    small-star does so for the smaller ones. The edges end as stars around the roots after a
    number of rounds that grows with the logarithm of a component's diameter. A hub costs one
    partial minimum per task, and the join back to its edges can be split.
    """
    links = staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.explode(F.array("u", "v")).alias("b"), F.col("m").alias("a")).filter("a <> b")
        links = staged(small.select("a", "b").distinct())
        after = links.agg(F.count("*"), F.sum("a"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if after == before:
            break
        before = after
    return links.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(
        links.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
