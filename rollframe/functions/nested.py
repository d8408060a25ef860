"""Search in JSON of unknown shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollframe.session import stage


#: Levels opened in one plan; deeper documents are written in between.
LEVELS = 12


def depth(document: str) -> Column:
    """How deep the brackets of a JSON text nest."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(document, r"\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]+", "")
    walk = F.aggregate(
        F.split(bare, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"),
                              F.greatest(a["top"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("top")),
        lambda a: a["top"])
    return F.coalesce(walk, F.lit(0))


def _rounds(rows: DataFrame, state: DataFrame, document: str, step) -> DataFrame:
    """Open the documents level by level, as deep as the deepest one goes."""
    left = rows.agg(F.max(depth(document))).first()[0] or 0
    while left > 0:
        for _ in range(min(left, LEVELS)):
            state = step(state)
        left -= LEVELS
        if left > 0:  # a long plan is cut; variants travel as text
            held = stage(state.withColumn("v", F.to_json("v")))
            state = held.withColumn("v", F.try_parse_json("v"))
    return state


def nested_values(rows: DataFrame, keys: list[str], document: str, name: str) -> DataFrame:
    """Every value stored under ``name`` at any depth of a JSON document, as text.

    The deepest nesting is measured first. Each round opens one level with
    ``variant_explode`` and lets finished values pass through. Text that is not JSON has no
    values.
    """
    spark = rows.sparkSession

    def step(state: DataFrame) -> DataFrame:
        opened = state.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()).select(
            F.col("key").alias("_k"), F.col("value").alias("_v")))
        hit = F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("_k") == name, F.col("_v").cast("string"))
        container = F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)")
        nothing = F.lit(None).cast("string")
        steps = F.array(
            F.struct(hit.alias("value"), F.parse_json(nothing).alias("v")),
            F.struct(nothing.alias("value"), F.when(container, F.col("_v")).alias("v")))
        live = F.filter(steps, lambda s: s["value"].isNotNull() | s["v"].isNotNull())
        return opened.select(*keys, F.inline(live))
    state = rows.select(*keys, F.lit(None).cast("string").alias("value"), F.try_parse_json(document).alias("v"))
    return _rounds(rows, state, document, step).filter("value IS NOT NULL").select(*keys, "value")


def flatten_documents(rows: DataFrame, keys: list[str], document: str) -> DataFrame:
    """Leaves of JSON documents as (path, number, text); list items get their place in the path."""
    spark = rows.sparkSession

    def step(state: DataFrame) -> DataFrame:
        open_ = F.when(~F.col("leaf"), F.col("v"))
        opened = state.lateralJoin(spark.tvf.variant_explode_outer(open_.outer()).select(
            F.col("pos").alias("_i"), F.col("key").alias("_k"), F.col("value").alias("_v")))
        place = F.when(F.col("_k").isNotNull(), F.concat(F.when(F.col("path") == "", "").otherwise("."), F.col("_k"))).otherwise(
            F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("]")))
        container = F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)")
        return opened.select(
            *keys, F.when(F.col("leaf"), F.col("path")).otherwise(F.concat("path", place)).alias("path"),
            F.when(F.col("leaf"), F.col("v")).otherwise(F.col("_v")).alias("v"),
            (F.col("leaf") | ~F.coalesce(container, F.lit(False))).alias("leaf"))
    state = rows.select(*keys, F.lit("").alias("path"), F.try_parse_json(document).alias("v"), F.lit(False).alias("leaf"))
    text = F.col("v").cast("string")
    return _rounds(rows, state, document, step).filter("path IS NOT NULL AND leaf").select(
        *keys, "path", text.try_cast("double").alias("number"), text.alias("text"))


def average_documents(rows: DataFrame, keys: list[str], document: str) -> DataFrame:
    """Mean of every numeric leaf per path over documents; other leaves keep one value."""
    return flatten_documents(rows, keys, document).groupBy(*keys, "path").agg(
        F.avg("number").alias("mean"), F.count("number").alias("n"), F.min("text").alias("sample_text"))
