"""Rollout-shaped views over the given tables, each with its SQL twin.

Ids inside customers and orders need an order, so ``turns`` is built with the ordered
helpers and staged once per session; everything else is a plain projection or join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollframe.distributed import has_hot_key, ordered, running
from rollframe.operators.trajectories import assign_ids
from rollframe.plans.catalog import table
from rollframe.session import stage

_staged: dict[tuple[str, str, str], DataFrame] = {}

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
              "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def once(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Stage a derived table the first time a session asks for it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _staged:
        _staged[key] = stage(build())
    return _staged[key]


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line item: an order is a trajectory, a customer is a group."""
    def build() -> DataFrame:
        lines = table(spark, sf, "lineitem").select("l_orderkey", *LINE_ORDER)
        orders = table(spark, sf, "orders").select(
            "o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("traj_success"),
            F.col("o_orderpriority").alias("run"), F.year("o_orderdate").alias("step"))
        if has_hot_key(lines, ["l_orderkey"]):
            length = lines.groupBy(F.col("l_orderkey").alias("_key")).agg(F.count("*").alias("_len"))
            numbered = running(ordered(lines, ["l_orderkey"], LINE_ORDER), ["l_orderkey"], LINE_ORDER, {"turn_idx": F.lit(1)})
            numbered = numbered.join(length, F.col("l_orderkey") == F.col("_key")).withColumn("last_turn", F.col("turn_idx") == F.col("_len"))
        else:
            own = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
            numbered = lines.withColumns({"turn_idx": F.row_number().over(own), "last_turn": F.lead(F.lit(1)).over(own).isNull()})
        with_lines = orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
        tasks = assign_ids(with_lines, "o_custkey", ["o_orderkey"], within=orders)
        return numbered.join(tasks, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").cast("string").alias("group_idx"),
            F.col("traj_idx"),
            F.col("turn_idx").cast("int").alias("turn_idx"),
            F.col("o_orderkey").alias("uid"),
            F.col("l_discount").alias("score"),
            F.col("l_tax").alias("value"),
            F.col("l_quantity").cast("int").alias("tokens"),
            F.col("traj_success"),
            F.col("last_turn"),
            F.col("l_returnflag").alias("output"),
            F.date_format("l_shipdate", "yyyy-MM").alias("state_anchor"),
            F.col("run"),
            F.col("step"),
            (F.col("l_partkey") % 7 == 0).alias("copied"),
            F.col("l_partkey").alias("row_key"),
            (F.col("l_linestatus") == "O").alias("action_is_valid"),
            F.col("l_linenumber").alias("raw_turn"),
        )
    return once(spark, sf, "turns", build)


TURNS = """turns AS (
  SELECT CAST(o_custkey AS VARCHAR) AS group_idx,
         CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS traj_idx,
         CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
              l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INTEGER) AS turn_idx,
         o_orderkey AS uid, l_discount AS score, l_tax AS value, CAST(l_quantity AS INTEGER) AS tokens,
         o_orderstatus = 'F' AS traj_success, l_returnflag AS output,
         strftime(l_shipdate, '%Y-%m') AS state_anchor, o_orderpriority AS run,
         CAST(year(o_orderdate) AS INTEGER) AS step, l_partkey % 7 = 0 AS copied, l_partkey AS row_key,
         l_linestatus = 'O' AS action_is_valid, l_linenumber AS raw_turn,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
              l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus)
           = count(*) OVER (PARTITION BY o_orderkey) AS last_turn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def turns_padded(spark: SparkSession, sf: str) -> DataFrame:
    """``turns`` plus an exact copy of every row flagged ``copied``."""
    base = turns(spark, sf)
    return base.withColumn("copy_no", F.lit(0)).unionByName(
        base.filter("copied").withColumn("copy_no", F.lit(1)))


PADDED = TURNS + """, padded AS (
  SELECT *, 0 AS copy_no FROM turns UNION ALL SELECT *, 1 AS copy_no FROM turns WHERE copied)"""

# A trajectory table straight from the turns, used by most group queries.
TRAJ = TURNS + """, traj AS (
  SELECT group_idx, traj_idx, min(uid) AS uid, min(run) AS run, min(step) AS step,
         sum(score) AS reward, count(*) AS turns, bool_or(traj_success) AS success, sum(tokens) AS tokens
  FROM turns GROUP BY 1, 2)"""


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order; orders without lines are episodes of zero turns."""
    def build() -> DataFrame:
        lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
            F.count("*").alias("n"), F.sum("l_discount").alias("reward"),
            F.sum((F.col("l_linestatus") == "O").cast("int")).alias("ok"))
        orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
        return (orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
                .join(customers, orders.o_custkey == customers.c_custkey, "left")
                .select(
                    F.concat(F.lit("ep"), F.col("o_orderkey").cast("string")).alias("rollout_id"),
                    F.col("o_orderkey").alias("episode"),
                    F.coalesce("c_mktsegment", F.lit("none")).alias("environment"),
                    F.col("o_orderpriority").alias("method"),
                    (F.col("o_orderkey") % 3).alias("seed"),
                    F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "max_turns")
                    .otherwise("env_error").alias("finish_reason"),
                    (F.col("o_orderstatus") == "F").alias("success"),
                    F.coalesce("n", F.lit(0)).cast("int").alias("num_turns"),
                    F.coalesce("reward", F.lit(0.0)).alias("cumulative_reward"),
                    F.coalesce("n", F.lit(0)).alias("action_check_count"),
                    F.coalesce("ok", F.lit(0)).alias("valid_action_count"),
                    F.element_at(F.array(F.lit("none"), F.lit("remove"), F.lit("shuffle_tiles")),
                                 (F.col("o_orderkey") % 3 + 1).cast("int")).alias("observation_ablation"),
                    F.year("o_orderdate").alias("step"),
                ))
    return once(spark, sf, "episodes", build)


EPISODES = """episodes AS (
  SELECT concat('ep', o_orderkey) AS rollout_id, o_orderkey AS episode, coalesce(c_mktsegment, 'none') AS environment,
         o_orderpriority AS method, o_orderkey % 3 AS seed,
         CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'max_turns' ELSE 'env_error' END AS finish_reason,
         o_orderstatus = 'F' AS success, CAST(coalesce(n, 0) AS INTEGER) AS num_turns,
         coalesce(reward, 0.0) AS cumulative_reward, CAST(coalesce(n, 0) AS BIGINT) AS action_check_count,
         CAST(coalesce(ok, 0) AS BIGINT) AS valid_action_count,
         ['none', 'remove', 'shuffle_tiles'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS observation_ablation,
         CAST(year(o_orderdate) AS INTEGER) AS step
  FROM orders
  LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_discount) AS reward,
                    sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS ok
             FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey)"""


def gpu_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Events as device samples: eight devices, power missing on error events."""
    return table(spark, sf, "events").select(
        (F.col("user_id") % 5).cast("string").alias("run"),
        (F.col("user_id") % 8).cast("int").alias("gpu_index"),
        F.concat(F.lit("device "), (F.col("user_id") % 2).cast("string")).alias("gpu_name"),
        F.col("event_id").alias("sample"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").cast("double").alias("elapsed_seconds"),
        F.col("ts"),
        (F.col("value") * 10).alias("memory_used_mib"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("utilization_percent"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("power_watts"))


GPU = """gpu AS (
  SELECT CAST(user_id % 5 AS VARCHAR) AS run, CAST(user_id % 8 AS INTEGER) AS gpu_index,
         concat('device ', user_id % 2) AS gpu_name, event_id AS sample,
         CAST(floor(epoch(ts)) AS DOUBLE) AS elapsed_seconds, ts,
         value * 10 AS memory_used_mib,
         CASE WHEN event_type <> 'view' THEN value END AS utilization_percent,
         CASE WHEN event_type <> 'error' THEN value END AS power_watts
  FROM events)"""


def token_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as token arrays; the mask drops every third position, the label shifts it."""
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("group_idx"),
        F.col("vec_id").alias("traj_idx"),
        F.lit(1).alias("turn_idx"),
        F.col("embedding").alias("token_level_rewards"),
        F.transform("embedding", lambda x, i: ((i + F.col("label")) % 3 != 0).cast("int")).alias("response_mask"),
        F.transform("embedding", lambda x, i: F.when((i >= 4) & (i < 60), (x.cast("float") * F.lit(100).cast("float")).cast("int")).otherwise(0))
        .alias("responses"))


TOK = """tok AS (
  SELECT CAST(label AS VARCHAR) AS group_idx, vec_id AS traj_idx, CAST(x AS DOUBLE) AS x, i,
         CASE WHEN (i - 1 + label) % 3 <> 0 THEN 1 ELSE 0 END AS m
  FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"""
