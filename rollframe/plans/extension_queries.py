"""Queries through the extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe import registry
from rollframe.functions import scoring
from rollframe.operators import contracts, credit
from rollframe.plans import views
from rollframe.plans.catalog import query, r6, table
from rollframe.plans.trajectory_queries import GAE, GROUPS, SCORES, WHOLE, cut_rollouts, trajectory_rewards


@query("GRP6", f"WITH {GROUPS} SELECT 'custom_metrics/reward_variance' AS metric, {r6('coalesce(avg(variance), 0)')} AS metric_value FROM gv")
def grp6(spark, sf):
    return registry.all_metrics(trajectory_rewards(spark, sf))


@query("EXT1", f"""WITH {GROUPS}, kept AS (SELECT * FROM ranked WHERE total <= 0 OR rank = 1 OR mass - variance < 0.5 * total - 1e-12)
SELECT group_idx, traj_idx, {r6('reward * sqrt((SELECT count(*) FROM kept) / (SELECT count(*) FROM gv))')} AS advantage FROM traj WHERE group_idx IN (SELECT group_idx FROM kept)""")
def ext1(spark, sf):
    rows = trajectory_rewards(spark, sf).withColumn("advantage", F.col("reward"))
    out, _ = registry.filters.get("reward_variance_top_p")(rows, top_p=0.5)
    return out.select("group_idx", "traj_idx", "advantage")


@query("EXT2", f"WITH {GROUPS}, g1 AS (SELECT coalesce(var_samp(reward), 0) AS v FROM traj GROUP BY group_idx) SELECT {r6('avg(v)')} AS reward_variance FROM g1")
def ext2(spark, sf):
    return registry.metrics.get("reward_variance")(trajectory_rewards(spark, sf), ddof=1)


@query("EXT2_fused", f"""WITH {views.TRAJ}, a AS (SELECT run, avg(reward) AS mean_reward, max(turns) AS longest, count(*) FILTER (success) / count(*) AS solved FROM traj GROUP BY 1)
SELECT run, concat('own/', name) AS metric, {r6('value')} AS metric_value FROM (SELECT run, 'mean_reward' AS name, mean_reward AS value FROM a UNION ALL SELECT run, 'longest', longest FROM a UNION ALL SELECT run, 'solved', solved FROM a)""")
def ext2_fused(spark, sf):
    own = registry.Registry("metric")
    own.register("mean_reward")(lambda rows: F.avg("reward"))
    own.register("longest")(lambda rows: F.max("turns"))
    own.register("solved")(lambda rows: F.avg(F.col("success").cast("double")))
    own.register("broken")(lambda rows: F.sum("no_such_column"))
    per = views.turns(spark, sf).groupBy("run", *credit.TRAJECTORY).agg(
        F.sum("score").alias("reward"), F.count("*").alias("turns"), F.bool_or("traj_success").alias("success"))
    return registry.all_metrics(per, "own", ["run"], own)


@query("EXT3", "WITH " + SCORES + WHOLE + f"""
, g AS (SELECT group_idx, avg(outcome) AS m, stddev_pop(outcome) AS s FROM scored GROUP BY 1)
SELECT group_idx, traj_idx, turn_idx, CAST(copy_no AS BIGINT) AS copy_no, {r6('CASE WHEN s <= 1e-6 THEN 0.0 ELSE (outcome - m) / s END')} AS advantage
FROM (SELECT *, 0 AS copy_no FROM left_ UNION ALL SELECT *, 1 FROM left_ WHERE copied) p JOIN scored USING (group_idx, traj_idx) JOIN g USING (group_idx) JOIN ok USING (group_idx)""")
def ext3(spark, sf):
    out = registry.estimators.get("no_concat_episode_grpo")(cut_rollouts(spark, sf))
    return out.select("group_idx", "traj_idx", "turn_idx", F.col("copy_no").cast("long"), "advantage")


@query("EXT3_gae", "WITH " + GAE + f"""
, s AS (SELECT sum(tokens) AS n, sum(tokens * advantage) / sum(tokens) AS mu FROM gae)
, v AS (SELECT sum(tokens * (advantage - s.mu) * (advantage - s.mu)) / (any_value(s.n) - 1) AS var FROM gae, s)
SELECT p.group_idx, p.traj_idx, p.turn_idx, CAST(copy_no AS BIGINT) AS copy_no, {r6('(gae.advantage - s.mu) / sqrt(v.var + 1e-8)')} AS advantage
FROM (SELECT *, 0 AS copy_no FROM turns UNION ALL SELECT *, 1 FROM turns WHERE copied) p
JOIN gae ON p.group_idx = gae.group_idx AND p.traj_idx = gae.traj_idx AND p.turn_idx = gae.turn_idx, s, v""")
def ext3_gae(spark, sf):
    out = registry.estimators.get("no_concat_gae")(views.turns_padded(spark, sf), gamma=0.99, lam=0.95)
    return out.select(*credit.KEY, F.col("copy_no").cast("long"), "advantage")


@query("EXT4", f"SELECT event_id, {r6('CASE WHEN event_id % 2 = 0 THEN length(event_type) ELSE 1 END')} AS score FROM events")
def ext4(spark, sf):
    own = {**scoring.EVALUATORS, "length": lambda p, a: F.length(p).cast("double")}
    task = F.when(F.col("event_id") % 2 == 0, "length").otherwise("RotEvaluationTask")
    return table(spark, sf, "events").select("event_id", scoring.score(task, F.col("event_type"), F.col("event_type"), own).alias("score"))


@query("EXT5", "SELECT o_custkey % 7 AS grp, CAST(sum(o_orderkey % 6 + 1) AS BIGINT) AS tasks FROM orders GROUP BY 1")
def ext5(spark, sf):
    specs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("spec_idx"), (F.col("o_orderkey") % 6 + 1).alias("n_envs"),
                                              F.array(F.col("o_custkey")).alias("seed"), F.lit(None).cast("array<bigint>").alias("seed_list"))
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("spec_idx"), (F.col("o_custkey") % 7).alias("grp"))
    return contracts.expand_tasks(specs).join(owner, "spec_idx").groupBy("grp").agg(F.count("*").alias("tasks"))


@query("EXT5_table", "SELECT o_custkey % 7 AS grp, CAST(slot AS INTEGER) AS slot, CAST(count(*) AS BIGINT) AS tasks FROM (SELECT o_custkey, unnest(range(0, o_orderkey % 6 + 1)) AS slot FROM orders) GROUP BY 1, 2")
def ext5_table(spark, sf):
    specs = table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("grp"), (F.col("o_orderkey") % 6 + 1).alias("n_envs"))
    return registry.expand_rows(specs, "slots", "n_envs").groupBy("grp", "slot").agg(F.count("*").alias("tasks"))
