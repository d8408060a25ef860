"""Device and latency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.operators import resources as R
from rollframe.plans import views
from rollframe.plans.catalog import query, r6, table

ENERGY = views.GPU + """, lagged AS (SELECT *, lag(elapsed_seconds) OVER w AS t0, lag(power_watts) OVER w AS p0 FROM gpu WINDOW w AS (PARTITION BY run, gpu_index ORDER BY elapsed_seconds, sample))
, en AS (SELECT run, gpu_index, sum((power_watts + p0) / 2 * (elapsed_seconds - t0) / 3600) / 1000 AS kwh FROM lagged GROUP BY 1, 2)"""


@query("RES1", f"""WITH {views.GPU} SELECT run, gpu_index, arg_min(gpu_name, elapsed_seconds * 1000000.0 + sample) AS gpu_name, {r6('max(memory_used_mib)')} AS peak_vram_mib,
  {r6('avg(utilization_percent)')} AS mean_utilization, CAST(count(*) AS BIGINT) AS samples FROM gpu GROUP BY 1, 2""")
def res1(spark, sf):
    return R.device_summary(views.gpu_samples(spark, sf))


@query("RES2", f"WITH {ENERGY} SELECT run, gpu_index, {r6('kwh')} AS energy_kwh FROM en")
def res2(spark, sf):
    return R.device_energy(views.gpu_samples(spark, sf))


@query("RES3", f"""WITH {ENERGY}, d AS (SELECT run, max(elapsed_seconds) - min(elapsed_seconds) AS s FROM gpu GROUP BY 1 UNION ALL SELECT 'empty', 60.0)
, g AS (SELECT run, count(DISTINCT gpu_index) AS n, max(memory_used_mib) AS mx, count(*) AS c FROM gpu GROUP BY 1), e AS (SELECT run, sum(kwh) AS kwh FROM en GROUP BY 1)
SELECT run, {r6('s')} AS duration_seconds, CAST(coalesce(n, 0) AS BIGINT) AS gpu_count, {r6('s / 3600 * n')} AS gpu_hours, {r6('mx')} AS peak_vram_mib, {r6('kwh')} AS energy_kwh, CAST(coalesce(c, 0) AS BIGINT) AS sample_count
FROM d LEFT JOIN g USING (run) LEFT JOIN e USING (run)""")
def res3(spark, sf):
    samples = views.gpu_samples(spark, sf)
    durations = samples.groupBy("run").agg((F.max("elapsed_seconds") - F.min("elapsed_seconds")).alias("duration_seconds"))
    none = durations.limit(1).select(F.lit("empty").alias("run"), F.lit(60.0).alias("duration_seconds"))
    return R.run_summary(samples, durations.unionByName(none))


SESSIONS = views.GPU + """, ss AS (SELECT *, sample % 4 AS session, (sample % 100) * 1.0 AS local_t, 80.0 AS memory_total_mib FROM gpu)
, sd AS (SELECT run, session, max(local_t) + 1 AS dur FROM ss GROUP BY 1, 2), off AS (SELECT run, session, coalesce(sum(dur) OVER (PARTITION BY run ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM sd)"""


def sessions(spark, sf):
    rows = views.gpu_samples(spark, sf).withColumn("session", F.col("sample") % 4).withColumn(
        "elapsed_seconds", (F.col("sample") % 100).cast("double")).withColumn("memory_total_mib", F.lit(80.0))
    return rows, rows.groupBy("run", "session").agg((F.max("elapsed_seconds") + 1).alias("duration_seconds"))


@query("RES4", f"WITH {SESSIONS} SELECT run, session, {r6('sum(local_t + shift)')} AS total_time, {r6('max(local_t + shift)')} AS latest FROM ss JOIN off USING (run, session) GROUP BY 1, 2")
def res4(spark, sf):
    rows, durations = sessions(spark, sf)
    return R.merge_sessions(rows, durations).groupBy("run", "session").agg(F.sum("elapsed_seconds").alias("total_time"), F.max("elapsed_seconds").alias("latest"))


@query("RES4_inventory", f"""WITH {SESSIONS}, inv AS (SELECT DISTINCT run, session, gpu_index, gpu_name FROM ss WHERE NOT (session = 3 AND gpu_index = 3)), n AS (SELECT run, count(DISTINCT session) AS s FROM inv GROUP BY 1)
SELECT run, CAST(any_value(s) AS BIGINT) AS sessions, CAST(count(*) FILTER (c < s) AS BIGINT) AS mismatched_devices FROM (SELECT run, gpu_index, gpu_name, count(*) AS c FROM inv GROUP BY 1, 2, 3) JOIN n USING (run) GROUP BY 1""")
def res4_inventory(spark, sf):
    rows, _ = sessions(spark, sf)
    return R.session_inventory_issues(rows.filter("NOT (session = 3 AND gpu_index = 3)")).drop("issues")


@query("RES5", f"WITH {views.GPU} SELECT run, CAST(count(DISTINCT gpu_index) AS BIGINT) AS gpu_count, CASE WHEN count(DISTINCT gpu_index) <> 8 THEN 'expected 8 devices' ELSE '' END AS issues FROM gpu WHERE run <> '3' OR gpu_index <> 5 GROUP BY 1")
def res5(spark, sf):
    rows = views.gpu_samples(spark, sf).filter("run <> '3' OR gpu_index <> 5")
    return R.device_count_issues(rows, 8).withColumn("issues", F.concat_ws("; ", "issues"))


@query("RES6", f"""WITH x AS (SELECT event_type, event_id, value AS gen, event_id % 13 * 0.5 AS tool, user_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY gen + tool DESC, event_id) AS k FROM x)
SELECT event_type, {r6('min(gen)')} AS gen_min, {r6('max(gen)')} AS gen_max, {r6('avg(gen)')} AS gen_mean, {r6('min(tool)')} AS tool_min, {r6('max(tool)')} AS tool_max, {r6('avg(tool)')} AS tool_mean,
  {r6('max(gen) FILTER (k = 1)')} AS slowest_gen, {r6('max(tool) FILTER (k = 1)')} AS slowest_tool, max(user_id) FILTER (k = 1) AS slowest_user_id FROM r GROUP BY 1""")
def res6(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id", F.col("value").alias("gen"), (F.col("event_id") % 13 * 0.5).alias("tool"), "user_id")
    return R.latency_summary(rows, "gen", "tool", ["user_id"], "event_id", "event_type")


@query("RES7", f"""WITH c AS (SELECT user_id AS round, event_id, value, event_type = 'error' AS bad, event_id % 4 AS n FROM events), s AS (SELECT *, value * (n * (n + 1) / 2) AS total, value * n AS longest FROM c)
SELECT round, {r6('100.0')} AS round_time, CAST(count(*) FILTER (NOT bad) AS BIGINT) AS num_successful, CAST(count(*) FILTER (bad) AS BIGINT) AS num_errors, CAST(coalesce(sum(n) FILTER (NOT bad), 0) AS BIGINT) AS total_steps,
  {r6('coalesce(avg(value) FILTER (NOT bad), 0)')} AS avg_reset_time, {r6('coalesce(avg(value * 2) FILTER (NOT bad), 0)')} AS avg_close_time, {r6('coalesce(sum(total) FILTER (NOT bad) / nullif(sum(n) FILTER (NOT bad), 0), 0)')} AS avg_step_time,
  {r6('coalesce(max(CASE WHEN n > 0 THEN longest END) FILTER (NOT bad), 0)')} AS max_step_time, {r6('coalesce(sum(n) FILTER (NOT bad), 0) / 100.0')} AS steps_per_second FROM s GROUP BY 1""")
def res7(spark, sf):
    n = (F.col("event_id") % 4).cast("int")
    times = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i * F.col("value"))).otherwise(F.array().cast("array<double>"))
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("round"), F.lit(100.0).alias("round_time"), F.when(F.col("event_type") == "error", "boom").alias("error"), n.cast("long").alias("steps_completed"),
        F.col("value").alias("reset_time"), (F.col("value") * 2).alias("close_time"), times.alias("step_times"))
    return R.load_rounds(rows)
