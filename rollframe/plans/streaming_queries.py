"""Streaming queries: each drains a stream of the given data and must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.distributed import with_row
from rollframe.plans import views
from rollframe.plans.catalog import query, r6
from rollframe.plans.resource_queries import ENERGY
from rollframe.plans.source_queries import _BAD, _KEPT, rollout_lines
from rollframe.session import stage_path
from rollframe.streaming import jobs as J


def drain(spark, parts, build, mode="append", keys=None):
    """Let the parts arrive one after the other, and run the stream over each on one checkpoint."""
    arrivals, base = stage_path(spark, "arrivals"), stage_path(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(arrivals)
        stream = build(spark.readStream.schema(parts[0].schema).parquet(arrivals))
        rows = J.run_once(stream, f"{base}/out", f"{base}/checkpoint", mode, keys)
    return rows


def thirds(rows, key):
    """Three parts of the rows, by a whole number."""
    return [rows.filter(F.col(key) % 3 == i) for i in range(3)]


def by_time(rows, time):
    """Three parts in the order of their time, of about equal size."""
    low, high = rows.agg(F.percentile_approx(time, [1 / 3, 2 / 3], 1000)).first()[0]
    t = F.col(time)
    return [rows.filter(t <= low), rows.filter((t > low) & (t <= high)), rows.filter((t > high) | t.isNull())]


def timed_turns(spark, sf, padded=False):
    rows = views.turns_padded(spark, sf) if padded else views.turns(spark, sf)
    return rows.withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("turn_idx")))


@query("STR1", f"""WITH {views.TURNS} SELECT CAST(count(*) FILTER ({_KEPT}) AS BIGINT) AS rows, CAST(count(*) FILTER ({_BAD}) AS BIGINT) AS bad_lines, {r6(f'sum(score) FILTER ({_KEPT})')} AS score_sum FROM turns""")
def str1(spark, sf):
    source, base = stage_path(spark, "lines"), stage_path(spark, "stream")
    # The part hangs on the turn and not on its text, so a line is made once.
    for part in thirds(rollout_lines(spark, sf, F.pmod(F.xxhash64("uid", "turn_idx"), F.lit(3)).alias("part")), "part"):
        part.select("value").write.mode("append").text(source)
        J.ingest(J.rollout_stream(spark, source), f"{base}/good", f"{base}/bad", f"{base}/checkpoint").awaitTermination()
    good, bad = spark.read.parquet(f"{base}/good"), spark.read.parquet(f"{base}/bad")
    return with_row(good.agg(F.count("*").alias("rows"), F.sum("score").alias("score_sum")), bad.agg(F.count("*").alias("bad_lines")))


@query("STR2", f"WITH {views.TURNS} SELECT group_idx, traj_idx, turn_idx, {r6('score')} AS score FROM turns")
def str2(spark, sf):
    # Copies arrive in another part than their rows.
    rows = timed_turns(spark, sf, padded=True).withColumn("part", F.col("row_key") + F.col("copy_no"))
    return drain(spark, thirds(rows, "part"), lambda s: J.drop_copies(s, "ts", "1 hour").select("group_idx", "traj_idx", "turn_idx", "score"))


_FATE = "CAST(group_idx AS BIGINT) % 4"


@query("STR3", f"""WITH {views.TURNS}, seen AS (SELECT *, {_FATE} AS fate FROM turns)
, kept AS (SELECT group_idx, traj_idx, bool_or(fate IN (0, 2)) OR count(*) = 1 AS complete, list(turn_idx ORDER BY turn_idx) AS held, sum(score) AS reward, bool_or(traj_success) AS success
  FROM seen WHERE NOT (fate = 1 AND turn_idx = 1 AND NOT last_turn) AND NOT (fate = 3 AND turn_idx = 1) GROUP BY group_idx, traj_idx)
, whole AS (SELECT CASE WHEN complete AND held[1] = 1 THEN 'complete' ELSE 'incomplete' END AS kind, group_idx, traj_idx, CAST(len(held) AS BIGINT) AS turns, array_to_string(held, ',') AS turn_list, reward, success FROM kept)
, aside AS (SELECT CASE fate WHEN 3 THEN 'late' ELSE 'stray' END AS kind, group_idx, traj_idx, CAST(1 AS BIGINT) AS turns, CAST(turn_idx AS VARCHAR) AS turn_list, score AS reward, traj_success AS success
  FROM seen WHERE fate = 3 AND turn_idx = 1 OR fate = 2 AND last_turn)
SELECT kind, group_idx, traj_idx, turns, turn_list, {r6('reward')} AS reward, success, kind = 'complete' AS complete FROM (SELECT * FROM whole UNION ALL SELECT * FROM aside)""")
def str3(spark, sf):
    """Trajectories by the remainder of their group: 0 arrive in two parts, 1 lose the first of several
    turns, 2 send their last turn again when they are complete, 3 send their first turn a day too late."""
    rows = timed_turns(spark, sf).withColumn("fate", F.expr("cast(group_idx as bigint) % 4")).drop("run", "uid")
    fate, turn, last = F.col("fate"), F.col("turn_idx"), F.col("last_turn")
    first = rows.filter(((fate == 0) & (turn % 2 == 0)) | ((fate == 1) & ((turn != 1) | last)) | (fate == 2) | ((fate == 3) & (turn != 1)))
    second = rows.filter(((fate == 0) & (turn % 2 == 1)) | ((fate == 2) & last))
    late = rows.filter((fate == 3) & (turn == 1))

    def clock(days):  # one row of a trajectory of its own, which moves the watermark
        return rows.limit(1).withColumns({"group_idx": F.lit("clock"), "traj_idx": F.lit(days), "ts": F.timestamp_seconds(F.lit(1_600_000_000 + days * 86_400))})
    out = drain(spark, [first, second, clock(1), late, clock(2)], lambda s: J.assemble(s, "ts"))
    return out.filter("group_idx <> 'clock'").withColumn("turn_list", F.array_join("turn_list", ","))


@query("STR4", f"""WITH {views.EPISODES} SELECT method, CAST(count(*) AS BIGINT) AS n_episodes, {r6('avg(CASE WHEN success THEN 1 ELSE 0 END)')} AS success_rate, {r6('avg(cumulative_reward)')} AS avg_cumulative_reward,
  {r6('avg(num_turns)')} AS avg_turns, CAST(count(*) FILTER (finish_reason NOT IN ('done', 'max_turns', 'skipped_resume')) AS BIGINT) AS error_rollouts FROM episodes GROUP BY 1""")
def str4(spark, sf):
    return drain(spark, thirds(views.episodes(spark, sf), "episode"), lambda s: J.live_summary(s, "method"), "update", ["method"])


def timed_samples(spark, sf):
    return views.gpu_samples(spark, sf).withColumn("ts", F.timestamp_seconds("elapsed_seconds"))


@query("STR5", f"""WITH {views.GPU} SELECT run, gpu_index, CAST(floor(elapsed_seconds / 3600) AS BIGINT) AS hour, {r6('max(memory_used_mib)')} AS peak_memory_mib, {r6('avg(utilization_percent)')} AS mean_utilization,
  {r6('avg(power_watts)')} AS mean_power, CAST(count(*) AS BIGINT) AS samples FROM gpu GROUP BY 1, 2, 3""")
def str5(spark, sf):
    rows = drain(spark, by_time(timed_samples(spark, sf), "ts"), lambda s: J.device_windows(s, width="1 hour"), "update", ["run", "gpu_index", "window"])
    return rows.withColumn("hour", F.floor(F.unix_seconds("window.start") / 3600)).drop("window")


@query("STR5_energy", f"WITH {ENERGY} SELECT run, gpu_index, {r6('kwh')} AS energy_kwh FROM en WHERE kwh IS NOT NULL")
def str5_energy(spark, sf):
    """Odd samples arrive after all even ones, within the watermark's delay; a last row moves the watermark past them."""
    rows = timed_samples(spark, sf)
    span, end = rows.agg(F.timestamp_diff("DAY", F.min("ts"), F.max("ts")), F.unix_seconds(F.max("ts"))).first()
    delay = f"{span + 2} days"
    clock = rows.limit(1).withColumns({"run": F.lit("clock"), "ts": F.timestamp_seconds(F.lit(end + (span + 4) * 86_400))})
    parts = [rows.filter("sample % 2 = 0"), rows.filter("sample % 2 = 1"), clock]
    pieces = drain(spark, parts, lambda s: J.energy_pieces(s, delay=delay, patience_ms=(span + 2) * 86_400_000, slot_ms=86_400_000))
    return pieces.filter("run <> 'clock'").groupBy("run", "gpu_index").agg(F.sum("kwh").alias("energy_kwh"))


@query("STR6", f"""WITH {views.GPU}, m AS (SELECT *, CASE WHEN elapsed_seconds - lag(elapsed_seconds) OVER w <= 1800 THEN 0 ELSE 1 END AS new_ FROM gpu WINDOW w AS (PARTITION BY run, gpu_index ORDER BY elapsed_seconds, sample))
, s AS (SELECT *, sum(new_) OVER (PARTITION BY run, gpu_index ORDER BY elapsed_seconds, sample ROWS UNBOUNDED PRECEDING) AS sid FROM m), t AS (SELECT run, gpu_index, sid, count(*) AS n, max(elapsed_seconds) - min(elapsed_seconds) AS a FROM s GROUP BY 1, 2, 3)
SELECT run, gpu_index, CAST(count(*) AS BIGINT) AS sessions, CAST(sum(n) AS BIGINT) AS samples, {r6('sum(a)')} AS active_seconds FROM t GROUP BY 1, 2""")
def str6(spark, sf):
    rows = drain(spark, by_time(timed_samples(spark, sf), "ts"), J.device_sessions, "complete")
    return rows.groupBy("run", "gpu_index").agg(F.count("*").alias("sessions"), F.sum("samples").alias("samples"), F.sum("active_seconds").alias("active_seconds"))
