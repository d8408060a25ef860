"""Selection, lineage, split, contract and config queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.operators import contracts as C
from rollframe.operators import runs as R
from rollframe.operators import selection as S
from rollframe.plans import views
from rollframe.plans.catalog import query, r6, table
from rollframe.session import stage

CANDIDATES = views.TRAJ + """, cand AS (SELECT run, step, count(*) AS actual, CASE WHEN step % 2 = 0 THEN count(*) ELSE count(*) + step % 3 END AS expected,
  CASE WHEN step % 7 <> 0 THEN round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) END AS success_rate, round(avg(turns) FILTER (success), 6) AS mean_turns, step % 5 <> 0 AS saved
  FROM traj GROUP BY 1, 2), ok AS (SELECT *, actual = expected AND success_rate IS NOT NULL AND saved AS eligible FROM cand)"""


@query("FIN1", f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY success_rate DESC, mean_turns ASC NULLS LAST, step DESC) AS k FROM ok WHERE eligible)
SELECT run, CAST(candidates AS BIGINT) AS candidates, CAST(n AS BIGINT) AS eligible_candidates, step, {r6('success_rate')} AS success_rate, {r6('mean_turns')} AS mean_turns
FROM (SELECT run, count(*) AS candidates, count(*) FILTER (eligible) AS n FROM ok GROUP BY 1) LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (run)""")
def fin1(spark, sf):
    per = views.turns(spark, sf).groupBy("run", "step", "group_idx", "traj_idx").agg(F.count("*").alias("t"), F.bool_or("traj_success").alias("w"))
    step = F.col("step")
    cand = per.groupBy("run", "step").agg(
        F.count("*").alias("actual"), F.round(F.avg(F.col("w").cast("double")), 6).alias("success_rate"),
        F.round(F.avg(F.when(F.col("w"), F.col("t"))), 6).alias("mean_turns")).select(
            "run", "step", "actual", F.when(step % 2 == 0, F.col("actual")).otherwise(F.col("actual") + step % 3).alias("expected"),
            F.when(step % 7 != 0, F.col("success_rate")).alias("success_rate"), "mean_turns", (step % 5 != 0).alias("saved"))
    return S.select_checkpoint(cand)


# Evaluation runs, their exports and training runs, one of each per customer.
LINEAGE = """cust AS (SELECT c_custkey AS c, lower(c_mktsegment) AS environment, ['concat_grpo', 'no_concat_gae', 'no_concat_episode_grpo'][CAST(c_custkey % 3 + 1 AS INTEGER)] AS method,
    c_custkey // 3 % 3 AS seed FROM customer)
, ev AS (SELECT o_custkey AS c, count(*) AS episodes, count(*) FILTER (o_orderstatus = 'F') AS successes, sum(o_orderkey % 9) FILTER (o_orderstatus = 'F') AS turn_sum,
    count(*) FILTER (o_orderkey % 97 = 0) AS undeclared FROM orders GROUP BY 1)"""


def lineage_inputs(spark, sf):
    c = F.col("c_custkey")
    base = table(spark, sf, "customer").select(
        c.alias("c"), F.lower("c_mktsegment").alias("environment"),
        F.element_at(F.array(*[F.lit(m) for m in ("concat_grpo", "no_concat_gae", "no_concat_episode_grpo")]), (c % 3 + 1).cast("int")).alias("method"),
        F.floor(c / 3).cast("long").alias("c3")).withColumn("seed", F.col("c3") % 3)
    c = F.col("c")
    named = lambda p: F.concat(F.lit(p), c.cast("string"))
    orders = table(spark, sf, "orders").select(F.concat(F.lit("eval"), F.col("o_custkey").cast("string")).alias("run"),
                                               F.col("o_orderkey").alias("seed"), (F.col("o_orderstatus") == "F").alias("won"))
    declared = orders.filter(F.col("seed") % 97 != 0).select("run", "seed")
    # One pass over the episodes; what is left is a row per run.
    seeds = stage(S.seed_set_report(orders, declared, successes=F.col("won").cast("long"), turn_sum=F.when(F.col("won"), F.col("seed") % 9)))
    evals = base.withColumn("run", named("eval")).join(seeds.select("run", F.col("episodes").alias("_n")), "run", "left").select(
        "run", "environment", named("model").alias("model"), (c % 2 == 0).alias("concat_multi_turn"),
        (F.coalesce("_n", F.lit(0)) + F.when(c % 29 == 0, 1).otherwise(0)).alias("n_envs"),
        F.when(c % 17 != 0, named("train")).alias("source_run_dir"), named("sel").alias("source_selection_manifest"),
        named("exp").alias("source_export_manifest"), F.when(c % 19 == 0, F.lit("other")).otherwise(F.col("method")).alias("source_method"),
        F.col("seed").alias("source_train_seed"), F.lit(401).cast("long").alias("source_checkpoint_step"), F.col("environment").alias("source_environment"),
        F.lit("complete").alias("status"))
    exports = base.filter(c % 31 != 0).select(
        named("exp").alias("export"), F.lit(S.EXPORT_ARTIFACT).alias("artifact_type"), F.when(c % 37 == 0, "running").otherwise("complete").alias("status"),
        named("model").alias("model_path"), "environment", "method", F.col("seed").alias("train_seed"), F.lit(401).cast("long").alias("checkpoint_step"),
        named("train").alias("source_run_dir"))
    trainings = base.select(
        named("train").alias("run"), "method", "seed", "environment", F.when(c % 23 == 0, c % 2 != 0).otherwise(c % 2 == 0).alias("concat_multi_turn"),
        F.when(c % 11 == 0, "failed").otherwise("complete").alias("status"), (c % 13 != 0).alias("gate_passed"), (1 + (c % 7) * 0.01).alias("ratio_p95"),
        (1 - (c % 5) * 0.02).alias("ratio_p99"), ((c % 9) * 0.01).alias("mean_abs_logprob_delta"), (c * 1.0).alias("peak_vram_mib"), ((c % 10) * 1.5).alias("gpu_hours"))
    return evals, exports, trainings, seeds


_ISSUES = """list_filter([CASE WHEN c % 17 = 0 THEN 'manifest is missing source_run_dir' END, CASE WHEN c % 31 = 0 THEN 'export manifest is unreadable' END,
  CASE WHEN c % 31 <> 0 AND c % 37 = 0 THEN 'export is not complete' END, CASE WHEN c % 31 <> 0 AND c % 19 = 0 THEN 'evaluation/export mismatch for source_method' END,
  CASE WHEN c % 31 <> 0 AND c % 17 = 0 THEN 'evaluation/export mismatch for source_run_dir' END,
  CASE WHEN c % 17 <> 0 AND c % 19 = 0 THEN 'evaluation/training mismatch for source_method' END, CASE WHEN c % 17 <> 0 AND c % 23 = 0 THEN 'context protocol does not match training' END,
  CASE WHEN c % 17 <> 0 AND c % 11 = 0 THEN 'source training run is not complete' END, CASE WHEN c % 17 <> 0 AND c % 13 = 0 THEN 'source parity gate did not pass' END,
  CASE WHEN coalesce(episodes, 0) = 0 AND c % 29 <> 0 THEN 'manifest has invalid n_envs' END, CASE WHEN c % 29 = 0 THEN 'episode count differs from n_envs' END,
  CASE WHEN coalesce(episodes, 0) - coalesce(undeclared, 0) = 0 THEN 'no valid frozen seed set' END,
  CASE WHEN episodes > undeclared AND undeclared > 0 THEN 'episode seeds do not match the frozen set' END], lambda x: x IS NOT NULL)"""
RECORDS = LINEAGE + f""", rec AS (SELECT c, concat('eval', c) AS run, environment, CASE WHEN c % 19 = 0 THEN 'other' ELSE method END AS method, seed, coalesce(episodes, 0) AS episodes,
  coalesce(successes, 0) AS successes, coalesce(turn_sum, 0) AS turn_sum, {_ISSUES} AS issues, CASE WHEN c % 17 <> 0 THEN c * 1.0 END AS vram, CASE WHEN c % 17 <> 0 THEN (c % 10) * 1.5 END AS hours,
  CASE WHEN c % 17 <> 0 THEN 1 + (c % 7) * 0.01 END AS p95, CASE WHEN c % 17 <> 0 THEN 1 - (c % 5) * 0.02 END AS p99, CASE WHEN c % 17 <> 0 THEN (c % 9) * 0.01 END AS delta,
  CASE WHEN c % 17 <> 0 THEN c % 13 <> 0 END AS gate FROM cust LEFT JOIN ev USING (c))"""


def records(spark, sf):
    return S.final_records(*lineage_inputs(spark, sf))


@query("JOIN4", f"WITH {RECORDS} SELECT run, array_to_string(issues, '; ') AS issues FROM rec")
def join4(spark, sf):
    return records(spark, sf).select("run", F.concat_ws("; ", "issues").alias("issues"))


@query("FIN2", f"""WITH {RECORDS} SELECT run, environment, method, seed, CASE WHEN len(issues) > 0 THEN 'incomplete-artifacts' ELSE 'complete' END AS status,
  CAST(episodes AS BIGINT) AS episodes, CAST(successes AS BIGINT) AS successes, {r6('vram')} AS peak_vram_mib, {r6('hours')} AS gpu_hours, {r6('p95')} AS ratio_p95, {r6('p99')} AS ratio_p99,
  {r6('delta')} AS mean_abs_logprob_delta, gate AS gate_passed, CASE WHEN c % 2 = 0 THEN 'concat' ELSE 'no-concat' END AS context_protocol FROM rec""")
def fin2(spark, sf):
    return records(spark, sf).drop("issues", "turn_sum")


@query("FIN3", f"""WITH {LINEAGE} SELECT concat('eval', c) AS run, CAST(episodes AS BIGINT) AS episodes, CAST(episodes - undeclared AS BIGINT) AS declared_seeds,
  CASE WHEN episodes = undeclared THEN 'no valid frozen seed set' WHEN undeclared > 0 THEN 'episode seeds do not match the frozen set' ELSE '' END AS issues FROM ev""")
def fin3(spark, sf):
    return lineage_inputs(spark, sf)[3].drop("successes", "turn_sum").withColumn("issues", F.concat_ws("; ", "issues"))


# Nine customers in a row hold each method with each seed once; they stand for an environment.
FINALS = RECORDS + """, f AS (SELECT concat('block', c // 9) AS environment, CASE WHEN len(issues) > 0 THEN 1 ELSE 0 END AS open_, * EXCLUDE (environment) FROM rec)
, g AS (SELECT environment, method, count(*) AS runs, count(DISTINCT seed) AS n_seeds, sum(open_) AS open_, CAST(sum(successes) AS DOUBLE) AS s, CAST(sum(episodes) AS DOUBLE) AS n,
   avg(CASE WHEN episodes > 0 THEN successes / episodes END) AS macro, coalesce(stddev_samp(CASE WHEN episodes > 0 THEN successes / episodes END), 0) AS std, sum(turn_sum) / nullif(sum(successes), 0) AS turns,
   max(vram) AS vram, avg(hours) AS hours, sum(hours) AS total, arg_max(p95, round(abs(p95 - 1), 9)) AS p95, arg_max(p99, round(abs(p99 - 1), 9)) AS p99, max(delta) AS delta, bool_and(gate) AS gate
   FROM f GROUP BY 1, 2), done AS (SELECT *, runs = n_seeds AND n_seeds = 3 AND open_ = 0 AS ok FROM g)"""


def finals(spark, sf):
    block = F.floor(F.substring("run", 5, 20).cast("long") / 9)
    return S.final_aggregates(records(spark, sf).withColumn("environment", F.concat(F.lit("block"), block.cast("string"))), [0, 1, 2])


from rollframe.plans.statistics_queries import wilson_sql  # noqa: E402

_FLO, _FHI = wilson_sql("s", "n")
_ok = lambda e: r6(f"CASE WHEN ok THEN {e} END")


@query("FIN4", f"""WITH {FINALS} SELECT environment, method, CAST(n_seeds AS BIGINT) AS n_seeds, {_ok('s / nullif(n, 0)')} AS success, {_ok('macro')} AS success_macro_mean, {_ok('std')} AS success_seed_std,
  {_ok('CASE WHEN n > 0 THEN ' + _FLO + ' ELSE 0 END')} AS success_low, {_ok('CASE WHEN n > 0 THEN ' + _FHI + ' ELSE 0 END')} AS success_high, CASE WHEN ok THEN CAST(s AS BIGINT) END AS successes, CASE WHEN ok THEN CAST(n AS BIGINT) END AS episodes,
  {_ok('turns')} AS mean_turns, {_ok('vram')} AS peak_vram_mib, {_ok('hours')} AS gpu_hours, {_ok('total')} AS gpu_hours_total, {_ok('p95')} AS ratio_p95, {_ok('abs(p95 - 1)')} AS max_p95_deviation,
  {_ok('p99')} AS ratio_p99, {_ok('abs(p99 - 1)')} AS max_p99_deviation, {_ok('delta')} AS mean_abs_logprob_delta, CASE WHEN ok THEN gate END AS gate_passed,
  CASE WHEN ok THEN 'complete' ELSE 'incomplete-artifacts' END AS status FROM done""")
def fin4(spark, sf):
    return finals(spark, sf).drop("issues")


_GRID_E, _GRID_M = ["block0", "block1", "block2", "block3", "block4", "block5", "garden"], ["concat_grpo", "no_concat_gae", "no_concat_episode_grpo"]
GRID = FINALS + f""", want AS (SELECT unnest({_GRID_E}) AS environment), wantm AS (SELECT unnest({_GRID_M}) AS method)
, grid AS (SELECT environment, method, coalesce(CASE WHEN d.ok THEN 'complete' WHEN d.ok IS NOT NULL THEN 'incomplete-artifacts' END, 'incomplete-artifacts') AS status,
   CASE WHEN d.ok IS NULL THEN 'missing' WHEN w.environment IS NULL THEN 'unexpected' ELSE 'present' END AS presence
   FROM (SELECT want.environment, wantm.method FROM want, wantm) w FULL JOIN done d USING (environment, method))"""


@query("JOIN8", f"WITH {GRID} SELECT environment, method, status, presence FROM grid")
def join8(spark, sf):
    return S.grid_report(finals(spark, sf), _GRID_E, _GRID_M)


@query("FIN5", f"WITH {GRID} SELECT bool_and(presence = 'present' AND status = 'complete') AS registry_complete FROM grid")
def fin5(spark, sf):
    return S.registry_complete(S.grid_report(finals(spark, sf), _GRID_E, _GRID_M))


@query("FIN6", f"""WITH {views.EPISODES}, b AS (SELECT environment, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (success) AS DOUBLE) AS s, avg(num_turns) FILTER (success) AS t FROM episodes GROUP BY 1)
SELECT environment, CAST(n AS BIGINT) AS episodes, CAST(s AS BIGINT) AS successes, {r6('s / n')} AS success, {r6(_FLO)} AS success_low, {r6(_FHI)} AS success_high, {r6('t')} AS mean_turns FROM b""")
def fin6(spark, sf):
    return S.base_aggregate(views.episodes(spark, sf), "environment")


@query("FIN7", "SELECT doc_id, substr(sha256(text), 1, 16) AS fingerprint FROM documents")
def fin7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.fingerprint(F.col("text")).alias("fingerprint"))


PRINTS = "p AS (SELECT doc_id AS seed, substr(sha256(text), 1, 16) AS fingerprint FROM documents)"


def prints(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("seed"), S.fingerprint(F.col("text")).alias("fingerprint"))


@query("FIN8", f"""WITH {PRINTS}, c AS (SELECT fingerprint, min(seed) AS seed FROM p WHERE seed >= 40 GROUP BY 1 HAVING fingerprint NOT IN (SELECT fingerprint FROM p WHERE seed < 40))
SELECT seed, fingerprint FROM c ORDER BY seed LIMIT 120""")
def fin8(spark, sf):
    p = prints(spark, sf)
    return S.select_disjoint(p.filter("seed >= 40"), "seed", 120, p.filter("seed < 40"))


SPLIT = PRINTS + """, tr AS (SELECT seed, fingerprint FROM p WHERE seed < 60)
, v AS (SELECT min(seed) AS seed, fingerprint FROM p WHERE seed >= 60 AND fingerprint NOT IN (SELECT fingerprint FROM tr) GROUP BY fingerprint ORDER BY 1 LIMIT 50)
, te AS (SELECT min(seed) AS seed, fingerprint FROM p WHERE seed >= 60 AND fingerprint NOT IN (SELECT fingerprint FROM tr) AND fingerprint NOT IN (SELECT fingerprint FROM v) GROUP BY fingerprint ORDER BY 1 LIMIT 40)"""


@query("FIN9", f"WITH {SPLIT} SELECT seed, fingerprint, 'train' AS split FROM tr UNION ALL SELECT seed, fingerprint, 'validation' FROM v UNION ALL SELECT seed, fingerprint, 'test' FROM te")
def fin9(spark, sf):
    p = prints(spark, sf)
    return S.build_split(p.filter("seed >= 60"), p.filter("seed < 60"), "seed", 50, 40)


_H = "CAST(concat('0x', substr(md5(concat_ws('|', 7, {k}, {i})), 1, 8)) AS BIGINT) % 2147483648"
SPECS = """specs AS (SELECT o_orderkey AS spec_idx, o_orderkey % 6 + 1 AS n_envs, o_orderkey % 4 AS kind, o_custkey AS base FROM orders)"""


@query("FIN10", f"""WITH {SPECS}, slots AS (SELECT *, unnest(generate_series(0, n_envs - 1)) AS slot FROM specs)
, pool AS (SELECT *, unnest(generate_series(0, 11)) AS i FROM specs WHERE kind = 2)
, r AS (SELECT *, row_number() OVER (PARTITION BY spec_idx ORDER BY {_H.format(k='spec_idx', i='i')}, i) - 1 AS slot FROM pool)
SELECT spec_idx, CAST(slot AS BIGINT) AS slot, CAST(CASE kind WHEN 0 THEN {_H.format(k='spec_idx', i='slot')} WHEN 1 THEN base + {_H.format(k='spec_idx', i='slot')} % 10 ELSE base + slot END AS BIGINT) AS task_seed FROM slots WHERE kind <> 2
UNION ALL SELECT spec_idx, CAST(slot AS BIGINT), CAST(base + i // 2 AS BIGINT) FROM r WHERE slot < n_envs""")
def fin10(spark, sf):
    k, base = F.col("o_orderkey"), F.col("o_custkey")
    specs = table(spark, sf, "orders").select(
        k.alias("spec_idx"), (k % 6 + 1).alias("n_envs"),
        F.when(k % 4 == 0, F.array(base)).when(k % 4 == 1, F.array(base, base + 9)).otherwise(F.array(base, base + 5, F.lit(2).cast("long"))).alias("seed"),
        F.when(k % 4 == 3, F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: base + i)).alias("seed_list"))
    return C.expand_tasks(specs, base_seed=7)


@query("FIN11", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'declared range differs from the config' END,
  CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 2 = 0 THEN 'repeat must be 1' END, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 THEN 'invalid evaluation repeat' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n_envs differs from the seed count' END], lambda x: x IS NOT NULL), '; ') AS issues FROM orders""")
def fin11(spark, sf):
    k, base = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("evaluation")), (k % 3 + 1).cast("int")).alias("role"),
        F.array(base, base + 9, F.when(k % 2 == 0, 2).otherwise(1)).alias("seed"), F.lit(None).cast("array<bigint>").alias("seed_list"),
        F.array(base, F.when(k % 5 == 0, base + 8).otherwise(base + 9)).alias("declared"), F.when(k % 7 == 0, 11).otherwise(10).alias("n_envs"))
    return C.partition_issues(rows).select("o_orderkey", F.concat_ws("; ", "issues").alias("issues"))


@query("FIN12", """SELECT o_orderkey AS run, key, existing, requested FROM (
  SELECT o_orderkey, 'commit' AS key, 'abc' AS existing, CASE WHEN o_orderkey % 3 = 0 THEN 'def' ELSE 'abc' END AS requested FROM orders
  UNION ALL SELECT o_orderkey, 'old', CAST(o_custkey AS VARCHAR), NULL FROM orders UNION ALL SELECT o_orderkey, 'new', NULL, o_orderstatus FROM orders) WHERE existing IS DISTINCT FROM requested""")
def fin12(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select(F.col("o_orderkey").alias("run"), F.create_map(F.lit("commit"), F.lit("abc"), F.lit("old"), F.col("o_custkey").cast("string")).alias("manifest"))
    b = o.select(F.col("o_orderkey").alias("run"), F.create_map(
        F.lit("commit"), F.when(F.col("o_orderkey") % 3 == 0, "def").otherwise("abc"), F.lit("new"), F.col("o_orderstatus")).alias("manifest"))
    return S.manifest_difference(a, b)


@query("FIN13", "SELECT o_custkey AS run, CAST(sum(o_orderkey % 6 + 1) AS BIGINT) AS validation_n_envs FROM orders GROUP BY 1")
def fin13(spark, sf):
    return C.expected_validation(table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), (F.col("o_orderkey") % 6 + 1).alias("n_envs")))


@query("JOIN1", f"WITH {views.TURNS} SELECT group_idx, traj_idx, turn_idx, {r6('o_totalprice')} AS o_totalprice, o_orderpriority FROM turns JOIN orders ON uid = o_orderkey")
def join1(spark, sf):
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), "o_totalprice", "o_orderpriority")
    return S.align_tasks(views.turns(spark, sf), tasks).select("group_idx", "traj_idx", "turn_idx", "o_totalprice", "o_orderpriority")


@query("JOIN2", """WITH a AS (SELECT o_custkey AS uid, o_orderkey AS traj, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus <> 'P')
, b AS (SELECT o_custkey AS uid, -o_orderkey AS request, row_number() OVER (PARTITION BY o_custkey ORDER BY -o_orderkey) - 1 AS position FROM orders WHERE o_orderkey % 3 <> 0)
SELECT uid, CAST(position AS INTEGER) AS position, traj, request, CASE WHEN traj IS NULL THEN 'request without a trajectory' WHEN request IS NULL THEN 'trajectory without a request' ELSE '' END AS issues
FROM a FULL JOIN b USING (uid, position)""")
def join2(spark, sf):
    o = table(spark, sf, "orders")
    a = o.filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("traj"))
    b = o.filter("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("uid"), (-F.col("o_orderkey")).alias("request"))
    return S.align_multiset(a, b, "uid", "traj", "request").withColumn("issues", F.concat_ws("; ", "issues"))


@query("JOIN5", f"""WITH {views.EPISODES} SELECT environment AS env_name, episode AS seed, method AS tag_id, observation_ablation, episode % 2 = 0 AS concat_multi_turn FROM episodes
WHERE NOT (finish_reason IN ('done', 'max_turns') AND episode % 5 <> 0)""")
def join5(spark, sf):
    e = views.episodes(spark, sf).select(
        F.col("environment").alias("env_name"), F.col("episode").alias("seed"), F.col("method").alias("tag_id"), "observation_ablation",
        (F.col("episode") % 2 == 0).alias("concat_multi_turn"), "finish_reason", "episode")
    done = e.filter("finish_reason IN ('done', 'max_turns') AND episode % 5 <> 0")
    return S.remaining_jobs(e.drop("finish_reason", "episode"), done.drop("finish_reason", "episode"))


ITEMS = PRINTS + """, items AS (SELECT CASE WHEN seed % 10 < 7 THEN 'train' WHEN seed % 10 < 9 THEN 'validation' ELSE 'test' END AS split, CASE WHEN seed % 50 = 8 THEN seed + 1 ELSE seed END AS seed, fingerprint FROM p)
, per AS (SELECT fingerprint, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'validation') AS va, count(*) FILTER (split = 'test') AS te FROM items GROUP BY 1)
, problems AS (SELECT 'validation fingerprints repeat' AS problem, count(*) FILTER (va > 1) AS items FROM per UNION ALL SELECT 'test fingerprints repeat', count(*) FILTER (te > 1) FROM per
  UNION ALL SELECT 'validation fingerprints also in train', count(*) FILTER (va > 0 AND tr > 0) FROM per UNION ALL SELECT 'test fingerprints also in train', count(*) FILTER (te > 0 AND tr > 0) FROM per
  UNION ALL SELECT 'test fingerprints also in validation', count(*) FILTER (te > 0 AND va > 0) FROM per
  UNION ALL SELECT 'validation and test share a seed', count(*) FROM (SELECT seed FROM items WHERE split <> 'train' GROUP BY 1 HAVING count(DISTINCT split) > 1)
  UNION ALL SELECT 'validation seeds inside the train range', count(*) FROM items WHERE split = 'validation' AND seed BETWEEN 0 AND 99
  UNION ALL SELECT 'test seeds inside the train range', count(*) FROM items WHERE split = 'test' AND seed BETWEEN 0 AND 99)"""


@query("JOIN6", f"WITH {ITEMS} SELECT problem, CAST(items AS BIGINT) AS items FROM problems WHERE items > 0")
def join6(spark, sf):
    k = F.col("seed")
    items = prints(spark, sf).withColumn("split", F.when(k % 10 < 7, "train").when(k % 10 < 9, "validation").otherwise("test")).withColumn(
        "seed", F.when(k % 50 == 8, k + 1).otherwise(k))
    return S.split_problems(items, (0, 99))


_ROLE = "CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'evaluation' END"


@query("JOIN7", f"""WITH i AS (SELECT o_orderstatus AS environment, o_orderpriority AS task_set, o_custkey AS seed, {_ROLE} AS role FROM orders)
, per AS (SELECT environment, task_set, seed, bool_or(role = 'train') AS a, bool_or(role = 'validation') AS b, bool_or(role = 'evaluation') AS c FROM i GROUP BY 1, 2, 3)
SELECT environment, left_role, right_role, CAST(count(*) AS BIGINT) AS identities FROM (SELECT environment, 'train' AS left_role, 'validation' AS right_role FROM per WHERE a AND b
  UNION ALL SELECT environment, 'train', 'evaluation' FROM per WHERE a AND c UNION ALL SELECT environment, 'validation', 'evaluation' FROM per WHERE b AND c) GROUP BY 1, 2, 3""")
def join7(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("environment"), F.col("o_orderpriority").alias("task_set"),
                                             F.col("o_custkey").alias("seed"), F.expr(_ROLE).alias("role"))
    return S.role_overlaps(rows, ["train", "validation", "evaluation"])


@query("SET4", """WITH a AS (SELECT o_custkey AS uid, count(*) AS left_rows FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS uid, count(*) AS right_rows FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT uid, CAST(coalesce(left_rows, 0) AS BIGINT) AS left_rows, CAST(coalesce(right_rows, 0) AS BIGINT) AS right_rows FROM a FULL JOIN b USING (uid) WHERE coalesce(left_rows, 0) <> coalesce(right_rows, 0)""")
def set4(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), "o_orderstatus")
    return S.unequal_multisets(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "uid")


def run_table(spark, sf):
    """Run artifacts, one run per customer: a third are training runs, the rest evaluations."""
    c = F.col("c_custkey")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("bad"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"))
    train = c % 3 == 0
    b = table(spark, sf, "customer").join(o, "c_custkey", "left")
    null = F.lit(None)
    return b.select(
        F.concat(F.lit("run"), c.cast("string")).alias("run"), F.col("c_mktsegment").alias("environment"), F.when(c % 4 != 0, F.lit("grpo")).alias("method"),
        F.when(train, c % 3).alias("seed"), (c % 100).alias("seed_start"), F.when(train, "no_concat_gae").alias("advantage_estimator"),
        F.lit(True).alias("has_manifest"), F.when(train, 0).otherwise(F.coalesce("n", F.lit(0))).alias("episodes"), F.coalesce("n", F.lit(0)).alias("distinct_seeds"),
        (F.coalesce("n", F.lit(0)) + F.when(c % 5 == 0, 1).otherwise(0)).alias("n_envs"), (~train & (F.coalesce("bad", F.lit(0)) > 4)).alias("evaluation_failed"),
        F.lit(401).alias("total_steps"), F.when(train, F.when(c % 7 == 0, 300).otherwise(401)).alias("latest_step"), F.lit(64).alias("validation_n_envs"), F.lit(64).alias("trajectories"),
        F.when(c % 10 != 0, F.when(c % 50 == 1, 1).otherwise(0)).alias("gpu_return_code"), F.when(c % 10 != 0, F.lit(9)).alias("gpu_sample_count"),
        F.when(c % 10 != 0, c * 1.0).alias("peak_vram_mib"), F.when(c % 10 != 0, c * 0.5).alias("gpu_hours"), (c % 41).cast("int").alias("_e"), F.lit(2).alias("gpu_count"),
        F.when(c % 2 == 0, F.when(c % 43 == 0, 3).otherwise(2)).alias("expected_device_count"), F.when(train, True).alias("gate_enabled"),
        F.when(train, c % 9 != 0).alias("gate_passed"), F.when(train, c % 12 == 3).alias("parity_ever_failed"), F.lit("abc").alias("commit"), F.lit("def").alias("stack_commit"),
        (c % 47 == 0).alias("git_dirty"), F.lit(True).alias("command_saved"), (c % 53 != 0).alias("config_saved"), F.col("rate").alias("success_rate"),
        null.cast("double").alias("mean_turns"), F.when(train, 1 + (c % 7) * 0.01).alias("ratio_p95"), F.lit("manifest.json").alias("evidence")).withColumn(
            "gpu_sampling_errors", F.when(F.col("_e") == 0, 1).otherwise(0)).drop("_e")


RUNTABLE = """o AS (SELECT o_custkey AS c, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS bad, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS rate FROM orders GROUP BY 1)
, b AS (SELECT c_custkey AS c, c_mktsegment AS environment, c_custkey % 3 = 0 AS train, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, rate FROM customer LEFT JOIN o ON c_custkey = c)
, f AS (SELECT *, (c % 10 <> 0 AND c % 50 = 1) OR (NOT train AND bad > 4) OR (train AND (c % 9 = 0 OR c % 12 = 3)) AS failed, train AND (c % 9 = 0 OR c % 12 = 3) AS parity_bad,
   c % 41 = 0 OR (c % 2 = 0 AND c % 43 = 0) AS tainted,
   CASE WHEN NOT train AND n > 0 THEN c % 5 <> 0 ELSE train AND c % 7 <> 0 END AS behaved, c % 10 <> 0 AND c % 50 <> 1 AND c % 41 <> 0 AND NOT (c % 2 = 0 AND c % 43 = 0) AS gpu, c % 47 <> 0 AND c % 53 <> 0 AS prov FROM b)
, st AS (SELECT *, CASE WHEN failed THEN 'failed' WHEN behaved AND gpu AND prov THEN 'complete' ELSE 'incomplete-artifacts' END AS status FROM f)"""


@query("EVA7", f"""WITH {RUNTABLE} SELECT CASE WHEN c % 4 <> 0 THEN 'grpo' ELSE 'unknown' END AS Method, {r6('rate')} AS "Visual Success", {r6('CASE WHEN c % 10 <> 0 THEN c END')} AS "Peak VRAM", {r6('CASE WHEN c % 10 <> 0 THEN c * 0.5 END')} AS "GPU·h",
  {r6('NULL')} AS "Mean Turns", {r6('CASE WHEN train THEN 1 + (c % 7) * 0.01 END')} AS "Ratio P95", status AS Status, environment AS Environment, CASE WHEN train THEN c % 3 ELSE c % 100 END AS Seed, 'abc' AS Commit, 'manifest.json' AS Evidence FROM st""")
def eva7(spark, sf):
    return R.result_rows(run_table(spark, sf))


@query("EVA8", f"""WITH {RUNTABLE} SELECT concat('run', c) AS run, CASE WHEN parity_bad THEN 'failed-parity' WHEN tainted THEN 'tainted-gpu-metrics' WHEN status = 'complete' THEN 'complete' ELSE 'resumable' END AS state FROM st""")
def eva8(spark, sf):
    return run_table(spark, sf).select("run", R.resume_state().alias("state"))


@query("PRJ33", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'missing trainer' END, CASE WHEN k % 11 <> 0 AND k % 4 = 0 THEN 'invalid n_gpus_per_node' END,
  CASE WHEN k % 5 = 0 THEN 'unknown actor strategy' END, CASE WHEN k % 3 = 0 THEN 'adapter rollout needs layered_summon' END, CASE WHEN k % 7 = 0 THEN 'unknown adv_estimator' END,
  CASE WHEN k % 7 = 1 AND k % 2 = 0 THEN 'invalid gamma' END, CASE WHEN k % 7 = 2 AND k % 6 = 0 THEN 'group-relative estimator needs rollout.n >= 2' END, CASE WHEN k % 7 = 1 AND k % 9 = 0 THEN 'estimator needs a critic' END,
  CASE WHEN k % 7 = 1 AND k % 9 <> 0 AND k % 8 = 0 THEN 'estimator needs critic.enable' END, CASE WHEN k % 13 = 0 THEN 'unknown reward mode' END], lambda x: x IS NOT NULL), '; ') AS issues FROM (SELECT *, o_orderkey AS k FROM orders)""")
def prj33(spark, sf):
    config = F.expr("""concat('{', CASE WHEN k % 11 = 0 THEN '' ELSE concat('"trainer":{"n_gpus_per_node":', CASE WHEN k % 4 = 0 THEN 0 ELSE 2 END, '},') END,
      '"actor_rollout_ref":{"model":{"lora_rank":', CASE WHEN k % 3 = 0 THEN 8 ELSE 0 END, '},"actor":{"strategy":"', CASE WHEN k % 5 = 0 THEN 'ddp' ELSE 'fsdp' END,
      '"},"rollout":{"n":', CASE WHEN k % 6 = 0 THEN 1 ELSE 4 END, ',"load_format":"safetensors","layered_summon":false}},"algorithm":{"adv_estimator":"',
      CASE k % 7 WHEN 0 THEN 'magic' WHEN 1 THEN 'no_concat_gae' WHEN 2 THEN 'grpo' ELSE 'remax' END, '","gamma":', CASE WHEN k % 2 = 0 THEN 1.5 ELSE 0.9 END, ',"lam":0.9}',
      CASE WHEN k % 9 = 0 THEN '' ELSE concat(',"critic":{"enable":', CASE WHEN k % 8 = 0 THEN 'false' ELSE 'true' END, '}') END, ',"reward":{"mode":"', CASE WHEN k % 13 = 0 THEN 'fun' ELSE 'outcome' END, '"}}')""")
    rows = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey")).withColumn("config", config)
    return C.training_config_issues(rows).select("o_orderkey", F.concat_ws("; ", "issues").alias("issues"))


@query("PRJ33_eval", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'missing n_envs' WHEN o_orderkey % 3 = 1 THEN 'invalid n_envs' END, CASE WHEN o_orderkey % 5 = 0 THEN 'missing model_path' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'unknown observation_ablation' END], lambda x: x IS NOT NULL), '; ') AS issues FROM orders""")
def prj33_eval(spark, sf):
    config = F.expr("""concat('{"environment":"sokoban","backend":"vllm","model_path":"', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'm' END, '","observation_ablation":"', CASE WHEN o_orderkey % 7 = 0 THEN 'blur' ELSE 'none' END, '"',
      CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ',"n_envs":0' ELSE ',"n_envs":5' END, '}')""")
    return C.evaluation_config_issues(table(spark, sf, "orders").withColumn("config", config)).select("o_orderkey", F.concat_ws("; ", "issues").alias("issues"))
