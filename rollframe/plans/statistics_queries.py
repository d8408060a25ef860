"""Experiment statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.functions import draws
from rollframe.functions import inference as I
from rollframe.operators import comparison, credit
from rollframe.operators import exploration as X
from rollframe.operators import statistics as S
from rollframe.plans import views
from rollframe.plans.catalog import ORACLES, query, r6, table

RUNS = views.EPISODES + """, runs AS (SELECT method, environment, seed, count(*) AS trials, sum(CASE WHEN success THEN 1 ELSE 0 END) AS successes,
  avg(num_turns) FILTER (success) AS mean_turns, sum(num_turns) FILTER (success) AS turn_sum, sum(num_turns) * 0.01 AS gpu_hours,
  max(num_turns) * 100.0 AS peak_vram_mib, sum(CASE WHEN success THEN 1 ELSE 0 END) / count(*) AS success_rate FROM episodes GROUP BY 1, 2, 3)"""
MODES = ["token", "turn", "trajectory"]
MODED = RUNS + """, moded AS (SELECT *, ['token', 'turn', 'trajectory', 'token', 'turn'][CAST(substr(method, 1, 1) AS INTEGER)] AS mode FROM runs)
, pooled AS (SELECT mode, sum(successes) AS s, sum(trials) AS n, sum(gpu_hours) AS h, sum(turn_sum) AS t FROM moded GROUP BY 1)"""


def runs(spark, sf):
    return S.run_results(views.episodes(spark, sf))


def with_mode(df):
    names = F.array(*[F.lit(m) for m in ("token", "turn", "trajectory", "token", "turn")])
    return df.withColumn("mode", comparison.objective_mode(
        F.element_at(names, F.substring("method", 1, 1).cast("int")), F.lit(None).cast("string"), F.col("method")))


_Z = "1.959963984540054"


def wilson_sql(s, n):
    mid = f"(({s}) / ({n}) + {_Z} * {_Z} / (2 * ({n}))) / (1 + {_Z} * {_Z} / ({n}))"
    half = f"{_Z} * sqrt((({s}) / ({n}) * (1 - ({s}) / ({n})) + {_Z} * {_Z} / (4 * ({n}))) / ({n})) / (1 + {_Z} * {_Z} / ({n}))"
    return f"greatest(0.0, {mid} - {half})", f"least(1.0, {mid} + {half})"


_LO, _HI = wilson_sql("s", "n")


@query("STA1", f"""WITH b AS (SELECT lang, CAST(sum(quality) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, CAST(s AS BIGINT) AS successes, CAST(n AS BIGINT) AS trials, {r6(_LO)} AS low, {r6(_HI)} AS high FROM b""")
def sta1(spark, sf):
    b = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(
        F.sum("quality").alias("successes"), F.count("*").alias("trials"))
    ci = I.wilson(F.col("successes"), F.col("trials"))
    return b.select("lang", "successes", "trials", ci["low"].alias("low"), ci["high"].alias("high"))


def bootstrap_sql(source: str, key: str, x: str, resamples: int = 10000) -> str:
    """Tables ``hist``, ``resampled`` and ``boot`` (key, n, mean, ci_low, ci_high) of a table with one row per value."""
    every = f"""(SELECT {key}, n, x, CAST(concat('0x', substr(md5(concat_ws('|', '42', {key}, txt)), 1, 7)) AS BIGINT) AS seed, b FROM hist, range({resamples}) r(b))"""
    return f"""hist AS (SELECT {key}, printf('%.12e', CAST({x} AS DOUBLE) + 0.0) AS txt, count(*) AS n, min(CAST({x} AS DOUBLE)) AS x FROM {source} GROUP BY 1, 2)
, resampled AS (SELECT {key}, b, sum(w * x) / nullif(sum(w), 0) AS m FROM ({draws.poisson_draws_sql(every, 'n', 'seed', 'b', 'w')}) GROUP BY 1, 2)
, ends AS (SELECT {key}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM resampled GROUP BY 1)
, boot AS (SELECT {key}, sum(n) AS n, sum(n * x) / sum(n) AS mean, CASE WHEN sum(n) = 1 THEN min(x) ELSE any_value(low) END AS ci_low, CASE WHEN sum(n) = 1 THEN min(x) ELSE any_value(high) END AS ci_high
  FROM hist JOIN ends USING ({key}) GROUP BY 1)"""


@query("STA2", f"""WITH {views.EPISODES}, won AS (SELECT * FROM episodes WHERE success), {bootstrap_sql('won', 'method', 'num_turns')}
SELECT method, CAST(n AS BIGINT) AS n, {r6('mean')} AS mean, {r6('ci_low')} AS ci_low, {r6('ci_high')} AS ci_high FROM boot""")
def sta2(spark, sf):
    won = views.episodes(spark, sf).filter("success")
    return S.bootstrap_mean(won, ["method"], "num_turns")


_D = """(avg(num_turns) FILTER (success) - avg(num_turns) FILTER (NOT success)) / sqrt(((count(*) FILTER (success) - 1) * var_samp(num_turns) FILTER (success)
 + (count(*) FILTER (NOT success) - 1) * var_samp(num_turns) FILTER (NOT success)) / (count(*) - 2))"""


@query("STA3", f"WITH {views.EPISODES} SELECT environment, {r6(_D)} AS cohens_d FROM episodes GROUP BY 1")
def sta3(spark, sf):
    won, t = F.col("success"), F.col("num_turns")
    agg = views.episodes(spark, sf).groupBy("environment").agg(*[
        e.alias(f"{n}{i}") for i, c in ((1, won), (2, ~won)) for n, e in (
            ("n", F.count_if(c)), ("m", F.avg(F.when(c, t))), ("v", F.var_samp(F.when(c, t))))])
    return agg.select("environment", I.cohens_d(*[F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")]).alias("cohens_d"))


@query("STA4", f"""WITH {views.EPISODES}, h AS (SELECT environment, num_turns AS x, CAST(count(*) FILTER (success) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT success) AS DOUBLE) AS b
  FROM episodes GROUP BY 1, 2), c AS (SELECT *, sum(b) OVER (PARTITION BY environment ORDER BY x) AS cb FROM h)
, s AS (SELECT environment, sum(a) AS n1, sum(b) AS n2, sum(a * (cb - b / 2)) AS u, sum(pow(a + b, 3) - (a + b)) AS t FROM c GROUP BY 1)
SELECT environment, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {r6('u')} AS u,
  {r6('(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1))))')} AS z FROM s""")
def sta4(spark, sf):
    return S.mann_whitney(views.episodes(spark, sf), ["environment"], "num_turns", "success").select("environment", "n1", "n2", "u", "z")


def tail_sql(source: str, key: str, top: str, density: str, steps: int = 4000) -> str:
    """Two-sided tail beyond ``top`` of a symmetric density in ``x``, by Simpson's rule over a table of keys."""
    return f"""SELECT {key}, greatest(0.0, least(1.0, 1 - 2 * any_value(top) / {3 * steps} * sum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density}))) AS p
  FROM (SELECT *, top * i / {steps} AS x FROM (SELECT *, least(greatest({top}, 0.0), 60.0) AS top FROM {source}), generate_series(0, {steps}) g(i)) GROUP BY 1"""


@query("STA4_p", f"""WITH {views.EPISODES}, h AS (SELECT environment, num_turns AS x, CAST(count(*) FILTER (success) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT success) AS DOUBLE) AS b
  FROM episodes GROUP BY 1, 2), c AS (SELECT *, sum(b) OVER (PARTITION BY environment ORDER BY x) AS cb FROM h)
, s AS (SELECT environment, sum(a) AS n1, sum(b) AS n2, sum(a * (cb - b / 2)) AS u, sum(pow(a + b, 3) - (a + b)) AS t FROM c GROUP BY 1)
, z AS (SELECT environment, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s)
, p AS ({tail_sql('z', 'environment', 'z', 'exp(-x * x / 2) / sqrt(2 * pi())')}) SELECT environment, {r6('p')} AS p_value FROM p""")
def sta4_p(spark, sf):
    return S.mann_whitney(views.episodes(spark, sf), ["environment"], "num_turns", "success").select("environment", "p_value")


_FISHER = """, lf AS (SELECT i, sum(CASE WHEN i = 0 THEN 0.0 ELSE ln(i) END) OVER (ORDER BY i) AS v FROM generate_series(0, (SELECT CAST(max(n1 + n2) AS BIGINT) FROM t)) g(i))
, terms AS (SELECT t.*, x, (SELECT v FROM lf WHERE i = n1) - (SELECT v FROM lf WHERE i = x) - (SELECT v FROM lf WHERE i = n1 - x)
   + (SELECT v FROM lf WHERE i = n2) - (SELECT v FROM lf WHERE i = k - x) - (SELECT v FROM lf WHERE i = n2 - k + x)
   - (SELECT v FROM lf WHERE i = n1 + n2) + (SELECT v FROM lf WHERE i = k) + (SELECT v FROM lf WHERE i = n1 + n2 - k) AS lp
   FROM (SELECT *, s1 + s2 AS k FROM t) t, unnest(generate_series(greatest(0, k - n2), least(k, n1))) u(x))
, obs AS (SELECT *, max(CASE WHEN x = s1 THEN lp END) OVER (PARTITION BY id) AS lo FROM terms)
, fisher AS (SELECT id, any_value(s1) AS s1, any_value(n1) AS n1, any_value(s2) AS s2, any_value(n2) AS n2,
   least(1.0, sum(CASE WHEN lp <= lo + ln(1 + 1e-7) THEN exp(lp) ELSE 0 END)) AS p FROM obs GROUP BY 1)"""


@query("STA5", f"""WITH t AS (SELECT lang AS id, CAST(sum(quality) AS BIGINT) AS s1, CAST(count(*) AS BIGINT) AS n1, CAST(sum(toxic) AS BIGINT) AS s2, CAST(count(*) AS BIGINT) AS n2
  FROM labels JOIN documents USING (doc_id) GROUP BY 1){_FISHER}
SELECT id AS lang, {r6('p')} AS p_value, {r6('s1 * (n2 - s2) / ((n1 - s1) * s2)')} AS odds_ratio FROM fisher""")
def sta5(spark, sf):
    b = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(
        F.sum("quality").alias("s1"), F.count("*").alias("n1"), F.sum("toxic").alias("s2"))
    args = [F.col("s1"), F.col("n1"), F.col("s2"), F.col("n1")]
    return b.select("lang", I.fisher_p(*args).alias("p_value"), I.odds_ratio(*args).alias("odds_ratio"))


_PAIR = """, t AS (SELECT concat(a.mode, '/', b.mode) AS id, a.mode AS m1, b.mode AS m2, CAST(a.s AS BIGINT) AS s1, CAST(a.n AS BIGINT) AS n1, CAST(b.s AS BIGINT) AS s2, CAST(b.n AS BIGINT) AS n2,
   a.h AS h1, b.h AS h2 FROM pooled a JOIN pooled b ON list_position(['token', 'turn', 'trajectory'], a.mode) < list_position(['token', 'turn', 'trajectory'], b.mode))"""
_L1, _H1 = wilson_sql("CAST(f.s1 AS DOUBLE)", "CAST(f.n1 AS DOUBLE)")
_L2, _H2 = wilson_sql("CAST(f.s2 AS DOUBLE)", "CAST(f.n2 AS DOUBLE)")


@query("STA6", f"""WITH {MODED}{_PAIR}{_FISHER}
SELECT m1 AS first, m2 AS second, {r6('f.s1 / f.n1')} AS rate1, {r6('f.s2 / f.n2')} AS rate2, {r6(_L1)} AS ci_low1, {r6(_H1)} AS ci_high1, {r6(_L2)} AS ci_low2, {r6(_H2)} AS ci_high2,
  {r6('f.s1 / f.n1 - f.s2 / f.n2')} AS difference, {r6('(f.s1 / f.n1) / (f.s2 / f.n2) - 1')} AS relative,
  {r6('CAST(f.s1 AS DOUBLE) * (f.n2 - f.s2) / (CAST(f.n1 - f.s1 AS DOUBLE) * f.s2)')} AS odds_ratio, {r6('p')} AS p_value, p < 0.05 AS significant
FROM fisher f JOIN t USING (id)""")
def sta6(spark, sf):
    return S.compare_success(with_mode(runs(spark, sf)), "mode", MODES).drop("s1", "n1", "s2", "n2")


@query("STA7", f"""WITH {views.EPISODES}, e AS (SELECT ['token', 'turn', 'trajectory', 'token', 'turn'][CAST(substr(method, 1, 1) AS INTEGER)] AS mode, CAST(num_turns AS DOUBLE) AS x FROM episodes WHERE success)
, {bootstrap_sql('e', 'mode', 'x')}
, v AS (SELECT mode, var_samp(x) AS v FROM e GROUP BY 1)
, c AS (SELECT mode, x, CAST(count(*) AS DOUBLE) AS c FROM e GROUP BY 1, 2)
, u AS (SELECT a.mode AS m1, b.mode AS m2, sum(a.c * b.c * CASE WHEN a.x > b.x THEN 1 WHEN a.x = b.x THEN 0.5 ELSE 0 END) AS u FROM c a JOIN c b ON a.mode <> b.mode GROUP BY 1, 2)
, t AS (SELECT m1, m2, sum(pow(k, 3) - k) AS t FROM (SELECT m1, m2, x, sum(c) AS k FROM u JOIN c ON mode IN (m1, m2) GROUP BY 1, 2, 3) GROUP BY 1, 2)
, w AS (SELECT concat(m1, '/', m2) AS id, m1, m2, u, a.n AS n1, b.n AS n2, a.mean AS mean1, b.mean AS mean2, a.ci_low AS ci_low1, a.ci_high AS ci_high1, b.ci_low AS ci_low2, b.ci_high AS ci_high2,
    (a.mean - b.mean) / sqrt(((a.n - 1) * va.v + (b.n - 1) * vb.v) / (a.n + b.n - 2)) AS d,
    (greatest(u, a.n * b.n - u) - a.n * b.n / 2 - 0.5) / sqrt(a.n * b.n / 12 * ((a.n + b.n + 1) - t / ((a.n + b.n) * (a.n + b.n - 1)))) AS z
  FROM u JOIN t USING (m1, m2) JOIN boot a ON a.mode = m1 JOIN boot b ON b.mode = m2 JOIN v va ON va.mode = m1 JOIN v vb ON vb.mode = m2
  WHERE list_position(['token', 'turn', 'trajectory'], m1) < list_position(['token', 'turn', 'trajectory'], m2))
, p AS ({tail_sql('w', 'id', 'z', 'exp(-x * x / 2) / sqrt(2 * pi())')})
SELECT m1 AS first, m2 AS second, CAST(n1 AS BIGINT) AS n1, {r6('mean1')} AS mean1, {r6('ci_low1')} AS ci_low1, {r6('ci_high1')} AS ci_high1, CAST(n2 AS BIGINT) AS n2, {r6('mean2')} AS mean2,
  {r6('ci_low2')} AS ci_low2, {r6('ci_high2')} AS ci_high2, {r6('u')} AS u, {r6('p')} AS p_value, {r6('d')} AS cohens_d,
  CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect, p < 0.05 AS significant FROM w JOIN p USING (id)""")
def sta7(spark, sf):
    return S.compare_turns(with_mode(views.episodes(spark, sf)), "mode", MODES)


@query("STA7_effect", f"""WITH {views.EPISODES}, e AS (SELECT ['token', 'turn', 'trajectory', 'token', 'turn'][CAST(substr(method, 1, 1) AS INTEGER)] AS mode, CAST(num_turns AS DOUBLE) AS x FROM episodes WHERE success)
, m AS (SELECT mode, count(*) AS n, avg(x) AS mu, var_samp(x) AS v FROM e GROUP BY 1)
, h AS (SELECT mode, x, CAST(count(*) AS DOUBLE) AS c FROM e GROUP BY 1, 2)
, u AS (SELECT a.mode AS m1, b.mode AS m2, sum(a.c * b.c * CASE WHEN a.x > b.x THEN 1 WHEN a.x = b.x THEN 0.5 ELSE 0 END) AS u FROM h a JOIN h b ON a.mode <> b.mode GROUP BY 1, 2)
SELECT a.mode AS first, b.mode AS second, {r6('a.mu')} AS mean1, {r6('b.mu')} AS mean2, {r6('u')} AS u,
  {r6('(a.mu - b.mu) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))')} AS cohens_d
FROM m a JOIN m b ON list_position(['token', 'turn', 'trajectory'], a.mode) < list_position(['token', 'turn', 'trajectory'], b.mode) JOIN u ON u.m1 = a.mode AND u.m2 = b.mode""")
def sta7_effect(spark, sf):
    return S.compare_turns(with_mode(views.episodes(spark, sf)), "mode", MODES).select(
        "first", "second", "mean1", "mean2", "u", "cohens_d")


_INF = "CAST('inf' AS DOUBLE)"


# Runs of one method have no hours on record.
@query("STA8", f"""WITH {RUNS}, h AS (SELECT * EXCLUDE (gpu_hours), CASE WHEN method LIKE '5%' THEN 0 ELSE gpu_hours END AS gpu_hours FROM runs)
SELECT method, environment, seed, {r6('CASE WHEN gpu_hours > 0 THEN success_rate / gpu_hours ELSE 0 END')} AS success_per_gpu_hour,
  {r6(f'CASE WHEN gpu_hours > 0 THEN gpu_hours / greatest(success_rate, 1e-6) ELSE {_INF} END')} AS gpu_hours_per_success_point FROM h""")
def sta8(spark, sf):
    hours = F.when(F.col("method").startswith("5"), 0.0).otherwise(F.col("gpu_hours"))
    return runs(spark, sf).select("method", "environment", "seed", I.efficiency(F.col("success_rate"), hours).alias("e")).select(
        "method", "environment", "seed", "e.*")


def pair_verdicts(spark, sf):
    moded = with_mode(runs(spark, sf))
    success = S.compare_success(moded, "mode", MODES)
    eff = moded.groupBy("mode").agg((F.sum("successes") / F.sum("trials") / F.avg("gpu_hours")).alias("e"))
    joined = success.join(eff.select(F.col("mode").alias("first"), F.col("e").alias("e1")), "first").join(
        eff.select(F.col("mode").alias("second"), F.col("e").alias("e2")), "second")
    return S.verdict(joined, F.col("e1") / F.col("e2"))


_VERDICT = f"""WITH {MODED}{_PAIR}{_FISHER}, eff AS (SELECT mode, sum(successes) / sum(trials) / avg(gpu_hours) AS e FROM moded GROUP BY 1)
, v AS (SELECT m1, m2, p, f.s1 / f.n1 - f.s2 / f.n2 AS d, e1.e / e2.e AS ratio FROM fisher f JOIN t USING (id) JOIN eff e1 ON e1.mode = m1 JOIN eff e2 ON e2.mode = m2)
SELECT m1 AS first, m2 AS second, {r6('ratio')} AS efficiency_ratio, concat_ws('; ', CASE WHEN p < 0.05 THEN concat(CASE WHEN d > 0 THEN m1 ELSE m2 END, ' has significantly higher success rate (p=', printf('%.3f', p), ')')
  ELSE 'No significant difference in success rates' END, CASE WHEN ratio > 1.2 THEN concat(m1, ' is ', printf('%.1f', ratio), 'x more compute-efficient')
  WHEN ratio < 0.833 THEN concat(m2, ' is ', printf('%.1f', 1 / ratio), 'x more compute-efficient') END) AS verdict FROM v"""


@query("STA9", _VERDICT)
def sta9(spark, sf):
    return pair_verdicts(spark, sf).select("first", "second", (F.col("e1") / F.col("e2")).alias("efficiency_ratio"), "verdict")


_AGG = f"""SELECT method, environment, CAST(count(*) AS BIGINT) AS n_seeds, {r6('avg(success_rate)')} AS success_mean, {r6('coalesce(stddev_samp(success_rate), 0)')} AS success_std,
  {r6('sum(successes) / sum(trials)')} AS success_pooled, CAST(sum(successes) AS BIGINT) AS total_successes, CAST(sum(trials) AS BIGINT) AS total_trials,
  {r6('avg(mean_turns)')} AS turns_mean, {r6('coalesce(stddev_samp(mean_turns), 0)')} AS turns_std, {r6('sum(turn_sum) / nullif(sum(successes), 0)')} AS turns_pooled,
  {r6('avg(gpu_hours)')} AS gpu_hours_mean, {r6('coalesce(stddev_samp(gpu_hours), 0)')} AS gpu_hours_std, {r6('sum(gpu_hours)')} AS gpu_hours_total,
  {r6('max(peak_vram_mib)')} AS peak_vram_max, CASE WHEN count(*) < 3 THEN 'unexpected seed set' ELSE '' END AS issues FROM runs GROUP BY 1, 2"""


@query("STA10", f"WITH {RUNS} {_AGG}")
def sta10(spark, sf):
    return S.seed_aggregate(runs(spark, sf), ["method", "environment"], [0, 1, 2]).withColumn("issues", F.concat_ws("; ", "issues"))


@query("STA11", f"""WITH {RUNS}, a AS (SELECT method, environment, round(sum(successes) / sum(trials), 9) AS r FROM runs GROUP BY 1, 2)
SELECT method, (SELECT environment FROM a b WHERE b.method = a.method ORDER BY r DESC, environment LIMIT 1) AS easier,
  (SELECT environment FROM a b WHERE b.method = a.method ORDER BY coalesce(nullif(r, 0), 1), environment LIMIT 1) AS harder, {r6('max(r) - min(r)')} AS gap FROM a GROUP BY 1""")
def sta11(spark, sf):
    agg = S.seed_aggregate(runs(spark, sf), ["method", "environment"]).withColumn("success_pooled", F.round("success_pooled", 9))
    return S.environment_gap(agg)


@query("STA12", f"""WITH {RUNS}, g AS (SELECT method, environment, seed, grouping_id(method, environment, seed) AS gid, count(*) AS n, avg(success_rate) AS m, sum(successes) / sum(trials) AS p,
  sum(gpu_hours) AS h, count(DISTINCT method) AS dm, count(DISTINCT environment) AS de FROM runs GROUP BY GROUPING SETS ((method), (environment), (seed)))
SELECT CASE gid WHEN 3 THEN 'method' WHEN 5 THEN 'environment' ELSE 'seed' END AS group_by, coalesce(method, environment, CAST(seed AS VARCHAR)) AS group_key,
  CAST(n AS BIGINT) AS runs, {r6('m')} AS success_mean, {r6('p')} AS success_pooled, {r6('h')} AS gpu_hours_total,
  concat_ws('; ', CASE WHEN dm > 1 THEN 'multiple methods' END, CASE WHEN de > 1 THEN 'multiple environments' END) AS issues FROM g""")
def sta12(spark, sf):
    return S.matrix_aggregate(runs(spark, sf)).withColumn("issues", F.concat_ws("; ", "issues"))


# Runs of one method have no successes, those of another one seed.
@query("STA13", f"""WITH {RUNS}, r AS (SELECT method, environment, seed, CASE WHEN method LIKE '5%' THEN 0 ELSE success_rate END AS success_rate, CASE WHEN method NOT LIKE '5%' THEN mean_turns END AS mean_turns
  FROM runs WHERE method NOT LIKE '4%' OR seed = 0)
, s AS (SELECT method, environment, count(*) AS n, CASE WHEN avg(success_rate) > 0 THEN stddev_samp(success_rate) / avg(success_rate) ELSE {_INF} END AS cv,
  CASE WHEN avg(mean_turns) > 0 THEN stddev_samp(mean_turns) / avg(mean_turns) ELSE {_INF} END AS tcv, min(success_rate) AS lo, max(success_rate) AS hi FROM r GROUP BY 1, 2)
SELECT method, environment, {r6('CASE WHEN n >= 2 THEN cv END')} AS success_rate_cv, {r6('CASE WHEN n >= 2 THEN tcv END')} AS mean_turns_cv,
  {r6('CASE WHEN n >= 2 THEN hi - lo END')} AS success_rate_range, {r6('CASE WHEN n >= 2 THEN lo END')} AS success_rate_min, {r6('CASE WHEN n >= 2 THEN hi END')} AS success_rate_max,
  CASE WHEN n < 2 THEN 'insufficient_seeds' WHEN cv < 0.1 THEN 'highly_stable' WHEN cv < 0.2 THEN 'stable' WHEN cv < 0.5 THEN 'moderate_variance' ELSE 'high_variance' END AS interpretation
FROM s""")
def sta13(spark, sf):
    none = F.col("method").startswith("5")
    some = runs(spark, sf).filter(~F.col("method").startswith("4") | (F.col("seed") == 0))
    return S.seed_stability(some.withColumn("success_rate", F.when(none, 0.0).otherwise(F.col("success_rate"))).withColumn(
        "mean_turns", F.when(~none, F.col("mean_turns"))), ["method", "environment"])


@query("STA14", f"""WITH {MODED}, a AS (SELECT mode, s / n AS r, s / n / h AS e, t / s AS t FROM pooled)
SELECT mode, {r6('r')} AS success_pooled, {r6('e')} AS compute_efficiency, {r6('t')} AS turns_pooled, CAST(rank() OVER (ORDER BY r DESC) AS INTEGER) AS rank_success,
  CAST(rank() OVER (ORDER BY e DESC) AS INTEGER) AS rank_efficiency, CAST(rank() OVER (ORDER BY t) AS INTEGER) AS rank_turns FROM a""")
def sta14(spark, sf):
    return S.rank_modes(S.seed_aggregate(with_mode(runs(spark, sf)), ["mode"]), "mode")


@query("STA15", f"""SELECT first, second, efficiency_ratio, verdict, mean1, mean2, u, cohens_d
FROM ({_VERDICT}) JOIN ({ORACLES["STA7_effect"]}) USING (first, second)""")
def sta15(spark, sf):
    """Success verdict and turn comparison of every pair of modes."""
    return sta9(spark, sf).join(sta7_effect(spark, sf), ["first", "second"])


@query("STA16", f"""WITH g AS (SELECT event_type AS mode, value AS v FROM events WHERE event_id % 3 <> 0)
, s AS (SELECT mode, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.5) AS median, max(v) AS max, count(*) AS n FROM g GROUP BY 1)
SELECT mode, {r6('mean')} AS mean, {r6('std')} AS std, {r6('median')} AS median, {r6('max')} AS max, {r6('std / mean')} AS cv, CAST(n AS BIGINT) AS n_samples,
  std / mean = min(std / mean) OVER () AS most_stable FROM s""")
def sta16(spark, sf):
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("step:1 loss:"), F.col("value").cast("string"))).otherwise(
        F.concat(F.lit("step:9 actor_grad_norm: "), F.col("value").cast("string"), F.lit(", lr:0.1")))
    log = table(spark, sf, "events").select(F.col("event_type").alias("mode"), line.alias("line"))
    return S.gradient_stability(log, "mode", "line")


_STATUS = "CASE seed WHEN 0 THEN 'complete' WHEN 1 THEN CASE WHEN environment = 'BUILDING' THEN 'failed' ELSE 'complete' END ELSE 'incomplete-artifacts' END"


@query("STA17", f"""WITH {RUNS}, s AS (SELECT *, {_STATUS} AS status FROM runs), m AS (SELECT method, round(sum(successes) / sum(trials), 9) AS r FROM s WHERE status = 'complete' GROUP BY 1)
, b AS (SELECT method, r FROM m ORDER BY r DESC, method DESC LIMIT 1)
SELECT CAST(count(*) AS BIGINT) AS total_runs, CAST(count(*) FILTER (status = 'complete') AS BIGINT) AS complete_runs, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed_runs,
  CAST(count(*) FILTER (status = 'incomplete-artifacts') AS BIGINT) AS incomplete_runs, {r6('sum(gpu_hours)')} AS total_gpu_hours, (SELECT method FROM b) AS best_method, {r6('(SELECT r FROM b)')} AS best_rate,
  concat_ws('; ', concat('best method: ', (SELECT method FROM b)), CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN concat(count(*) FILTER (status = 'failed'), ' failed runs') END, 'matrix is incomplete') AS key_findings FROM s""")
def sta17(spark, sf):
    return S.experiment_overview(runs(spark, sf).withColumn("status", F.expr(_STATUS)))


_PAIRED = """pk AS (SELECT user_id AS seed, sum(value) FILTER (event_id % 2 = 0) AS packed, sum(value) FILTER (event_id % 2 = 1) AS split,
  max(value) FILTER (event_id % 2 = 0) AS pmax, max(value) FILTER (event_id % 2 = 1) AS smax FROM events GROUP BY 1)"""


def paired(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("seed"), F.when(F.col("event_id") % 2 == 0, "packed").otherwise("split").alias("packing")).agg(
        F.sum("value").alias("reward"), F.max("value").alias("score"))
    return S.paired_deltas(rows, "seed", "packing", ["reward", "score"])


@query("JOIN16", f"WITH {_PAIRED} SELECT seed, {r6('split - packed')} AS reward_delta, {r6('smax - pmax')} AS score_delta FROM pk")
def join16(spark, sf):
    return paired(spark, sf)


@query("STA18", f"""WITH {_PAIRED} SELECT {r6('avg(split - packed)')} AS mean_delta, {r6('min(split - packed)')} AS min_delta, {r6('max(split - packed)')} AS max_delta,
  {r6('avg(CASE WHEN split - packed > 0 THEN 1 ELSE 0 END)')} AS positive_share FROM pk WHERE split - packed IS NOT NULL""")
def sta18(spark, sf):
    return S.bias_report(paired(spark, sf), "reward_delta")


@query("STA19", f"""WITH {views.TRAJ} SELECT run, {r6('sum(turns.tokens) / (SELECT sum(tokens) FROM turns)')} AS token,
  {r6('count(*) / (SELECT count(*) FROM turns)')} AS turn, {r6('sum(turns.tokens / traj.tokens) / (SELECT count(*) FROM traj)')} AS trajectory
FROM turns JOIN (SELECT group_idx, traj_idx, tokens FROM traj) traj USING (group_idx, traj_idx) GROUP BY 1""")
def sta19(spark, sf):
    rows = views.turns(spark, sf)
    out = None
    for mode in MODES:
        mass = credit.weight_mass(credit.loss_weights(rows, mode), "run").withColumnRenamed("mass", mode)
        out = mass if out is None else out.join(mass, "run")
    return out


@query("STA20", f"""WITH {views.EPISODES} SELECT environment, CAST(count(*) AS BIGINT) AS n, {r6('corr(num_turns, cumulative_reward)')} AS r FROM episodes GROUP BY 1""")
def sta20(spark, sf):
    return S.pearson(views.episodes(spark, sf), ["environment"], "num_turns", "cumulative_reward").drop("p_value")


@query("STA20_p", f"""WITH {views.EPISODES}, r AS (SELECT environment, CAST(count(*) - 2 AS DOUBLE) AS v, corr(num_turns, cumulative_reward) AS r FROM episodes GROUP BY 1)
, t AS (SELECT environment, v, abs(r) * sqrt(v / (1 - r * r)) AS t FROM r)
, p AS ({tail_sql('t', 'environment', 't', 'exp(lgamma((v + 1) / 2) - lgamma(v / 2) - (v + 1) / 2 * ln(1 + x * x / v)) / sqrt(v * pi())')}) SELECT environment, {r6('p')} AS p_value FROM p""")
def sta20_p(spark, sf):
    return S.pearson(views.episodes(spark, sf), ["environment"], "num_turns", "cumulative_reward").select("environment", "p_value")


@query("STA21", f"""WITH a AS (SELECT user_id AS sample, event_type AS task, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2)
, long AS (SELECT sample, task, s / n AS v FROM a UNION ALL SELECT sample, 'avg_accuracy', sum(s) / sum(n) FROM a WHERE task <> 'error' GROUP BY 1
  UNION ALL SELECT user_id, 'final_information_gain', arg_max(value, event_id) FROM events GROUP BY 1)
, score AS (SELECT user_id AS sample, CAST(sum(event_id % 17) AS DOUBLE) AS score FROM events GROUP BY 1)
SELECT task, CAST(count(*) AS BIGINT) AS n, {r6('corr(score, v)')} AS r FROM long JOIN score USING (sample) GROUP BY 1""")
def sta21(spark, sf):
    e = table(spark, sf, "events").withColumn("sample", F.col("user_id")).withColumn(
        "task", F.when(F.col("event_type") == "error", "rot_dual").otherwise(F.col("event_type")))
    acc = X.sample_accuracy(e, score="value").withColumn("value", F.col("avg_accuracy"))
    score = e.groupBy("sample").agg(F.sum(F.col("event_id") % 17).cast("double").alias("value"))
    gain = e.groupBy("sample").agg(F.max_by("value", "event_id").alias("value"))
    out = S.correlation_table(score, acc.filter("task <> 'overall'"), acc.filter("task = 'overall'"), gain)
    return out.drop("p_value").withColumn("task", F.when(F.col("task") == "rot_dual", "error").otherwise(F.col("task")))


@query("JOIN15", f"""WITH {MODED}{_PAIR} SELECT m1 AS first, m2 AS second, s1, n1, s2, n2 FROM t""")
def join15(spark, sf):
    return S.compare_success(with_mode(runs(spark, sf)), "mode", MODES).select("first", "second", "s1", "n1", "s2", "n2")
