"""Episode, failure and template queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.functions import text as X
from rollframe.operators import episodes as E
from rollframe.operators import trajectories
from rollframe.plans import views
from rollframe.plans.catalog import query, r6, table
from rollframe.plans.text_queries import BODY, TALK, _template, transcripts

_SUMMARY = f"""CAST(count(*) AS BIGINT) AS episodes, {r6('avg(CASE WHEN success THEN 1 ELSE 0 END)')} AS success_rate,
  {r6('avg(num_turns)')} AS mean_turns, {r6('avg(num_turns) FILTER (success)')} AS mean_turns_successful,
  {r6('avg(cumulative_reward)')} AS mean_cumulative_reward,
  {r6('1 - sum(valid_action_count) / sum(action_check_count)')} AS invalid_action_fraction,
  CAST(sum(action_check_count) AS BIGINT) AS action_checks,
  {r6('corr(num_turns, cumulative_reward)')} AS reward_turn_correlation,
  {r6('regr_slope(cumulative_reward, num_turns)')} AS reward_per_extra_turn_slope"""


@query("EVA1", f"WITH {views.EPISODES} SELECT {_SUMMARY} FROM episodes")
def eva1(spark, sf):
    return E.summarize(views.episodes(spark, sf))


@query("EVA2", f"""WITH {views.EPISODES} SELECT CASE WHEN grouping(observation_ablation) = 1 THEN 'all' ELSE observation_ablation END AS observation_ablation,
  CAST(count(*) AS BIGINT) AS episodes, {r6('avg(CASE WHEN success THEN 1 ELSE 0 END)')} AS success_rate,
  {r6('avg(num_turns) FILTER (success)')} AS mean_turns_successful FROM episodes GROUP BY ROLLUP (observation_ablation)""")
def eva2(spark, sf):
    return E.summarize_with_total(views.episodes(spark, sf), "observation_ablation")


@query("EVA3", f"""WITH {TALK}, b AS (SELECT role, {BODY} AS body FROM talk), c AS (
  SELECT role, {_template('body')} AS t, count(*) AS n FROM b GROUP BY 1, 2)
SELECT role, {r6('max(n) / sum(n)')} AS concentration, {r6('count(*) / sum(n)')} AS unique_fraction FROM c WHERE t <> '' GROUP BY 1""")
def eva3(spark, sf):
    return E.template_concentration(transcripts(spark, sf), X.answer_template(F.col("response")), "role")


@query("EVA4", f"""WITH {views.EPISODES} SELECT environment, {r6('corr(num_turns, cumulative_reward)')} AS reward_turn_correlation,
  {r6('regr_slope(cumulative_reward, num_turns)')} AS reward_per_extra_turn_slope FROM episodes GROUP BY 1""")
def eva4(spark, sf):
    return E.summarize(views.episodes(spark, sf), "environment").select(
        "environment", "reward_turn_correlation", "reward_per_extra_turn_slope")


@query("EVA5", f"""WITH {views.EPISODES} SELECT rollout_id, seed, finish_reason, num_turns, {r6('cumulative_reward')} AS cumulative_reward,
  valid_action_count, action_check_count, observation_ablation FROM episodes WHERE NOT success
  ORDER BY (finish_reason IN ('model_error', 'env_error', 'error')) DESC, num_turns DESC, round(cumulative_reward, 9) DESC, rollout_id LIMIT 10""")
def eva5(spark, sf):
    return E.representative_failures(views.episodes(spark, sf)).select(
        "rollout_id", "seed", "finish_reason", "num_turns", "cumulative_reward", "valid_action_count", "action_check_count",
        "observation_ablation")


@query("EVA6", f"""WITH {views.PADDED}, t AS (SELECT group_idx, traj_idx, round(sum(score), 6) AS reward, count(*) AS turns, bool_or(traj_success) AS success
  FROM turns GROUP BY 1, 2), g AS (SELECT var_pop(reward) AS v, max(reward) = min(reward) AS flat FROM t GROUP BY group_idx HAVING count(*) >= 2)
, c AS (SELECT lower(output) AS o, count(*) AS n FROM padded GROUP BY 1)
SELECT CAST((SELECT count(*) FROM padded) AS BIGINT) AS rows, CAST((SELECT count(*) FROM turns) AS BIGINT) AS unique_rows,
  CAST((SELECT count(*) FROM padded WHERE copy_no = 1) AS BIGINT) AS padding_duplicates, CAST(count(*) AS BIGINT) AS trajectories,
  CAST(count(DISTINCT group_idx) AS BIGINT) AS groups, {r6('avg(CASE WHEN success THEN 1 ELSE 0 END)')} AS success_rate,
  {r6('avg(turns) FILTER (success)')} AS mean_turns_successful, {r6('corr(turns, reward)')} AS reward_turn_correlation,
  {r6('regr_slope(reward, turns)')} AS reward_per_extra_turn_slope, {r6('(SELECT avg(v) FROM g)')} AS mean_group_reward_variance,
  {r6('(SELECT avg(CASE WHEN flat THEN 1 ELSE 0 END) FROM g)')} AS zero_variance_group_fraction,
  {r6('(SELECT 1 - avg(CASE WHEN action_is_valid THEN 1 ELSE 0 END) FROM padded)')} AS invalid_action_fraction,
  {r6('(SELECT max(n) / sum(n) FROM c)')} AS concentration, {r6('(SELECT count(*) / sum(n) FROM c)')} AS unique_fraction FROM t""")
def eva6(spark, sf):
    return E.training_summary(views.turns_padded(spark, sf))


@query("EVA9", f"""WITH {views.EPISODES} SELECT CASE WHEN grouping(method) = 1 THEN 'all' ELSE method END AS method, CAST(count(*) AS BIGINT) AS n_episodes,
  {r6('avg(CASE WHEN success THEN 1 ELSE 0 END)')} AS success_rate, {r6('avg(cumulative_reward)')} AS avg_cumulative_reward,
  {r6('avg(num_turns)')} AS avg_turns, CAST(count(*) FILTER (finish_reason NOT IN ('done', 'max_turns', 'skipped_resume')) AS BIGINT) AS error_rollouts
FROM episodes GROUP BY ROLLUP (method)""")
def eva9(spark, sf):
    return E.tag_summary(views.episodes(spark, sf), "method")


@query("EVA9_errors", f"""WITH {views.EPISODES} SELECT method, rollout_id, finish_reason FROM episodes
WHERE finish_reason NOT IN ('done', 'max_turns', 'skipped_resume')""")
def eva9_errors(spark, sf):
    return E.error_rollouts(views.episodes(spark, sf), "method")


@query("EVA10", f"""WITH {views.TRAJ}, long AS (
  SELECT run, group_idx, 'reward' AS variable, round(reward, 6) AS x FROM traj UNION ALL
  SELECT run, group_idx, 'acc', CASE WHEN success THEN 1.0 ELSE 0.0 END FROM traj)
, numbered AS (SELECT *, row_number() OVER (PARTITION BY run, group_idx, variable ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY run, group_idx, variable) AS n FROM long)
, sets AS (SELECT *, unnest(range(1, CAST(1 AS BIGINT) << n)) AS mask FROM (SELECT run, group_idx, variable, any_value(n) AS n FROM numbered GROUP BY 1, 2, 3))
, wanted AS (SELECT *, bit_count(mask) AS size FROM sets WHERE bit_count(mask) = n OR bit_count(bit_count(mask)) = 1)
, votes AS (SELECT w.run, w.group_idx, w.variable, w.n, size, mask, x, count(*) AS c FROM wanted w JOIN numbered m ON w.run = m.run AND w.group_idx = m.group_idx AND w.variable = m.variable AND (mask >> i) & 1 = 1 GROUP BY ALL)
, won AS (SELECT run, group_idx, variable, n, size, mask, max(x) AS best, arg_max(x, c * 1000000.0 + x) AS maj, sum(x * c) / sum(c) AS mean FROM votes GROUP BY ALL)
, per AS (SELECT run, group_idx, variable, size, avg(best) AS best, avg(maj) AS maj, avg(mean) FILTER (size = n) AS mean FROM won GROUP BY ALL)
, a AS (SELECT run, variable, size, avg(mean) AS mean, avg(best) AS best, avg(maj) AS maj, max(size) OVER (PARTITION BY run, variable) AS top FROM per GROUP BY 1, 2, 3)
, z AS (SELECT *, 'mean' AS m, mean AS v FROM a UNION ALL SELECT *, 'best', best FROM a UNION ALL SELECT *, 'maj', maj FROM a)
SELECT concat(CASE WHEN variable = 'acc' AND size = top THEN 'val-core' ELSE 'val-aux' END, '/', run, '/', variable, '/', m, '@', size) AS metric,
  {r6('v')} AS metric_value FROM z WHERE v IS NOT NULL""")
def eva10(spark, sf):
    records = trajectories.trajectory_records(views.turns(spark, sf))
    run = views.turns(spark, sf).filter("turn_idx = 1").select(*trajectories.TRAJECTORY, "run")
    rows = records.join(run, trajectories.TRAJECTORY).select(
        "run", "group_idx", F.round("reward", 6).alias("reward"), F.col("success").cast("double").alias("acc"))
    return E.validation_metrics(rows, "run", "group_idx", ["reward", "acc"])


@query("EVA10_turns", f"""WITH {views.TRAJ} SELECT run, CAST(min(turns) AS BIGINT) AS turns_min, CAST(max(turns) AS BIGINT) AS turns_max, {r6('avg(turns)')} AS turns_mean
FROM traj GROUP BY 1""")
def eva10_turns(spark, sf):
    per = views.turns(spark, sf).groupBy("run", *trajectories.TRAJECTORY).agg(F.count("*").alias("n"))
    return per.groupBy("run").agg(F.min("n").alias("turns_min"), F.max("n").alias("turns_max"), F.avg("n").alias("turns_mean"))


@query("EVA11", """SELECT doc_id, lang FROM documents ORDER BY md5(concat('42:', concat(lang, doc_id))), concat(lang, doc_id) LIMIT 25""")
def eva11(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.concat("lang", "doc_id").alias("t"))
    return E.sample_for_logging(rows, "t", 25).drop("t")


@query("EVA12", f"""WITH {views.TRAJ} SELECT run, step, {r6('avg(CASE WHEN success THEN 1 ELSE 0 END)')} AS success_rate,
  {r6('avg(turns) FILTER (success)')} AS mean_turns_successful, {r6('avg(reward)')} AS mean_reward FROM traj GROUP BY 1, 2""")
def eva12(spark, sf):
    per = views.turns(spark, sf).groupBy("run", "step", *trajectories.TRAJECTORY).agg(
        F.count("*").alias("turns"), F.sum("score").alias("reward"), F.bool_or("traj_success").alias("success"))
    return E.learning_curve(per)


@query("EVA13", f"""WITH {views.EPISODES}, x AS (SELECT environment, round(cumulative_reward, 6) * 1000 + num_turns / 7.0 AS r FROM episodes)
, e AS (SELECT environment, min(r) AS lo, max(r) AS hi FROM x GROUP BY 1)
SELECT environment, CAST(least(floor((r - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM x JOIN e USING (environment) GROUP BY 1, 2""")
def eva13(spark, sf):
    rows = views.episodes(spark, sf).select("environment", (F.round("cumulative_reward", 6) * 1000 + F.col("num_turns") / 7.0).alias("r"))
    return E.reward_histogram(rows, "environment", "r")


FAIL = views.EPISODES + """, classed AS (SELECT *, CASE WHEN success THEN 'success'
  WHEN finish_reason IN ('model_error', 'env_error', 'error') THEN 'infrastructure_error'
  WHEN action_check_count > 0 AND valid_action_count = 0 THEN 'all_actions_invalid'
  WHEN action_check_count > 0 AND valid_action_count < action_check_count THEN 'frequent_invalid_actions'
  WHEN finish_reason = 'max_turns' THEN CASE WHEN cumulative_reward > 0.5 THEN 'timeout_with_high_progress'
       WHEN cumulative_reward >= 0.1 THEN 'timeout_with_partial_progress' ELSE 'timeout_with_no_progress' END
  WHEN num_turns < 3 THEN 'early_termination' WHEN num_turns > 10 AND cumulative_reward < 0.1 THEN 'stalled_no_progress'
  ELSE 'other_failure' END AS category
  FROM (SELECT * REPLACE (round(cumulative_reward, 6) AS cumulative_reward,
        CASE WHEN episode % 5 = 0 AND finish_reason = 'max_turns' THEN 'stopped' ELSE finish_reason END AS finish_reason) FROM episodes))"""


def failing(spark, sf):
    return views.episodes(spark, sf).withColumn("cumulative_reward", F.round("cumulative_reward", 6)).withColumn(
        "finish_reason", F.when((F.col("episode") % 5 == 0) & (F.col("finish_reason") == "max_turns"), "stopped")
        .otherwise(F.col("finish_reason")))


@query("FAI1", f"WITH {FAIL} SELECT rollout_id, category FROM classed")
def fai1(spark, sf):
    return failing(spark, sf).select("rollout_id", E.failure_class().alias("category"))


@query("FAI2", f"""WITH {FAIL}, c AS (SELECT category, count(*) AS n FROM classed GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_episodes, CAST(sum(n) FILTER (category <> 'success') AS BIGINT) AS total_failures,
  {r6("sum(n) FILTER (category <> 'success') / sum(n)")} AS failure_rate,
  {r6("coalesce(sum(n) FILTER (category = 'infrastructure_error'), 0) / sum(n)")} AS infrastructure_error_rate,
  {r6("sum(n) FILTER (category NOT IN ('success', 'infrastructure_error')) / sum(n)")} AS actionable_failure_rate,
  (SELECT category FROM c WHERE category <> 'success' ORDER BY n DESC, category LIMIT 1) AS most_common_failure FROM c""")
def fai2(spark, sf):
    return E.failure_patterns(failing(spark, sf))


@query("FAI2_details", f"""WITH {FAIL} SELECT category, rollout_id, seed, num_turns, {r6('cumulative_reward')} AS cumulative_reward, finish_reason
FROM classed WHERE category <> 'success'""")
def fai2_details(spark, sf):
    return E.failure_details(failing(spark, sf))


# The documents carry no error words, so the query looks for words they do have.
WORDS = ["license", "copyright", "password", "key", "http", "error"]
_HIT = " OR ".join(f"contains(line, '{w}')" for w in WORDS)
ERRORS = rf"""lines AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line FROM documents), pat AS (
  SELECT doc_id, {{strip}} AS pattern FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(line,
    '\d{{{{4}}}}-\d{{{{2}}}}-\d{{{{2}}}}', '', 'g'), '\b\d+\b', '<N>', 'g'), '/[^\s]+', '<PATH>', 'g') AS p FROM lines WHERE {_HIT}))
, top AS (SELECT pattern, count(*) AS lines FROM pat WHERE pattern <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""".format(
    strip=r"regexp_replace(p, '^\s+|\s+$', '', 'g')").replace("{{", "{").replace("}}", "}")


@query("FAI3", f"""WITH {ERRORS}, src AS (SELECT pattern, doc_id, row_number() OVER (PARTITION BY pattern ORDER BY doc_id) AS r
  FROM (SELECT DISTINCT pattern, doc_id FROM pat))
SELECT pattern, CAST(lines AS BIGINT) AS lines, (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM src WHERE src.pattern = top.pattern AND r <= 3) AS examples
FROM top""")
def fai3(spark, sf):
    lines = E.error_lines(table(spark, sf, "documents"), "text", "doc_id", WORDS)
    return E.top_error_patterns(lines).select("pattern", "lines", F.concat_ws(",", F.col("examples").cast("array<string>")).alias("examples"))


LOOPS = f"""WITH ev AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'left' WHEN 'purchase' THEN 'right' WHEN 'signup' THEN 'right' ELSE 'unknown' END AS action FROM events)
, m AS (SELECT *, CASE WHEN lag(action) OVER w IS DISTINCT FROM action THEN 1 ELSE 0 END AS new_ FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
, i AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
, r AS (SELECT user_id, island, any_value(action) AS action, count(*) AS n FROM i GROUP BY 1, 2)
, l AS (SELECT user_id, max(n) AS max_repetition, arg_max(action, n * 1000000 - island) AS repeated_action, sum(n) AS texts FROM r GROUP BY 1)"""


def runs(spark, sf):
    said = F.element_at(F.create_map(*[F.lit(x) for x in (
        "click", "Go LEFT!", "purchase", "right turn", "signup", "<answer>Right</answer>", "view", "look", "error", "...")]), F.col("event_type"))
    return E.longest_runs(table(spark, sf, "events"), "user_id", "event_id", X.action_word(said))


@query("FAI4", LOOPS + """ SELECT user_id, CAST(max_repetition AS BIGINT) AS max_repetition, repeated_action, CAST(texts AS BIGINT) AS texts
FROM l WHERE texts >= 4 AND max_repetition >= 4""")
def fai4(spark, sf):
    return E.repetition_loops(runs(spark, sf), 4)


@query("FAI4_rate", LOOPS + f""" SELECT CAST(count(*) AS BIGINT) AS total_episodes, CAST(count(*) FILTER (max_repetition >= 4) AS BIGINT) AS episodes_with_loops,
  {r6('count(*) FILTER (max_repetition >= 4) / count(*)')} AS loop_rate FROM l""")
def fai4_rate(spark, sf):
    found = runs(spark, sf)
    return E.loop_summary(found, E.repetition_loops(found, 4))
