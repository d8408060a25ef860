"""Trajectory, credit, group and parity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.distributed import affine_suffix, row_numbers, with_row
from rollframe.functions import tokens as T
from rollframe.operators import credit, groups, parity, trajectories
from rollframe.plans import views
from rollframe.plans.catalog import query, r6, table
from rollframe.session import stage

PAYLOAD = ["score", "output", "last_turn", "traj_success"]


def scored(spark, sf, mode="bounded_process"):
    return credit.trajectory_scores(views.turns(spark, sf), mode, reward="score", success="traj_success",
                                    success_bonus=0.05, format_threshold=0.01)


SCORES = views.TURNS + """, per AS (
  SELECT group_idx, traj_idx, count(*) AS turns, CASE WHEN bool_or(traj_success) THEN 1.0 ELSE 0.0 END AS won,
         sum(score) AS total, min(CASE WHEN NOT last_turn THEN score END) AS inner_min,
         min(CASE WHEN last_turn THEN score END) AS final
  FROM turns GROUP BY 1, 2), scored AS (
  SELECT group_idx, traj_idx, turns, won AS outcome,
         won + greatest(-0.2, least(0.2, total - 0.05 * won)) AS bounded,
         CASE WHEN coalesce(inner_min, 1) >= 0.01 - 1e-6 AND final - 0.05 * won >= 0.01 - 1e-6 THEN won ELSE 0.0 END AS gated
  FROM per)"""


@query("TRJ1", "WITH " + views.PADDED + """
SELECT group_idx, traj_idx, turn_idx, score, output, last_turn, traj_success, CAST(copies AS BIGINT) AS copies
FROM (SELECT *, count(*) OVER (PARTITION BY group_idx, traj_idx, turn_idx) AS copies FROM padded) WHERE copy_no = 0
""")
def trj1(spark, sf):
    return trajectories.drop_copies(views.turns_padded(spark, sf), PAYLOAD).select(*trajectories.KEY, *PAYLOAD, "copies")


@query("TRJ2", "WITH " + views.PADDED + f"""
, marked AS (SELECT *, CASE WHEN row_key % 11 = 0 THEN NULL ELSE group_idx END AS g FROM padded)
, uniq AS (SELECT g, traj_idx, turn_idx, min(score) AS score FROM marked WHERE g IS NOT NULL GROUP BY 1, 2, 3
           UNION ALL SELECT NULL, traj_idx, turn_idx, score FROM marked WHERE g IS NULL)
SELECT CAST(count(*) AS BIGINT) AS unique_rows, CAST(count(*) FILTER (g IS NULL) AS BIGINT) AS ungrouped_rows,
       {r6('sum(score)')} AS score_sum FROM uniq""")
def trj2(spark, sf):
    rows = views.turns_padded(spark, sf).withColumn(
        "group_idx", F.when(F.col("row_key") % 11 != 0, F.col("group_idx")))
    rows = rows.withColumn("row_id", F.xxhash64("uid", "turn_idx", "copy_no"))
    kept = trajectories.drop_copies_ungrouped(rows, PAYLOAD, "row_id")
    lone = F.col("group_idx").startswith("ungrouped-")
    return kept.agg(F.count("*").alias("unique_rows"), F.count_if(lone).alias("ungrouped_rows"),
                    F.sum("score").alias("score_sum"))


@query("TRJ3", "WITH " + views.PADDED + """
SELECT group_idx, CAST(count(*) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS conflicts
FROM (SELECT group_idx, traj_idx, turn_idx, count(*) AS n, count(DISTINCT CASE WHEN copy_no = 1 AND row_key % 3 = 0 THEN concat(state_anchor, '!') ELSE state_anchor END) > 1 AS bad
      FROM padded GROUP BY 1, 2, 3) GROUP BY 1""")
def trj3(spark, sf):
    rows = views.turns_padded(spark, sf).withColumn("state_anchor", F.when(
        (F.col("copy_no") == 1) & (F.col("row_key") % 3 == 0), F.concat("state_anchor", F.lit("!"))).otherwise(F.col("state_anchor")))
    report = trajectories.copy_report(rows, [*PAYLOAD, "state_anchor"])
    return report.groupBy("group_idx").agg(F.count("*").alias("rows"), F.sum(F.col("copies") - 1).alias("duplicates"),
                                           F.count_if("conflict").alias("conflicts"))


@query("TRJ4", "WITH " + views.PADDED + """
SELECT group_idx, traj_idx, turn_idx, CAST(copy_no AS BIGINT) AS copy_no, copy_no = 0 AS is_first,
       CAST(CASE WHEN copy_no = 0 THEN tokens ELSE 0 END AS BIGINT) AS kept_tokens FROM padded""")
def trj4(spark, sf):
    rows = trajectories.first_copy_mask(views.turns_padded(spark, sf), "copy_no")
    return rows.select(*trajectories.KEY, F.col("copy_no").cast("long"), "is_first",
                       F.when(F.col("is_first"), F.col("tokens")).otherwise(0).cast("long").alias("kept_tokens"))


@query("TRJ5", "WITH " + views.TURNS + """
SELECT group_idx, traj_idx, CAST(count(*) AS BIGINT) AS turns, CAST(min(raw_turn) AS INTEGER) AS first_turn,
       CAST(max(raw_turn) AS INTEGER) AS final_turn, CAST(count(DISTINCT raw_turn) AS BIGINT) AS distinct_turns,
       min(raw_turn) = 1 AND max(raw_turn) = count(*) AND count(DISTINCT raw_turn) = count(*) AS whole
FROM turns GROUP BY 1, 2""")
def trj5(spark, sf):
    report = trajectories.trajectory_report(views.turns(spark, sf), "raw_turn")
    return report.select("group_idx", "traj_idx", "turns", "first_turn", "final_turn", "distinct_turns",
                         (~F.array_contains("issues", "turns are not contiguous from 1")).alias("whole"))


@query("TRJ6", "WITH " + views.TURNS + """
, t AS (SELECT DISTINCT group_idx, traj_idx FROM turns WHERE traj_idx <> 1 OR CAST(group_idx AS BIGINT) % 5 <> 0)
SELECT group_idx, CAST(count(*) AS BIGINT) AS trajectories, min(traj_idx) = 0 AND max(traj_idx) = count(*) - 1 AS whole
FROM t GROUP BY 1""")
def trj6(spark, sf):
    rows = views.turns(spark, sf).filter((F.col("traj_idx") != 1) | (F.col("group_idx").cast("long") % 5 != 0))
    report = trajectories.group_report(rows)
    return report.select("group_idx", "trajectories", (F.size("issues") == 0).alias("whole"))


@query("TRJ7", "WITH " + views.TOK + f"""
SELECT group_idx, traj_idx, {r6('sum(x * m)')} AS turn_reward FROM tok GROUP BY 1, 2""")
def trj7(spark, sf):
    return credit.turn_rewards(views.token_rows(spark, sf)).select("group_idx", "traj_idx", "turn_reward")


for _key, _mode, _column in (("TRJ8", "outcome", "outcome"), ("TRJ9", "bounded_process", "bounded"),
                             ("TRJ10", "format_gate", "gated")):
    query(_key, "WITH " + SCORES + f"""
SELECT group_idx, traj_idx, CAST(turns AS BIGINT) AS turns, {r6(_column)} AS trajectory_score FROM scored""")(
        lambda spark, sf, mode=_mode: scored(spark, sf, mode))


# Rollouts with lost turns and padded copies: a trajectory that lost a turn voids its group.
CUT = "turn_idx = 2 AND row_key % 11 = 0"
WHOLE = f""", left_ AS (SELECT * FROM turns WHERE NOT ({CUT})), tr AS (
  SELECT group_idx, traj_idx, min(turn_idx) = 1 AND max(turn_idx) = count(*) AND count(*) FILTER (last_turn) = 1
         AND max(turn_idx) FILTER (last_turn) = max(turn_idx) AS good FROM left_ GROUP BY 1, 2), ok AS (
  SELECT group_idx FROM tr GROUP BY 1 HAVING bool_and(coalesce(good, false)) AND min(traj_idx) = 0 AND max(traj_idx) = count(*) - 1)"""


def cut_rollouts(spark, sf):
    return views.turns_padded(spark, sf).filter(f"NOT ({CUT})")


@query("TRJ11", "WITH " + SCORES + WHOLE + f"""
, g AS (SELECT group_idx, avg(bounded) AS m, stddev_pop(bounded) AS s FROM scored GROUP BY 1)
SELECT group_idx, traj_idx, CAST(turns AS BIGINT) AS turns, {r6('bounded')} AS trajectory_score,
       {r6('CASE WHEN s <= 1e-6 THEN 0.0 ELSE (bounded - m) / s END')} AS advantage
FROM scored JOIN g USING (group_idx) JOIN ok USING (group_idx)""")
def trj11(spark, sf):
    """Deduplicate, check, void broken groups, score and compare within groups: the flagship plan."""
    advantages = credit.episode_advantages(cut_rollouts(spark, sf), PAYLOAD, "bounded_process", reward="score", success="traj_success",
                                           success_bonus=0.05)
    return advantages.select("group_idx", "traj_idx", "turns", "trajectory_score", "advantage")


@query("TRJ12", "WITH " + SCORES + f"""
, g AS (SELECT group_idx, avg(bounded) AS m, stddev_samp(bounded) AS s, count(*) AS n FROM scored GROUP BY 1)
SELECT group_idx, traj_idx, {r6('CASE WHEN n = 1 THEN bounded / (1 + 1e-6) ELSE (bounded - m) / (s + 1e-6) END')} AS advantage
FROM scored JOIN g USING (group_idx)""")
def trj12(spark, sf):
    return credit.group_advantages(scored(spark, sf), sample_std=True, eps=1e-6).select("group_idx", "traj_idx", "advantage")


@query("TRJ13", "WITH " + views.TOK + f"""
, per AS (SELECT group_idx, traj_idx, sum(x * m) AS r, sum(m) AS n FROM tok GROUP BY 1, 2)
, g AS (SELECT group_idx, avg(r) AS mu, stddev_pop(r) AS s FROM per GROUP BY 1)
SELECT per.group_idx, traj_idx, CAST(n AS BIGINT) AS valid_tokens,
       {r6('n * CASE WHEN s <= 1e-6 THEN 0.0 ELSE (r - mu) / s END')} AS advantage_sum
FROM per JOIN g USING (group_idx)""")
def trj13(spark, sf):
    rows = credit.turn_rewards(views.token_rows(spark, sf))
    adv = credit.group_advantages(rows.select("group_idx", "traj_idx", "turn_reward"), score="turn_reward")
    out = credit.advantage_to_tokens(rows, adv)
    return out.select("group_idx", "traj_idx", T.mask_size("response_mask").alias("valid_tokens"),
                      F.aggregate("advantages", F.lit(0.0), lambda a, x: a + x).alias("advantage_sum"))


_UNITS = {"token": "(SELECT sum(tokens) FROM turns)", "turn": "((SELECT count(*) FROM turns) * tokens)",
          "trajectory": "((SELECT count(*) FROM traj) * traj.tokens)"}
for _key, _mode in (("TRJ14", "token"), ("TRJ15", "turn"), ("TRJ16", "trajectory")):
    _w = _UNITS[_mode].replace("* tokens", "* turns.tokens")
    query(_key, "WITH " + views.TRAJ + f"""
SELECT turns.group_idx, turns.traj_idx, turns.turn_idx, {r6(f'1e6 / {_w}')} AS weight_ppm,
       {r6(f'1e6 * turns.tokens / {_w}')} AS mass_ppm
FROM turns JOIN traj USING (group_idx, traj_idx)""")(
        lambda spark, sf, mode=_mode: credit.loss_weights(views.turns(spark, sf), mode).select(
            *trajectories.KEY, (F.col("weight") * 1e6).alias("weight_ppm"),
            (F.col("weight") * F.col("tokens") * 1e6).alias("mass_ppm")))


@query("TRJ17", "WITH " + views.PADDED + """
, s AS (SELECT group_idx, traj_idx, CASE WHEN bool_or(traj_success) THEN 1.0 ELSE 0.0 END AS score FROM turns GROUP BY 1, 2)
, g AS (SELECT group_idx, count(*) AS n, stddev_pop(score) <= 1e-6 AS flat FROM s GROUP BY 1)
SELECT CAST((SELECT count(*) FROM padded) AS BIGINT) AS rows,
       CAST((SELECT count(*) FROM padded WHERE copy_no = 1) AS BIGINT) AS duplicates,
       CAST(count(*) AS BIGINT) AS groups, CAST(sum(n) AS BIGINT) AS trajectories,
       CAST(sum(CASE WHEN flat THEN 1 ELSE 0 END) AS BIGINT) AS zero_variance_groups, CAST(0 AS BIGINT) AS dropped_groups FROM g""")
def trj17(spark, sf):
    return credit.advantage_diagnostics(views.turns_padded(spark, sf), scored(spark, sf, "outcome"))


def gae(spark, sf):
    rows = views.turns(spark, sf).select(*trajectories.KEY, "score", "value", "tokens")
    return credit.generalized_advantages(rows, "score", "value", 0.99, 0.95)


GAE = "RECURSIVE " + views.TURNS + """, delta AS (
  SELECT group_idx, traj_idx, turn_idx, tokens, value,
         score + 0.99 * coalesce(lead(value) OVER w, 0) - value AS d
  FROM turns WINDOW w AS (PARTITION BY group_idx, traj_idx ORDER BY turn_idx)), gae AS (
  SELECT a.group_idx, a.traj_idx, a.turn_idx, any_value(a.tokens) AS tokens, any_value(a.value) AS value,
         sum(b.d * pow(0.99 * 0.95, b.turn_idx - a.turn_idx)) AS advantage
  FROM delta a JOIN delta b ON a.group_idx = b.group_idx AND a.traj_idx = b.traj_idx AND b.turn_idx >= a.turn_idx
  GROUP BY 1, 2, 3)"""


@query("TRJ18", "WITH " + GAE + f"""
SELECT group_idx, traj_idx, turn_idx, {r6('advantage')} AS advantage, {r6('advantage + value')} AS turn_return FROM gae""")
def trj18(spark, sf):
    return gae(spark, sf).select(*trajectories.KEY, "advantage", "turn_return")


@query("TRJ19", "WITH " + views.TOK + f"""
SELECT group_idx, traj_idx, {r6('min_by(x, i) FILTER (m = 1)')} AS first_value, {r6('max_by(x, i) FILTER (m = 1)')} AS last_value
FROM tok GROUP BY 1, 2""")
def trj19(spark, sf):
    rows = views.token_rows(spark, sf)
    return rows.select("group_idx", "traj_idx",
                       T.value_at_anchor("token_level_rewards", "response_mask").alias("first_value"),
                       T.value_at_anchor("token_level_rewards", "response_mask", last=True).alias("last_value"))


@query("TRJ20", "WITH " + views.TOK + f"""
SELECT group_idx, traj_idx, CAST(1 AS BIGINT) AS targets, CAST(min(i) FILTER (m = 1) AS BIGINT) AS anchor,
       {r6('sum(x * m)')} AS target, CAST(63 AS BIGINT) AS ignored FROM tok GROUP BY 1, 2""")
def trj20(spark, sf):
    rows = credit.turn_rewards(views.token_rows(spark, sf)).withColumn(
        "targets", T.sparse_targets(F.col("turn_reward"), "response_mask"))
    kept = F.filter(F.transform("targets", lambda t, i: F.struct((i + 1).alias("i"), t.alias("t"))), lambda z: z["t"].isNotNull())
    rows = rows.withColumn("exported", T.export_targets("targets"))
    return rows.select("group_idx", "traj_idx", F.size(kept).cast("long").alias("targets"),
                       kept[0]["i"].cast("long").alias("anchor"), kept[0]["t"].alias("target"),
                       F.size(F.filter(T.value_mask("exported"), lambda m: ~m)).cast("long").alias("ignored"))


@query("TRJ21", "WITH " + GAE + f"""
, s AS (SELECT sum(tokens) AS n, sum(tokens * advantage) / sum(tokens) AS mu,
               sum(tokens * advantage * advantage) / sum(tokens) AS q FROM gae)
SELECT group_idx, traj_idx, turn_idx,
       {r6('(advantage - mu) / sqrt((q - mu * mu) * n / (n - 1) + 1e-8)')} AS whitened FROM gae, s""")
def trj21(spark, sf):
    return credit.whiten(gae(spark, sf)).select(*trajectories.KEY, "whitened")


@query("TRJ22", "WITH " + GAE + f"""
, padded AS (SELECT *, 0 AS copy_no FROM turns UNION ALL SELECT *, 1 AS copy_no FROM turns WHERE copied)
SELECT padded.group_idx, padded.traj_idx, padded.turn_idx, CAST(copy_no AS BIGINT) AS copy_no, {r6('advantage')} AS advantage
FROM padded JOIN gae USING (group_idx, traj_idx, turn_idx)""")
def trj22(spark, sf):
    done = credit.advantages_of_copies(views.turns_padded(spark, sf), PAYLOAD, ["copy_no"], "score", "value", 0.99, 0.95)
    return done.select(*trajectories.KEY, F.col("copy_no").cast("long"), "advantage")


@query("TRJ23", "WITH " + views.TURNS + f"""
SELECT group_idx, traj_idx, turn_idx, {r6('''sum(score) OVER (PARTITION BY group_idx, traj_idx ORDER BY turn_idx
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)''')} AS return_to_go FROM turns""")
def trj23(spark, sf):
    return trajectories.return_to_go(views.turns(spark, sf).select(*trajectories.KEY, "score")).drop("score")


# All lines of a customer as one trajectory: far more turns than one block of the fold holds.
LONG = """lines AS (
  SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i,
         l_discount AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("TRJ23_long", f"""WITH {LONG} SELECT c, CAST(i AS BIGINT) AS i, {r6('sum(score) OVER (PARTITION BY c ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS return_to_go FROM lines""")
def trj23_long(spark, sf):
    order = ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("c"), *order, "l_discount")
    numbered = row_numbers(lines, ["c"], order, "i").select("c", (F.col("i") - 1).alias("i"), "l_discount")
    return affine_suffix(numbered, ["c"], "i", F.col("l_discount"), F.lit(1.0)).select("c", "i", F.col("suffix").alias("return_to_go"))


@query("TRJ24", "WITH " + views.TURNS + f"""
, parts AS (SELECT *, CASE WHEN turn_idx = 1 THEN 0 ELSE tokens % 5 + 1 END AS prompt_len, tokens % 4 + 1 AS reply_len FROM turns)
SELECT group_idx, traj_idx, CAST(count(*) AS INTEGER) AS turns, CAST(sum(prompt_len + reply_len) AS BIGINT) AS length,
       CAST(sum(reply_len) AS BIGINT) AS valid, {r6('sum(reply_len * score)')} AS score_sum,
       CAST(sum(reply_len * turn_idx) - sum(prompt_len * turn_idx) AS BIGINT) AS token_sum,
       CAST(count(*) AS BIGINT) AS images, CAST(max_by(output, turn_idx) AS VARCHAR) AS extra
FROM parts GROUP BY 1, 2""")
def trj24(spark, sf):
    turn = F.col("turn_idx")
    rows = views.turns(spark, sf).select(
        *trajectories.KEY,
        F.concat(F.array(F.lit(0), F.lit(0)), F.array_repeat(-turn, (F.col("tokens") % 5 + 1).cast("int"))).alias("p"),
        F.concat(F.array_repeat(turn, (F.col("tokens") % 4 + 1).cast("int")), F.array(F.lit(0))).alias("r"),
        "score", "output")
    trimmed = rows.select(
        *trajectories.KEY, T.trim_left("p", 0).alias("prompts"), T.trim_right("r", 0).alias("responses"), "score",
        F.array(F.col("output")).alias("image_data"), F.col("output").alias("extra"))
    ready = trimmed.withColumn("response_mask", F.transform("responses", lambda x: F.lit(1))).withColumn(
        "rm_scores", F.transform("responses", lambda x: F.col("score")))
    out = trajectories.concat_segments(ready)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        "group_idx", "traj_idx", "turns", F.size("responses").cast("long").alias("length"),
        total("response_mask").alias("valid"),
        F.aggregate("rm_scores", F.lit(0.0), lambda a, x: a + x).alias("score_sum"),
        total("responses").alias("token_sum"), F.size("image_data").cast("long").alias("images"), "extra")


@query("TRJ25", "WITH " + views.TURNS + """
SELECT group_idx, traj_idx, CAST(CASE WHEN max(uid) % 4 = 0 AND max(uid) % 9 + 1 >= count(*) THEN max(uid) % 9 + 1
       WHEN max(uid) % 4 = 1 AND count(*) = 1 THEN 6 ELSE count(*) END AS BIGINT) AS turns
FROM turns GROUP BY 1, 2""")
def trj25(spark, sf):
    uid = F.col("uid")
    rows = views.turns(spark, sf).withColumn("num_turns", F.when(uid % 4 == 0, uid % 9 + 1))
    one = rows.join(rows.groupBy(*trajectories.TRAJECTORY).agg(F.count("*").alias("n")), trajectories.TRAJECTORY)
    one = one.withColumn("extra_turns", F.when((uid % 4 == 1) & (F.col("n") == 1), F.lit(6)))
    declared = trajectories.declared_turns(F.col("num_turns"), F.col("extra_turns"))
    return trajectories.trajectory_records(one, declared).select("group_idx", "traj_idx", "turns")


@query("TRJ26", "WITH " + views.TRAJ + f"""
SELECT group_idx, traj_idx, {r6('reward')} AS reward, CAST(turns AS BIGINT) AS turns, success FROM traj""")
def trj26(spark, sf):
    return trajectories.trajectory_records(views.turns(spark, sf)).select("group_idx", "traj_idx", "reward", "turns", "success")


@query("TRJ27", "WITH " + views.TOK + f"""
SELECT group_idx, traj_idx, {r6('sum(x - 0.1 * (x * 0.5) * m)')} AS penalized, {r6('sum(x * 0.5 * m) / sum(m)')} AS mean_kl
FROM tok GROUP BY 1, 2""")
def trj27(spark, sf):
    rows = views.token_rows(spark, sf).withColumn("ref", F.transform("token_level_rewards", lambda x: x.cast("double") * 0.5))
    reward = T.kl_penalized("token_level_rewards", "token_level_rewards", "ref", "response_mask", 0.1)
    return rows.select("group_idx", "traj_idx", F.aggregate(reward, F.lit(0.0), lambda a, x: a + x).alias("penalized"),
                       T.masked_mean_kl("token_level_rewards", "ref", "response_mask").alias("mean_kl"))


@query("TRJ28", """SELECT o_custkey, o_orderkey,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS traj_idx FROM orders""")
def trj28(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return trajectories.assign_ids(rows, "o_custkey", ["o_orderkey"])


@query("TRJ29", f"""
WITH e AS (SELECT event_id, value, event_type, event_id % 4 AS n, event_id % 3 = 0 AS has_reset FROM events)
, steps AS (SELECT event_id, value, n, has_reset, unnest(generate_series(0, n)) AS turn FROM e)
SELECT event_id, CAST(turn AS INTEGER) AS turn, {r6('CASE WHEN turn > 0 THEN value * turn END')} AS reward,
       CASE WHEN has_reset THEN turn % 2 = 1 ELSE CASE WHEN turn = 0 THEN false ELSE (turn - 1) % 2 = 1 END END AS success
FROM steps WHERE turn > 0 OR has_reset OR n > 0""")
def trj29(spark, sf):
    n = (F.col("event_id") % 4).cast("int")
    infos = F.when(F.col("event_id") % 3 == 0, n + 1).otherwise(n)
    info = lambda i: F.struct((i % 2 == 1).alias("success"), F.lit(None).cast("boolean").alias("is_success"),
                              F.lit(None).cast("boolean").alias("solved"))
    none = F.array().cast("array<int>")
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(none)
    rows = table(spark, sf, "events").select(
        "event_id", F.transform(upto(n), lambda i: (i + 1) * F.col("value")).alias("rewards"),
        F.transform(upto(infos), info).alias("infos"))
    return trajectories.turn_zero_list(rows, ["event_id"])


@query("TRJ30", "WITH " + views.TURNS + """
SELECT group_idx, traj_idx, CAST(min(turn_idx) AS INTEGER) AS ends_at FROM turns
WHERE traj_success AND last_turn OR turn_idx >= 4 OR tokens >= 48 GROUP BY 1, 2""")
def trj30(spark, sf):
    rows = views.turns(spark, sf)
    ends = trajectories.is_last_turn(F.lit(False), F.col("traj_success") & F.col("last_turn"), F.col("turn_idx"), F.lit(4),
                                     F.col("tokens"), F.lit(48))
    return rows.filter(ends).groupBy("group_idx", "traj_idx").agg(F.min("turn_idx").alias("ends_at"))


def trajectory_rewards(spark, sf):
    return trajectories.trajectory_records(views.turns(spark, sf))


GROUPS = views.TRAJ + """, gv AS (
  SELECT group_idx, coalesce(var_pop(reward), 0) AS variance, count(*) AS samples, max(reward) = min(reward) AS flat,
         min(uid) AS first_seen FROM traj GROUP BY 1), ranked AS (
  SELECT *, row_number() OVER w AS rank, sum(variance) OVER (w ROWS UNBOUNDED PRECEDING) AS mass,
         sum(variance) OVER () AS total, count(*) OVER () AS n
  FROM gv WINDOW w AS (ORDER BY round(variance, 12) DESC, group_idx))"""


@query("GRP1", "WITH " + GROUPS + f"SELECT {r6('coalesce(avg(variance), 0)')} AS reward_variance FROM gv")
def grp1(spark, sf):
    return groups.mean_group_variance(trajectory_rewards(spark, sf))


# The same over rows: every turn is a sample, its score is summed without a mask.
ROWS = views.TURNS + """, rv AS (SELECT group_idx, coalesce(var_pop(score), 0) AS variance, count(*) AS samples FROM turns GROUP BY 1)
, rr AS (SELECT *, sum(variance) OVER w AS mass, row_number() OVER w AS rank, sum(variance) OVER () AS total
  FROM rv WINDOW w AS (ORDER BY round(variance, 12) DESC, group_idx ROWS UNBOUNDED PRECEDING))"""


@query("GRP1_rows", f"WITH {ROWS} SELECT {r6('avg(variance)')} AS reward_variance FROM rv")
def grp1_rows(spark, sf):
    return groups.mean_group_variance(views.turns(spark, sf), reward="score")


@query("GRP3_rows", f"""WITH {ROWS} SELECT group_idx, CAST(rank AS BIGINT) AS rank, CAST(samples AS BIGINT) AS samples, {r6('variance')} AS variance FROM rr
WHERE total <= 0 OR rank = 1 OR mass - variance < 0.5 * total - 1e-12""")
def grp3_rows(spark, sf):
    kept = groups.top_p_groups(groups.group_variance(views.turns(spark, sf), reward="score"), 0.5)
    return kept.select("group_idx", "rank", "samples", "variance")


@query("GRP2", "WITH " + GROUPS + f"""
SELECT group_idx, traj_idx, {r6('reward')} AS reward FROM traj
WHERE group_idx IN (SELECT group_idx FROM ranked WHERE rank <= greatest(1, ceil(n * 0.2)))""")
def grp2(spark, sf):
    rows = trajectory_rewards(spark, sf)
    kept = groups.top_k_groups(groups.group_variance(rows), 0.2)
    return groups.filter_rows(rows, kept).select("group_idx", "traj_idx", "reward")


@query("GRP3", "WITH " + GROUPS + f"""
, kept AS (SELECT * FROM ranked WHERE total <= 0 OR rank = 1 OR mass - variance < 0.9 * total - 1e-12)
SELECT group_idx, traj_idx, {r6('reward * sqrt((SELECT count(*) FROM kept) / (SELECT count(*) FROM gv))')} AS scaled
FROM traj WHERE group_idx IN (SELECT group_idx FROM kept)""")
def grp3(spark, sf):
    rows = trajectory_rewards(spark, sf)
    variances = stage(groups.group_variance(rows))
    kept = groups.top_p_groups(variances, 0.9)
    scale = groups.filter_report(variances, kept).select("loss_scale")
    return with_row(groups.filter_rows(rows, kept), scale).select(
        "group_idx", "traj_idx", (F.col("reward") * F.col("loss_scale")).alias("scaled"))


@query("GRP4", "WITH " + GROUPS + f"""
, kept AS (SELECT * FROM ranked WHERE total <= 0 OR rank = 1 OR mass - variance < 0.9 * total - 1e-12)
, b AS (SELECT avg(variance) AS mean_before, min(variance) AS min_before, max(variance) AS max_before,
        count(*) AS groups_before, sum(samples) AS rows_before, sum(variance) AS mb FROM gv)
, a AS (SELECT avg(variance) AS mean_after, min(variance) AS min_after, max(variance) AS max_after,
        count(*) AS groups_after, sum(samples) AS rows_after, sum(variance) AS ma FROM kept)
SELECT {r6('mean_before')} AS mean_before, {r6('min_before')} AS min_before, {r6('max_before')} AS max_before,
       CAST(groups_before AS BIGINT) AS groups_before, CAST(rows_before AS BIGINT) AS rows_before,
       {r6('mean_after')} AS mean_after, {r6('min_after')} AS min_after, {r6('max_after')} AS max_after,
       CAST(groups_after AS BIGINT) AS groups_after, CAST(rows_after AS BIGINT) AS rows_after,
       {r6('ma / mb')} AS mass_ratio, {r6('sqrt(groups_after / groups_before)')} AS loss_scale FROM a, b""")
def grp4(spark, sf):
    variances = stage(groups.group_variance(trajectory_rewards(spark, sf)))
    return groups.filter_report(variances, groups.top_p_groups(variances, 0.9))


@query("GRP5", "WITH " + GROUPS + f"""
SELECT {r6('avg(variance)')} AS mean_group_reward_variance,
       {r6('avg(CASE WHEN flat THEN 1 ELSE 0 END)')} AS zero_variance_group_fraction FROM gv WHERE samples >= 2""")
def grp5(spark, sf):
    # Rewards are sums of hundredths; rounding keeps equal ones equal in every addition order.
    rows = trajectory_rewards(spark, sf).withColumn("reward", F.round("reward", 6))
    return groups.comparable_variance(rows)


ORACLE_PREFLIGHT = "WITH " + views.TURNS + f"""
, r AS (SELECT *, sum(score) OVER (PARTITION BY group_idx, traj_idx ORDER BY turn_idx
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rtg,
        CASE WHEN row_key % 50 = 0 THEN '' ELSE state_anchor END AS anchor FROM turns)
, s AS (SELECT group_idx, anchor, count(*) AS n, count(DISTINCT output) AS a, var_pop(rtg) AS v FROM r WHERE anchor <> '' GROUP BY 1, 2)
, t AS (SELECT count(*) AS rows, count(*) FILTER (anchor = '') AS missing FROM r)
, m AS (SELECT count(*) AS state_groups, count(*) FILTER (n = 1) AS singles, count(*) FILTER (n >= 2) AS comparable,
        coalesce(sum(n) FILTER (n >= 2), 0) AS comparable_rows, count(*) FILTER (n >= 2 AND a >= 2) AS diverse,
        coalesce(avg(v) FILTER (n >= 2), 0) AS rv, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.95) AS p95, max(n) AS mx FROM s)
, f AS (SELECT *, missing / rows AS f1, singles / state_groups AS f2, comparable_rows / (rows - missing) AS f3,
        CASE WHEN comparable > 0 THEN diverse / comparable ELSE 0 END AS f4 FROM t, m)
"""


@query("GRP7", ORACLE_PREFLIGHT + f"""
SELECT CAST(rows AS BIGINT) AS rows, CAST(state_groups AS BIGINT) AS state_groups, CAST(comparable AS BIGINT) AS comparable_groups,
       {r6('f1')} AS missing_anchor_fraction, {r6('f2')} AS singleton_fraction, {r6('f3')} AS comparable_row_fraction,
       {r6('f4')} AS action_diversity_fraction, {r6('rv')} AS mean_return_to_go_variance,
       {r6('p50')} AS group_rows_p50, {r6('p95')} AS group_rows_p95, CAST(mx AS BIGINT) AS max_group_rows FROM f""")
def grp7(spark, sf):
    return run_preflight(spark, sf).select(
        "rows", "state_groups", "comparable_groups", "missing_anchor_fraction", "singleton_fraction",
        "comparable_row_fraction", "action_diversity_fraction", "mean_return_to_go_variance",
        "group_rows_p50", "group_rows_p95", "max_group_rows")


@query("GRP8", ORACLE_PREFLIGHT + """
, c AS (SELECT concat_ws(',', CASE WHEN rows < 64 THEN 'enough_rows' END, CASE WHEN f1 > 0.01 THEN 'anchors_present' END,
  CASE WHEN f3 < 0.2 THEN 'enough_comparable_rows' END, CASE WHEN f4 < 0.1 THEN 'actions_vary' END,
  CASE WHEN rv < 1e-4 THEN 'returns_vary' END) AS failed FROM f)
SELECT failed, CASE WHEN failed = '' THEN 'proceed' ELSE 'stop' END AS decision FROM c""")
def grp8(spark, sf):
    return run_preflight(spark, sf).select(F.concat_ws(",", "failed_checks").alias("failed"), "decision")


def run_preflight(spark, sf):
    rows = views.turns(spark, sf).withColumn(
        "state_anchor", F.when(F.col("row_key") % 50 == 0, F.lit("")).otherwise(F.col("state_anchor")))
    return groups.preflight(rows, action="output")


RATIOS = views.TOK + """, ratio AS (
  SELECT group_idx, x - x * 0.25 AS d, exp(x - x * 0.25) AS r FROM tok WHERE m = 1)"""
STATS = RATIOS + """, st AS (
  SELECT group_idx, avg(r) AS ratio_mean, quantile_cont(r, 0.5) AS ratio_median, quantile_cont(r, 0.95) AS ratio_p95,
         quantile_cont(r, 0.99) AS ratio_p99, avg(abs(d)) AS delta,
         avg(CASE WHEN r < 0.8 OR r > 1.2 THEN 1.0 ELSE 0.0 END) AS clipped, count(*) AS n FROM ratio GROUP BY 1)"""


def parity_stats(spark, sf):
    rows = views.token_rows(spark, sf).withColumn(
        "rollout", F.transform("token_level_rewards", lambda x: x.cast("double") * 0.25))
    ratios = parity.token_ratios(rows, "token_level_rewards", "rollout", "response_mask", ["group_idx"])
    return parity.ratio_statistics(ratios, ["group_idx"])


@query("PAR1", "WITH " + STATS + f"""
SELECT group_idx, {r6('ratio_mean')} AS ratio_mean, {r6('ratio_median')} AS ratio_median, {r6('ratio_p95')} AS ratio_p95,
       {r6('ratio_p99')} AS ratio_p99, {r6('delta')} AS mean_abs_logprob_delta, {r6('clipped')} AS pre_update_clip_fraction,
       CAST(n AS BIGINT) AS num_tokens FROM st""")
def par1(spark, sf):
    return parity_stats(spark, sf)


@query("PAR2", "WITH " + STATS + """
SELECT group_idx, abs(ratio_p99 - 1) <= 0.2 AND abs(ratio_p95 - 1) <= 0.15 AND delta <= 0.07 AND clipped <= 0.05 AS gate_passed,
       concat_ws('; ', CASE WHEN abs(ratio_p95 - 1) > 0.15 THEN 'ratio p95 deviation too large' END,
         CASE WHEN abs(ratio_p99 - 1) > 0.2 THEN 'ratio p99 deviation too large' END,
         CASE WHEN delta > 0.07 THEN 'mean absolute logprob delta too large' END,
         CASE WHEN clipped > 0.05 THEN 'pre-update clip fraction too large' END) AS failures FROM st""")
def par2(spark, sf):
    gate = parity.parity_gate(parity_stats(spark, sf), 0.15, 0.2, 0.07, 0.05)
    return gate.select("group_idx", "gate_passed", F.concat_ws("; ", "failures").alias("failures"))


@query("PAR3", """
SELECT CAST(user_id AS VARCHAR) AS run, CAST(count(*) AS BIGINT) AS attempts, max(event_id) AS latest_attempt,
       max_by(event_type <> 'error', event_id) AS latest_passed, bool_or(event_type = 'error') AS ever_failed
FROM events GROUP BY 1""")
def par3(spark, sf):
    attempts = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("attempt_no"),
        (F.col("event_type") != "error").alias("gate_passed"))
    return parity.attempt_history(attempts)
