"""Projection queries: token arrays, response text, rewards, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.functions import geometry as G
from rollframe.functions import rewards as W
from rollframe.functions import text as X
from rollframe.functions import tokens as T
from rollframe.functions.nested import nested_values
from rollframe.operators import episodes as E
from rollframe.operators.trajectories import KEY, drop_padding
from rollframe.plans import views
from rollframe.plans.catalog import query, r6, table

# One expression for both engines: conversations dressed up as tagged responses.
RESPONSE = """CASE (conv_id + turn) % 5
  WHEN 0 THEN concat('<think>', text, '</think> <answer>Move ', turn, ', left ,, RIGHT , up 4.5,down</answer>')
  WHEN 1 THEN concat('<observation> o ', turn, ' </observation><think>', text, '</think>', chr(10),
                     '<action>go|Left| |up|x|y|z</action> <prediction> p</prediction>')
  WHEN 2 THEN concat('<ACTION type="a"> Forward  ', turn, chr(10), ' </ACTION> ', text)
  WHEN 3 THEN concat('THINK: ', text, chr(10), 'FINAL ANSWER:  turn ', turn, ' ')
  ELSE text END"""


def transcripts(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.expr(RESPONSE).alias("response"))


TALK = f"talk AS (SELECT conv_id, turn, role, text, {RESPONSE} AS response FROM conversations)"


def _strip(e):
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def _squeeze(e):
    return rf"regexp_replace({_strip(e)}, '\s+', ' ', 'g')"


def _template(e):
    return rf"regexp_replace(lower({_squeeze(e)}), '\b\d+(?:\.\d+)?\b', '<number>', 'g')"


_TAG = r"(?is)<(?:answer|action)\b[^>]*>(.*?)</(?:answer|action)>"
BODY = f"CASE WHEN regexp_matches(response, '{_TAG}') THEN regexp_extract(response, '{_TAG}', 1) ELSE response END"


@query("PRJ1", "WITH " + views.TOK + f"""
SELECT traj_idx, CAST(count(*) AS BIGINT) AS response_length, CAST(sum(m) AS BIGINT) AS valid FROM tok WHERE i > 64 - (traj_idx % 60 + 1) GROUP BY 1""")
def prj1(spark, sf):
    rows = views.token_rows(spark, sf).withColumn("responses", F.slice("responses", F.lit(1), (F.col("traj_idx") % 60 + 1).cast("int")))
    return rows.withColumn("m", T.response_mask("response_mask", "responses")).select(
        "traj_idx", F.size("m").cast("long").alias("response_length"), T.mask_size("m").alias("valid"))


@query("PRJ2", "WITH " + views.TOK + """
SELECT traj_idx, CAST(sum(CASE WHEN abs((CASE WHEN m = 1 THEN x ELSE -100 END) + 100) >= 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS kept
FROM tok GROUP BY 1""")
def prj2(spark, sf):
    rows = views.token_rows(spark, sf).withColumn("returns", F.zip_with(
        "token_level_rewards", "response_mask", lambda x, m: F.when(m == 1, x.cast("double")).otherwise(-100.0)))
    return rows.select("traj_idx", F.size(F.filter(T.value_mask("returns"), lambda k: k)).cast("long").alias("kept"))


PADS = views.TOK + ", t AS (SELECT traj_idx, i, CASE WHEN i >= 5 AND i <= 60 THEN CAST(trunc(CAST(x AS FLOAT) * 100) AS INTEGER) ELSE 0 END AS tk FROM tok)"


@query("PRJ3", "WITH " + PADS + """
SELECT traj_idx, CAST(coalesce(max(i) FILTER (tk <> 0), 0) AS BIGINT) AS kept, CAST(sum(tk) AS BIGINT) AS total FROM t GROUP BY 1""")
def prj3(spark, sf):
    return _trimmed(spark, sf, T.trim_right("responses", 0))


@query("PRJ4", "WITH " + PADS + """
SELECT traj_idx, CAST(coalesce(65 - min(i) FILTER (tk <> 0), 0) AS BIGINT) AS kept, CAST(sum(tk) AS BIGINT) AS total FROM t GROUP BY 1""")
def prj4(spark, sf):
    return _trimmed(spark, sf, T.trim_left("responses", 0))


def _trimmed(spark, sf, expr):
    return views.token_rows(spark, sf).withColumn("k", expr).select(
        "traj_idx", F.size("k").cast("long").alias("kept"),
        F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("PRJ5", "WITH " + views.PADDED + """
SELECT group_idx, CAST(count(*) AS BIGINT) AS rows FROM padded WHERE copy_no = 0 GROUP BY 1""")
def prj5(spark, sf):
    rows = views.turns_padded(spark, sf).withColumn("_is_padding", F.col("copy_no") == 1)
    return drop_padding(rows).groupBy("group_idx").agg(F.count("*").alias("rows"))


@query("PRJ6", f"WITH {TALK} SELECT conv_id, turn, {_template('response')} AS template FROM talk")
def prj6(spark, sf):
    return transcripts(spark, sf).select("conv_id", "turn", X.normalize_template(F.col("response")).alias("template"))


@query("PRJ7", f"WITH {TALK}, b AS (SELECT *, {BODY} AS body FROM talk) SELECT conv_id, turn, {_template('body')} AS template FROM b")
def prj7(spark, sf):
    return transcripts(spark, sf).select("conv_id", "turn", X.answer_template(F.col("response")).alias("template"))


@query("PRJ8", f"WITH {TALK}, b AS (SELECT *, {BODY} AS body FROM talk) SELECT conv_id, turn, lower({_squeeze('body')}) AS action FROM b")
def prj8(spark, sf):
    return transcripts(spark, sf).select("conv_id", "turn", X.normalized_action(F.col("response")).alias("action"))


@query("PRJ9", """
SELECT event_id, CAST(2 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS found,
       CAST(CAST(json_extract(props, '$.k') AS BIGINT) * 2 + CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END AS BIGINT) AS total
FROM events""")
def prj9(spark, sf):
    doc = F.concat(F.lit('{"a":'), F.col("props"), F.lit(',"b":[1,{"c":'), F.col("props"), F.lit('}]'),
                   F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"d":{"e":[[{"k":'), F.col("event_id").cast("string"), F.lit("}]]}")))
                   .otherwise(F.lit("")), F.lit("}"))
    rows = table(spark, sf, "events").select("event_id", doc.alias("doc"))
    return nested_values(rows, ["event_id"], "doc", "k").groupBy("event_id").agg(
        F.count("*").alias("found"), F.sum(F.col("value").cast("long")).alias("total"))


@query("PRJ10", """
SELECT event_id, concat(trim(event_type), chr(10), '[remaining_turns=',
       CASE WHEN event_id % 10 = 0 THEN 'unbounded' ELSE CAST(greatest(event_id % 7 - 2, 0) AS VARCHAR) END, ']') AS anchor FROM events""")
def prj10(spark, sf):
    left = F.when(F.col("event_id") % 10 != 0, F.col("event_id") % 7 - 2)
    return table(spark, sf, "events").select(
        "event_id", X.state_anchor(F.concat(F.lit("  "), "event_type", F.lit("\n")), left).alias("anchor"))


@query("PRJ11", """
SELECT event_id, concat('{"camera_horizon":', user_id % 60, '.0,"position":{"x":', event_id % 100, '.5,"y":0.9,"z":', user_id % 50,
       '.25},"rotation":{"x":0.0,"y":', event_id % 4 * 90, '.0,"z":0.0},"standing":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, '}') AS anchor
FROM events""")
def prj11(spark, sf):
    d = lambda e: F.expr(f"CAST({e} AS DOUBLE)")
    return table(spark, sf, "events").select("event_id", X.pose_anchor(
        d("user_id % 60 + 0.00004"), [d("event_id % 100 + 0.50002"), d("0.9"), d("user_id % 50 + 0.25")],
        [d("0.0"), d("event_id % 4 * 90"), d("0.00001")], F.col("event_id") % 2 == 0).alias("anchor"))


def _format_sql(key, pattern, action_group, sep, most, lower):
    item = "lower(a)" if lower else "a"
    return f"""SELECT conv_id, turn, '{key}' AS format, regexp_matches(response, '{pattern}') AS ok,
      coalesce(array_to_string(list_slice(list_filter(list_transform(string_split(regexp_extract(response, '{pattern}', {action_group}), '{sep}'),
        lambda a: {_strip(item)}), lambda a: a <> ''), 1, {most}), '~'), '') AS actions FROM talk"""


_THINK_ANSWER = r"(?s)<think>(.*?)</think>\s*<answer>(.*?)</answer>"
_WM = (r"(?s)<observation>(.*?)</observation>\s*<think>(.*?)</think>\s*<action>(.*?)</action>\s*<prediction>(.*?)</prediction>")
_FREE_WM = r"(?s)<observation>(.*?)</observation>(.*?)<answer>(.*?)</answer>(.*?)<prediction>(.*?)</prediction>"
FORMAT_SQL = " UNION ALL ".join([
    _format_sql("grid/free_think", _THINK_ANSWER, 2, ",", 3, True), _format_sql("navigation/wm", _WM, 3, "|", 5, True),
    _format_sql("navigation/eval_mode", "(?s)<action>(.*?)</action>", 1, "|", 5, True),
    _format_sql("navigation/no_think", r"(?s)^\s*<action>(.*?)</action>\s*$", 1, "|", 5, True),
    _format_sql("skill/free_think", _THINK_ANSWER, 2, "|", 2, False), _format_sql("grid/free_wm", _FREE_WM, 3, ",", 3, True)])
FORMATS = [("grid", "free_think"), ("navigation", "wm"), ("navigation", "eval_mode"), ("navigation", "no_think"),
           ("skill", "free_think"), ("grid", "free_wm")]


@query("PRJ12", f"WITH {TALK} {FORMAT_SQL}")
def prj12(spark, sf):
    parsed = {f"{fam}/{fmt}": X.parse_response(F.col("response"), fam, fmt) for fam, fmt in FORMATS}
    # Only the two fields in use enter the array, which keeps the generated code small.
    parts = F.array(*[F.struct(F.lit(n).alias("format"), p["format_correct"].alias("ok"), p["actions"].alias("a"))
                      for n, p in parsed.items()])
    return transcripts(spark, sf).select("conv_id", "turn", F.explode(parts).alias("z")).select(
        "conv_id", "turn", "z.format", "z.ok", F.concat_ws("~", "z.a").alias("actions"))


@query("PRJ12_audit", f"""WITH {TALK}, f AS ({FORMAT_SQL})
SELECT format, {r6('avg(CASE WHEN ok THEN 1 ELSE 0 END)')} AS share_correct FROM f GROUP BY 1""")
def prj12_audit(spark, sf):
    return prj12(spark, sf).groupBy("format").agg(F.avg(F.col("ok").cast("int")).alias("share_correct"))


@query("PRJ13", rf"""WITH {TALK}
SELECT conv_id, turn, coalesce(nullif({_strip("regexp_extract(response, '(?is)FINAL ANSWER:\\s*(.*)$', 1)")}, ''),
         nullif({_strip("regexp_extract(response, '(?is)<answer>(.*?)</answer>', 1)")}, ''), {_strip('response')}) AS answer,
       coalesce(nullif({_strip("CASE WHEN response LIKE 'THINK:%FINAL ANSWER:%' THEN regexp_extract(response, '(?is)THINK:\\s*(.*?)FINAL ANSWER:', 1) ELSE '' END")}, ''),
         nullif({_strip("regexp_extract(response, '(?is)<think>(.*?)</think>', 1)")}, ''), '') AS think FROM talk""".replace("\\\\", "\\"))
def prj13(spark, sf):
    return transcripts(spark, sf).select("conv_id", "turn", X.parse_headers(F.col("response")).alias("p")).select(
        "conv_id", "turn", "p.answer", "p.think")


@query("PRJ14", "SELECT conv_id, turn, concat(role, ' <image> mid <image> <image> ', role) AS text FROM conversations")
def prj14(spark, sf):
    pad = F.repeat(F.lit("<|image_pad|>"), (F.col("turn") % 4 + 1).cast("int"))
    raw = F.concat("role", F.lit(" <|vision_start|>"), pad, F.lit("<|vision_end|> mid "), pad, F.lit(" <|imgpad|><|imgpad|> "), "role")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.collapse_images(raw).alias("text"))


@query("PRJ15", f"SELECT event_id, {r6('CASE WHEN event_id % 4 IN (0, 1) THEN NULL ELSE value END')} AS clean FROM events")
def prj15(spark, sf):
    odd = F.expr("CASE event_id % 4 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('-Infinity' AS DOUBLE) ELSE value END")
    return table(spark, sf, "events").select("event_id", X.finite(odd).alias("clean"))


@query("PRJ16", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 ELSE false END OR (event_type = 'purchase' AND value > 20) AS success FROM events""")
def prj16(spark, sf):
    null = F.lit(None).cast("boolean")
    info = F.struct(null.alias("success"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 2 == 0).alias("is_success"), null.alias("solved"))
    return table(spark, sf, "events").select("event_id", E.episode_success(
        F.array(info), F.array("value"), F.col("event_type") == "purchase", 20.0).alias("success"))


REWARD_TURNS = views.TURNS + """, f AS (
  SELECT *, row_key % 5 <> 0 AS ok, row_key % 3 AS valid, traj_success AND last_turn AS won,
         bool_and(row_key % 5 <> 0) OVER (PARTITION BY group_idx, traj_idx ORDER BY turn_idx) AS so_far FROM turns)"""


def reward_turns(spark, sf):
    return views.turns(spark, sf).select(
        *KEY, "row_key", (F.col("row_key") % 5 != 0).alias("format_correct"), (F.col("row_key") % 3).alias("valid_actions"),
        (F.col("traj_success") & F.col("last_turn")).alias("success"))


@query("PRJ17", f"""WITH {REWARD_TURNS} SELECT group_idx, traj_idx, turn_idx,
  {r6('CASE WHEN ok AND valid > 0 THEN 0.1 ELSE 0 END + CASE WHEN won THEN 10 + CASE WHEN so_far THEN 0.5 ELSE 0 END ELSE 0 END')} AS reward FROM f""")
def prj17(spark, sf):
    return W.navigation_reward(reward_turns(spark, sf), per_turn_format_reward=0.1).select(*KEY, "reward")


@query("PRJ18", f"""WITH {REWARD_TURNS} SELECT group_idx, traj_idx, turn_idx,
  {r6('CASE WHEN ok AND valid > 0 AND valid = 2 THEN 0.1 ELSE 0 END + (row_key % 3) * 2 + CASE WHEN won THEN 10 ELSE 0 END')} AS reward FROM f""")
def prj18(spark, sf):
    return reward_turns(spark, sf).select(*KEY, W.staged_reward(
        F.col("format_correct"), F.col("valid_actions"), F.lit(2), (F.col("row_key") % 3) * 2.0, F.col("success")).alias("reward"))


@query("PRJ19", f"""WITH {REWARD_TURNS} SELECT group_idx, traj_idx, turn_idx,
  {r6('CASE WHEN won THEN 1 ELSE 0 END + CASE WHEN valid > 0 THEN 0.1 ELSE 0 END')} AS plain,
  {r6('CASE WHEN won THEN 1 ELSE 0 END + CASE WHEN valid > 0 AND ok THEN 0.1 ELSE 0 END')} AS strict FROM f""")
def prj19(spark, sf):
    args = (F.col("valid_actions"), F.col("success"), 0.1, 1.0)
    return reward_turns(spark, sf).select(*KEY, W.grid_reward(*args).alias("plain"),
                                          W.grid_reward(*args, F.col("format_correct")).alias("strict"))


@query("PRJ20", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'turn' WHEN o_orderkey % 4 = 1 THEN 'sequence'
  ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'token' WHEN o_orderkey % 7 = 1 THEN 'turn' WHEN o_orderkey % 7 < 4 THEN 'trajectory' ELSE 'unknown' END END AS mode
FROM orders""")
def prj20(spark, sf):
    from rollframe.operators.comparison import objective_mode
    k = F.col("o_orderkey")
    method = F.when(k % 7 == 0, "Token_turn_x").when(k % 7 == 1, "per-TURN").when(k % 7 == 2, "episode_grpo").when(
        k % 7 == 3, "trajectory").otherwise("gae")
    return table(spark, sf, "orders").select("o_orderkey", objective_mode(
        F.when(k % 4 == 0, "Turn").when(k % 4 == 2, "other"), F.when(k % 4 == 1, "Sequence"), method).alias("mode"))


@query("PRJ21", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'max_turns' WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'done' END AS finish_reason FROM orders""")
def prj21(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", E.repaired_finish(
        F.when(k % 3 == 0, "max_turns").when(k % 3 == 1, ""), F.col("o_orderstatus") == "F", k % 2 == 0).alias("finish_reason"))


@query("PRJ22", f"WITH {views.EPISODES} SELECT rollout_id FROM episodes WHERE episode % 5 = 0 OR finish_reason NOT IN ('done', 'max_turns')")
def prj22(spark, sf):
    rows = views.episodes(spark, sf).withColumn("finish_reason", F.when(F.col("episode") % 5 != 0, F.col("finish_reason")))
    return rows.filter(E.must_rerun(F.col("finish_reason"))).select("rollout_id")


@query("PRJ23", f"WITH {views.EPISODES} SELECT rollout_id FROM episodes WHERE episode % 9 = 0 OR finish_reason NOT IN ('done', 'max_turns')")
def prj23(spark, sf):
    rows = views.episodes(spark, sf).withColumn("error", F.when(F.col("episode") % 9 == 0, "boom").when(F.col("episode") % 9 == 1, ""))
    return rows.filter(E.infrastructure_failure(F.col("error"), F.col("finish_reason"))).select("rollout_id")


# Pairs of positions on a grid, from suppliers and parts of the line items.
PAIRS = """pairs AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 23 - 11 AS dx, l_suppkey % 19 - 9 AS dy,
         CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END AS ox,
         CASE l_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 0 END AS oy
  FROM lineitem), rel AS (
  SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0.0 ELSE -degrees(atan2(ox * dy - oy * dx, ox * dx + oy * dy)) END AS deg,
         sqrt(dx * dx + dy * dy) AS dist FROM pairs)"""
PAIR_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_OCT = "['north', 'north east', 'east', 'south east', 'south', 'south west', 'west', 'north west'][CAST(floor((((deg + 360) % 360) + 22.5) / 45) % 8 AS INTEGER) + 1]"
_DIST = ("CASE WHEN dist < 1e-6 THEN 'same distance' WHEN dist < 2.000001 THEN 'near' WHEN dist < 4.000001 THEN 'mid distance' "
         "WHEN dist < 8.000001 THEN 'slightly far' WHEN dist < 16.000001 THEN 'far' WHEN dist < 32.000001 THEN 'very far' ELSE 'extremely far' END")


def pairs(spark, sf):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    m = part % 4
    return table(spark, sf, "lineitem").select(
        *PAIR_KEY, (part % 23 - 11).alias("dx"), (supp % 19 - 9).alias("dy"),
        F.when(m == 1, 1).when(m == 3, -1).otherwise(0).alias("ox"), F.when(m == 0, 1).when(m == 2, -1).otherwise(0).alias("oy"))


def vec():
    return F.col("dx"), F.col("dy"), F.col("ox"), F.col("oy")


@query("PRJ24", f"""WITH {PAIRS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r6('deg')} AS degree, {_OCT} AS compass,
  CASE WHEN deg <= -180 THEN 'beyond-fov' WHEN deg < -45.001 THEN 'beyond-fov' WHEN deg < -22.501 THEN 'front-left' WHEN deg < -0.001 THEN 'front-slight-left'
  WHEN deg < 0.001 THEN 'front' WHEN deg < 22.501 THEN 'front-slight-right' WHEN deg < 45.001 THEN 'front-right' ELSE 'beyond-fov' END AS front FROM rel""")
def prj24(spark, sf):
    deg = G.bearing(*vec())
    return pairs(spark, sf).select(*PAIR_KEY, deg.alias("degree"), G.octant_name(deg).alias("compass"), G.front_bin(deg).alias("front"))


@query("PRJ25", f"WITH {PAIRS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r6('dist')} AS distance, {_DIST} AS bin FROM rel")
def prj25(spark, sf):
    d = G.distance(F.col("dx"), F.col("dy"))
    return pairs(spark, sf).select(*PAIR_KEY, d.alias("distance"), G.distance_bin(d).alias("bin"))


_FX = "CASE WHEN ox = 1 THEN -dy WHEN oy = -1 THEN -dx WHEN ox = -1 THEN dy ELSE dx END"
_FY = "CASE WHEN ox = 1 THEN dx WHEN oy = -1 THEN -dy WHEN ox = -1 THEN -dx ELSE dy END"


@query("PRJ27", f"""WITH {PAIRS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r6(_FX)} AS fx, {r6(_FY)} AS fy,
  {r6('dx + 3')} AS bx, {r6('dy - 2')} AS by_ FROM rel""")
def prj27(spark, sf):
    dx, dy, ox, oy = vec()
    ax, ay = F.lit(3), F.lit(-2)
    fx, fy = G.to_frame(dx + 3, dy - 2, ax, ay, ox, oy)
    rows = pairs(spark, sf).withColumn("fx", fx).withColumn("fy", fy)
    bx, by = G.from_frame(F.col("fx"), F.col("fy"), ax, ay, ox, oy)
    return rows.select(*PAIR_KEY, "fx", "fy", bx.alias("bx"), by.alias("by_"))


_SIM = """CASE WHEN dx = 0 AND dy = 0 THEN CASE WHEN sqrt((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy)) = 0 THEN 1.0 ELSE 0.0 END
  ELSE exp(-sqrt((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy)) / sqrt(dx * dx + dy * dy)) END"""


@query("PRJ28", f"WITH {PAIRS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r6(_SIM)} AS similarity FROM rel")
def prj28(spark, sf):
    dx, dy, ox, oy = vec()
    return pairs(spark, sf).select(*PAIR_KEY, G.coordinate_similarity(ox, oy, dx, dy).alias("similarity"))


@query("PRJ29", f"""SELECT event_id, {r6("len(list_filter([0.50,0.55,0.60,0.65,0.70,0.75,0.80,0.85,0.90,0.95], lambda t: least(value / 40, 1) >= t)) / 10")} AS accuracy FROM events""")
def prj29(spark, sf):
    return table(spark, sf, "events").select("event_id", G.relative_accuracy(F.least(F.col("value") / 40, F.lit(1.0))).alias("accuracy"))


@query("PRJ34", f"""WITH {PAIRS}, h AS (SELECT *, ((degrees(atan2(ox, oy)) + 360) % 360 - (degrees(atan2(bx, by_)) + 360) % 360 + 360) % 360 AS d
  FROM (SELECT *, CASE l_suppkey % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS bx, CASE l_suppkey % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS by_ FROM pairs))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  ['forward', 'right', 'backward', 'left'][CAST(round(d / 90) AS INTEGER) % 4 + 1] AS facing FROM h""")
def prj34(spark, sf):
    m = F.col("l_suppkey") % 4
    ax, ay = F.when(m == 1, 1).when(m == 3, -1).otherwise(0), F.when(m == 0, 1).when(m == 2, -1).otherwise(0)
    return pairs(spark, sf).select(*PAIR_KEY, G.relative_orientation(F.col("ox"), F.col("oy"), ax, ay).alias("facing"))


@query("PRJ35", f"""WITH {PAIRS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_OCT} = 'east' AND {_DIST} = 'far' AS binned,
  abs(deg - 90) <= 1e-6 AND abs(dist - 5) <= 1e-6 AS exact, dist * dist <= 4.000001 AND {_OCT} = 'north' AS nearby FROM rel""")
def prj35(spark, sf):
    return pairs(spark, sf).select(
        *PAIR_KEY, G.relation_holds(*vec(), direction=F.lit("east"), distance_name=F.lit("far")).alias("binned"),
        G.relation_holds(*vec(), degree=F.lit(90.0), exact_distance=F.lit(5.0)).alias("exact"),
        G.relation_holds(*vec(), direction=F.lit("north"), nearby=True).alias("nearby"))


@query("PRJ36", f"""WITH {views.TURNS}, s AS (SELECT *, CASE WHEN traj_success AND last_turn THEN 10.0
  WHEN row_key % 3 = 0 THEN 4.0 WHEN row_key % 2 = 0 THEN 2.0 ELSE 0.0 END AS level FROM turns)
SELECT uid, turn_idx, {r6('level')} AS level, {r6('level - coalesce(lag(level) OVER (PARTITION BY uid ORDER BY turn_idx), 0)')} AS stage_reward FROM s""")
def prj36(spark, sf):
    rows = views.turns(spark, sf)
    flags = F.array(F.col("row_key") % 2 == 0, F.col("row_key") % 3 == 0)
    steps = rows.select("uid", "turn_idx", W.stage_level(F.col("traj_success") & F.col("last_turn"), flags).alias("level"))
    return W.stage_progress(steps, "uid", "turn_idx", "level")


@query("PRJ37", f"""WITH {PAIRS}, a AS (SELECT *, (degrees(atan2(dx, dy)) + 540) % 360 AS away FROM pairs)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r6('''list_min(list_transform([0, 90, 180, 270],
  lambda c: round(least(abs(away - c), 360 - abs(away - c)), 9) * 1000 + c / 1000.0))''')} AS best,
  CAST(0 AS BIGINT) AS unused FROM a""")
def prj37(spark, sf):
    head = G.away_heading(F.col("dx"), F.col("dy"))
    away = F.pmod(F.degrees(F.atan2(F.col("dx").cast("double"), F.col("dy").cast("double"))) + 180.0, F.lit(360.0))
    gap = F.least(F.abs(away - head), 360.0 - F.abs(away - head))
    return pairs(spark, sf).select(*PAIR_KEY, (F.round(gap, 9) * 1000 + head / 1000.0).alias("best"), F.lit(0).cast("long").alias("unused"))


@query("PRJ30", """WITH a(spelling, label) AS (VALUES ('ne', 'northeast'), ('northeast', 'northeast'), ('mid', 'middistance'), ('medium', 'middistance'), ('fl', 'frontleft'))
, e AS (SELECT event_id, ['  North - East', 'NE', 'medium', 'Mid', 'F L', 'elsewhere x'][CAST(event_id % 6 + 1 AS INTEGER)] AS said,
        ['north-east', 'mid distance', 'front-left'][CAST(event_id % 3 + 1 AS INTEGER)] AS target FROM events)
, k AS (SELECT *, regexp_replace(lower(said), '[\\s-]+', '', 'g') AS key, regexp_replace(target, '[\\s-]+', '', 'g') AS want FROM e)
SELECT event_id, coalesce(label, key) AS label, coalesce(label, key) = want AS matches FROM k LEFT JOIN a ON key = spelling""".replace("\\\\", "\\"))
def prj30(spark, sf):
    said = F.element_at(F.array(*[F.lit(s) for s in ("  North - East", "NE", "medium", "Mid", "F L", "elsewhere x")]), (F.col("event_id") % 6 + 1).cast("int"))
    want = F.element_at(F.array(*[F.lit(s) for s in ("north-east", "mid distance", "front-left")]), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", X.canonical_label(said).alias("label"), X.labels_match(said, want).alias("matches"))


@query("PRJ31", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat(user_id, '~7') WHEN 1 THEN concat(user_id, '~8') WHEN 2 THEN concat(user_id, '~9') END AS items,
       CASE event_id % 5 WHEN 0 THEN user_id + 7 WHEN 1 THEN user_id + 8 WHEN 2 THEN user_id + 9 END AS total FROM events""")
def prj31(spark, sf):
    raw = F.expr("""CASE event_id % 5 WHEN 0 THEN concat('answer ( ', user_id, ' , 7,) end') WHEN 1 THEN concat('["', user_id, '", 8]')
                    WHEN 2 THEN concat(user_id, ' ,, 9') WHEN 3 THEN concat(user_id, ', nine') ELSE ' , ' END""")
    seq = X.extract_sequence(raw, "bigint")
    return table(spark, sf, "events").select("event_id", seq.alias("s")).select(
        "event_id", F.when(F.col("s").isNotNull(), F.concat_ws("~", F.col("s").cast("array<string>"))).alias("items"),
        F.when(F.col("s").isNotNull(), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


@query("PRJ32", f"WITH {views.EPISODES} SELECT observation_ablation, CAST(count(*) AS BIGINT) AS n FROM episodes GROUP BY 1")
def prj32(spark, sf):
    rows = views.episodes(spark, sf).withColumn("observation_ablation", F.nullif("observation_ablation", F.lit("none")))
    return rows.groupBy(E.checked_ablation(F.col("observation_ablation")).alias("observation_ablation")).agg(F.count("*").alias("n"))
