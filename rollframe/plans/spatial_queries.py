"""Exploration, map and answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollframe.distributed import row_numbers
from rollframe.functions import geometry as G
from rollframe.functions import scoring, text
from rollframe.operators import exploration as X
from rollframe.operators import maps as M
from rollframe.plans import views
from rollframe.plans.catalog import enough_tasks, query, r6, table

# ---- layouts: one per order, objects from arithmetic on its keys -------------------------


def scenes(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    idx = F.sequence(F.lit(0).cast("long"), 1 + k % 4)
    pick = lambda q, vals: F.element_at(F.array(*[F.lit(v) for v in vals]), (q + 1).cast("int"))

    def obj(i, x, y, q):
        return F.struct(F.when(i == 3, "door 3").otherwise(F.concat(F.lit("obj"), i.cast("string"))).alias("name"), x.alias("x"), y.alias("y"),
                        pick(q, [0, 1, 0, -1]).alias("ox"), pick(q, [1, 0, -1, 0]).alias("oy"), (i % 3 != 2).alias("has_orientation"))
    x = lambda i: (k * 7 + i * 13) % 17 - 8
    y = lambda i: (c * 5 + i * 11) % 15 - 7
    seen = F.filter(idx, lambda i: (k + i) % 5 != 0)
    turned = lambda i: F.when((c + i) % 3 == 0, (k + i + 1) % 4).otherwise((k + i) % 4)
    name = lambda i: F.when(i == 3, "door 3").otherwise(F.concat(F.lit("obj"), i.cast("string")))
    return enough_tasks(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")).select(
        k.alias("scene"), c.alias("sample"), (F.col("o_orderstatus") != "P").alias("is_exploration_phase"),
        F.transform(idx, lambda i: obj(i, x(i), y(i), (k + i) % 4)).alias("gt"),
        F.transform(seen, lambda i: obj(i, x(i) + (k + i * 3) % 3 - 1, y(i) + (c + i) % 3 - 1, turned(i))).alias("pred"),
        F.transform(F.filter(idx, lambda i: (k + i) % 6 != 1), name).alias("observed"),
        F.map_from_entries(F.transform(idx, lambda i: F.struct(name(i), ((k + i) % 4).cast("int")))).alias("possible"))


SCENES = """o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus <> 'P' AS phase, unnest(generate_series(0, 1 + o_orderkey % 4)) AS i FROM orders)
, obj AS (SELECT *, CASE WHEN i = 3 THEN 'door 3' ELSE concat('obj', i) END AS name, (k * 7 + i * 13) % 17 - 8 AS x, (c * 5 + i * 11) % 15 - 7 AS y, (k + i) % 4 AS q,
   i % 3 <> 2 AS oriented, (k + i) % 5 <> 0 AS seen, (k * 7 + i * 13) % 17 - 8 + (k + i * 3) % 3 - 1 AS px, (c * 5 + i * 11) % 15 - 7 + (c + i) % 3 - 1 AS py,
   CASE WHEN (c + i) % 3 = 0 THEN (k + i + 1) % 4 ELSE (k + i) % 4 END AS pq FROM o)"""
_BIN = lambda dx, dy: (f"CASE WHEN {dx} = 0 AND {dy} = 0 THEN 0 ELSE CAST(floor((((-degrees(atan2(-({dx}), {dy})) + 360) % 360) + 22.5) / 45) % 8 AS INTEGER) END")
SIMS = SCENES + f""", withorigin AS (SELECT k, i, x, y, seen, px, py FROM obj UNION ALL SELECT DISTINCT k, -1, 0, 0, true, 0, 0 FROM obj)
, dirs AS (SELECT a.k, avg(CASE WHEN a.seen AND b.seen AND {_BIN('a.x - b.x', 'a.y - b.y')} = {_BIN('a.px - b.px', 'a.py - b.py')} THEN 1.0 ELSE 0.0 END) AS dir
  FROM withorigin a JOIN withorigin b ON a.k = b.k AND a.i > b.i GROUP BY 1)
, face AS (SELECT k, coalesce(avg(CASE WHEN seen AND pq = q THEN 1.0 ELSE 0.0 END) FILTER (oriented AND i <> 3), 1.0) AS facing,
   count(*) AS n, count(*) FILTER (seen) AS m, sqrt(avg((px - x) * (px - x) + (py - y) * (py - y)) FILTER (seen)) AS rmse, sqrt(avg(x * x + y * y) FILTER (seen)) AS rms, sqrt(avg(x * x + y * y)) AS full_rms,
   sum(px * x + py * y) FILTER (seen) / nullif(sum(px * px + py * py) FILTER (seen), 0) AS scale FROM obj GROUP BY 1)
, sims AS (SELECT *, CASE WHEN m = 0 THEN 0.0 WHEN rms > 0 THEN exp(-rmse / rms) * m / n ELSE 0.0 END AS pos FROM face JOIN dirs USING (k))"""


def scored(spark, sf):
    return M.map_metrics(scenes(spark, sf))


for _key, _cols in (("SPA9", ["dir"]), ("SPA10", ["facing"]), ("SPA11", ["pos"]), ("SPA12", ["overall"])):
    _sql = {"dir": "dir", "facing": "facing", "pos": "pos", "overall": "(dir + facing + pos) / 3"}[_cols[0]]
    query(_key, f"WITH {SIMS} SELECT k AS scene, {r6(_sql)} AS {_cols[0]} FROM sims")(
        lambda spark, sf, cols=_cols: scored(spark, sf).select("scene", *cols))


@query("SPA11_scaled", f"""WITH {SIMS}, r AS (SELECT obj.k, sqrt(avg((px * scale - x) * (px * scale - x) + (py * scale - y) * (py * scale - y)) FILTER (seen)) AS srmse FROM obj JOIN face USING (k) GROUP BY 1)
SELECT k AS scene, {r6('CASE WHEN m = 0 OR scale IS NULL THEN 0.0 WHEN rms > 0 THEN exp(-srmse / rms) * m / n ELSE 0.0 END')} AS pos FROM sims JOIN r USING (k)""")
def spa11_scaled(spark, sf):
    return M.map_metrics(scenes(spark, sf), allow_scale=True).select("scene", "pos")


@query("SPA13", f"WITH {SIMS} SELECT k AS scene, {r6('CASE WHEN full_rms > 0 THEN full_rms ELSE 1 END')} AS norm FROM sims")
def spa13(spark, sf):
    return scenes(spark, sf).select("scene", M.norm_length(F.col("gt")).alias("norm"))


@query("SPA14", f"""WITH {SCENES}, both_ AS (SELECT * FROM obj WHERE seen), withorigin AS (SELECT k, i, x, y, px, py FROM both_ UNION ALL SELECT DISTINCT k, -1, 0, 0, 0, 0 FROM both_)
, dirs AS (SELECT a.k, avg(CASE WHEN {_BIN('a.x - b.x', 'a.y - b.y')} = {_BIN('a.px - b.px', 'a.py - b.py')} THEN 1.0 ELSE 0.0 END) AS dir FROM withorigin a JOIN withorigin b ON a.k = b.k AND a.i > b.i GROUP BY 1)
, f AS (SELECT k, coalesce(avg(CASE WHEN pq = q THEN 1.0 ELSE 0.0 END) FILTER (oriented AND i <> 3), 1.0) AS facing, sqrt(avg((px - x) * (px - x) + (py - y) * (py - y))) AS rmse, sqrt(avg(x * x + y * y)) AS rms FROM both_ GROUP BY 1)
SELECT s.k AS scene, {r6('CASE WHEN s.k % 13 = 0 THEN NULL ELSE coalesce(dir, 1.0) END')} AS dir, {r6('CASE WHEN s.k % 13 = 0 THEN NULL ELSE coalesce(facing, 1.0) END')} AS facing,
  {r6('CASE WHEN s.k % 13 = 0 THEN NULL WHEN f.k IS NULL THEN 1.0 WHEN rms > 0 THEN exp(-rmse / rms) ELSE 0.0 END')} AS pos FROM (SELECT DISTINCT k FROM obj) s LEFT JOIN f ON f.k = s.k LEFT JOIN dirs ON dirs.k = s.k""")
def spa14(spark, sf):
    maps = scenes(spark, sf).withColumn("gt", F.when(F.col("scene") % 13 != 0, F.col("gt")))
    return M.common_metrics(maps, "pred", "gt").select("scene", "dir", "facing", "pos")


@query("JOIN11", f"WITH {SCENES} SELECT k AS scene, CAST(count(*) FILTER (seen) AS BIGINT) AS common FROM obj GROUP BY 1")
def join11(spark, sf):
    shared = F.filter("pred", lambda o: F.exists(F.col("gt"), lambda g: g["name"] == o["name"]))
    return scenes(spark, sf).select("scene", F.size(shared).cast("long").alias("common"))


@query("JOIN10", f"WITH {SCENES} SELECT k AS scene, name, seen AS predicted, {r6('CASE WHEN seen THEN px - x END')} AS dx FROM obj")
def join10(spark, sf):
    m = M.match_objects(scenes(spark, sf), "pred", "gt").select("scene", F.explode("_m").alias("m"))
    return m.select("scene", F.col("m.g.name").alias("name"), F.col("m.p").isNotNull().alias("predicted"),
                    (F.col("m.p.x") - F.col("m.g.x")).cast("double").alias("dx"))


@query("JOIN9", f"""WITH {SCENES} SELECT a.k AS scene, CAST(count(*) AS BIGINT) AS pairs, {r6('sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))')} AS total_distance
FROM obj a JOIN obj b ON a.k = b.k AND a.i < b.i GROUP BY 1""")
def join9(spark, sf):
    gt = F.col("gt")
    later = F.transform(gt, lambda a, i: M._sum(F.slice(gt, i + 2, F.size(gt)), lambda b: G.distance(a["x"] - b["x"], a["y"] - b["y"])))
    n = F.size("gt")
    return scenes(spark, sf).select("scene", (n * (n - 1) / 2).cast("long").alias("pairs"), M._sum(later, lambda v: v).alias("total_distance"))


@query("JOIN9_pairs", f"""WITH {SCENES} SELECT a.k AS scene, a.name AS first, b.name AS second, {r6('a.x - b.x')} AS dx, {r6('a.y - b.y')} AS dy,
  {r6('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))')} AS distance FROM obj a JOIN obj b ON a.k = b.k AND a.i < b.i""")
def join9_pairs(spark, sf):
    return M.object_pairs(scenes(spark, sf), "gt", "scene")


@query("PRJ26", f"""WITH {SCENES}, p AS (SELECT a.k AS scene, a.name AS a, b.name AS b, a.x - b.x AS dx, a.y - b.y AS dy FROM obj a JOIN obj b ON a.k = b.k AND a.i < b.i)
SELECT scene, a, b, ['north', 'north east', 'east', 'south east', 'south', 'south west', 'west', 'north west'][{_BIN('dx', 'dy')} + 1] AS direction,
  CASE WHEN dx = 0 AND dy = 0 THEN 'same distance' ELSE 'near' END AS distance FROM p WHERE sqrt(dx * dx + dy * dy) <= 2.000001""")
def prj26(spark, sf):
    return scenes(spark, sf).select("scene", F.inline(M.object_pairs_near(F.col("gt"))))


# The local map is the global one seen from object 0, with every third object shifted.
def local_maps(spark, sf):
    base = scenes(spark, sf)
    agent = F.struct(F.lit("agent").alias("name"), F.lit(2).cast("long").alias("x"), F.lit(-1).cast("long").alias("y"), F.lit(1).alias("ox"), F.lit(0).alias("oy"), F.lit(True).alias("has_orientation"))
    world = base.withColumn("world", F.when(F.col("scene") % 11 != 0, F.concat("pred", F.array(agent))).otherwise(F.col("pred")))

    def local(o):
        x, y = G.to_frame(o["x"], o["y"], F.lit(2), F.lit(-1), F.lit(1), F.lit(0))
        return F.struct(o["name"].alias("name"), (x + F.when(o["name"] == "obj1", 3).otherwise(0)).alias("x"), y.alias("y"),
                        o["ox"].alias("ox"), o["oy"].alias("oy"), o["has_orientation"].alias("has_orientation"))
    return world.withColumn("local", F.transform("pred", local))


_LX, _LY = "-(py + 1)", "(px - 2)"
@query("SPA15", f"""WITH {SCENES}, b AS (SELECT k, i, {_LX} AS x, {_LY} AS y, {_LX} + CASE WHEN i = 1 THEN 3 ELSE 0 END AS px, {_LY} AS py FROM obj WHERE seen)
, f AS (SELECT k, sqrt(avg((px - x) * (px - x) + (py - y) * (py - y))) AS rmse, sqrt(avg(x * x + y * y)) AS rms FROM b GROUP BY 1)
SELECT s.k AS scene, {r6('CASE WHEN s.k % 11 = 0 THEN NULL WHEN f.k IS NULL THEN 1.0 WHEN rms > 0 THEN exp(-rmse / rms) ELSE 0.0 END')} AS pos,
  {r6('CASE WHEN s.k % 11 <> 0 THEN 1.0 END')} AS facing FROM (SELECT DISTINCT k FROM obj) s LEFT JOIN f USING (k)""")
def spa15(spark, sf):
    return M.local_global_consistency(local_maps(spark, sf), "local", "world").select("scene", "pos", "facing")


STABLE = SCENES + """, seq AS (SELECT k, c, lag(k) OVER (PARTITION BY c ORDER BY k) AS pk FROM (SELECT DISTINCT k, c FROM obj WHERE phase))
, j AS (SELECT seq.c, seq.k, n.name, n.i, n.oriented, n.q, n.pq, o.q AS oq, o.pq AS opq, (n.k + n.i) % 4 AS c1, (o.k + o.i) % 4 AS c0,
   sqrt((n.px - n.x) * (n.px - n.x) + (n.py - n.y) * (n.py - n.y)) AS d1, sqrt((o.px - o.x) * (o.px - o.x) + (o.py - o.y) * (o.py - o.y)) AS d0
   FROM seq JOIN obj n ON n.k = seq.k JOIN obj o ON o.k = seq.pk AND o.name = n.name WHERE n.seen AND o.seen AND (o.k + o.i) % 6 <> 1)
, st AS (SELECT seq.c, seq.k, avg(CASE WHEN d1 <= d0 THEN 1.0 ELSE 0.0 END) FILTER (abs(c0 - c1) <= 1) AS ps,
   avg(CASE WHEN opq = oq AND pq <> q THEN 0.0 WHEN pq = q AND opq <> oq THEN 1.0 WHEN pq = opq THEN 1.0 ELSE 0.0 END) FILTER (oriented AND name <> 'door 3') AS fs
   FROM seq LEFT JOIN j ON j.k = seq.k WHERE seq.pk IS NOT NULL GROUP BY 1, 2)"""


def stable(spark, sf):
    return M.stability(scenes(spark, sf), "sample", "scene")


@query("SPA16", f"WITH {STABLE} SELECT c AS sample, k AS scene, {r6('ps')} AS position_stability, {r6('fs')} AS facing_stability, {r6('ps')} AS position_update, {r6('fs')} AS facing_update FROM st")
def spa16(spark, sf):
    return stable(spark, sf)


# ---- exploration logs: one row per event, a user is a sample ------------------------------


def logs(spark, sf):
    def build():
        e = row_numbers(table(spark, sf, "events"), ["user_id"], ["event_id"], "turn")
        k = F.col("event_id")

        def metrics(shift, off):
            a, b, c = ((k + shift) % 10) / 10, ((k + shift) % 7) / 7, ((k * 3 + shift) % 9) / 9
            return F.when((k + shift) % off != 0, F.struct(a.alias("dir"), b.alias("facing"), c.alias("pos"), ((a + b + c) / 3).alias("overall")))
        # Inside a lambda: it keeps the columns out of the stage's one method, which would be too long for the JVM to compile.
        probe = lambda k: F.when(k % 4 != 1, F.struct(((k % 3) / 3).alias("precision"), ((k % 5) / 5).alias("recall"), ((k % 8) / 8).alias("f1")))
        return e.select(
            F.col("user_id").alias("sample"), (F.col("turn") - 1).cast("int").alias("turn"), k, "value", "event_type", (F.col("event_type") != "signup").alias("is_exploration_phase"),
            F.least(F.col("value") / 50, F.lit(1.0)).alias("node_coverage"), F.when(F.col("event_type") != "click", F.col("value") / 80).alias("edge_coverage"),
            F.when(F.col("event_type") != "error", F.col("value")).alias("information_gain"), F.col("turn").cast("int").alias("step"), (k % 7 == 0).alias("is_action_fail"),
            F.when(k % 11 != 0, k % 5 != 0).alias("is_valid_action"),
            F.create_map(F.lit("observe"), (k % 4).cast("int"), F.lit("move"), (k % 3).cast("int")).alias("action_counts"),
            metrics(0, 6).alias("global"), metrics(1, 5).alias("local"), metrics(2, 4).alias("agent"), metrics(3, 7).alias("newly"), metrics(4, 8).alias("full"), metrics(5, 3).alias("consistency"),
            F.transform(F.array(k), probe)[0].alias("probe"))
    return views.once(spark, sf, "logs", build)


def _m(name, shift, off):
    a, b, c = f"((k + {shift}) % 10) / 10", f"((k + {shift}) % 7) / 7", f"((k * 3 + {shift}) % 9) / 9"
    ok = f"CASE WHEN (k + {shift}) % {off} <> 0 THEN"
    return f"{ok} {a} END AS {name}_dir, {ok} {b} END AS {name}_facing, {ok} {c} END AS {name}_pos, {ok} ({a} + {b} + {c}) / 3 END AS {name}_overall"


LOGS = f"""lg AS (SELECT user_id AS sample, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS turn, event_id AS k, value, event_type <> 'signup' AS phase,
  least(value / 50, 1) AS node, CASE WHEN event_type <> 'click' THEN value / 80 END AS edge, CASE WHEN event_type <> 'error' THEN value END AS gain, event_id % 7 = 0 AS failed,
  CASE WHEN event_id % 11 <> 0 THEN event_id % 5 <> 0 END AS valid FROM events)
, ms AS (SELECT *, {_m('global', 0, 6)}, {_m('local', 1, 5)}, {_m('agent', 2, 4)}, {_m('newly', 3, 7)}, {_m('full', 4, 8)}, {_m('consistency', 5, 3)},
  CASE WHEN k % 4 <> 1 THEN k % 3 / 3 END AS probe_precision, CASE WHEN k % 4 <> 1 THEN k % 5 / 5 END AS probe_recall, CASE WHEN k % 4 <> 1 THEN k % 8 / 8 END AS probe_f1 FROM lg)
, lastk AS (SELECT sample, max(turn) FILTER (phase) AS t, max(turn) FILTER (phase AND gain IS NOT NULL) AS tg FROM lg GROUP BY 1)
, sx AS (SELECT sample, max(CASE WHEN turn = t THEN node END) AS node, max(CASE WHEN turn = t THEN edge END) AS edge, max(CASE WHEN turn = t THEN turn + 1 END) AS steps, max(CASE WHEN turn = t THEN k % 4 END) AS observe,
  max(CASE WHEN turn = t THEN k % 3 END) AS move, max(CASE WHEN turn = tg THEN gain END) AS gain, avg(CASE WHEN phase AND failed THEN 1.0 ELSE 0.0 END) AS fail, avg(CASE WHEN coalesce(valid, true) THEN 1.0 ELSE 0.0 END) AS ok
  FROM lg JOIN lastk USING (sample) GROUP BY 1)"""


@query("SPA1", f"""WITH {LOGS} SELECT sample, {r6('node')} AS last_node_coverage, {r6('edge')} AS last_edge_coverage, steps AS n_exploration_steps, CAST(observe AS BIGINT) AS action_cost, {r6('gain')} AS final_information_gain,
  {r6('fail')} AS action_fail_ratio, {r6('ok')} AS valid_action_ratio, CAST(move AS INTEGER) AS n_move, CAST(0 * move AS INTEGER) AS n_term FROM sx""")
def spa1(spark, sf):
    return X.sample_exploration(logs(spark, sf)).select(
        "sample", "last_node_coverage", "last_edge_coverage", "n_exploration_steps", "action_cost", "final_information_gain", "action_fail_ratio", "valid_action_ratio",
        F.col("action_counts")["move"].alias("n_move"), F.col("action_counts")["term"].alias("n_term"))


@query("SPA2", f"""WITH {LOGS} SELECT sample % 3 AS grp, {r6('avg(node)')} AS avg_node_coverage, {r6('avg(edge)')} AS avg_edge_coverage, {r6('avg(steps)')} AS avg_exploration_steps, {r6('avg(observe)')} AS avg_action_cost,
  {r6('avg(fail)')} AS avg_action_fail_ratio, {r6('avg(ok)')} AS avg_valid_action_ratio, {r6('avg(gain)')} AS avg_final_information_gain, {r6('avg(move)')} AS avg_move, {r6('avg(observe)')} AS avg_observe FROM sx GROUP BY 1""")
def spa2(spark, sf):
    return X.group_exploration(X.sample_exploration(logs(spark, sf)).withColumn("grp", F.col("sample") % 3), "grp").drop(
        "avg_rotate", "avg_return", "avg_term", "avg_forced_term")


GAINS = LOGS + """, gl AS (SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY turn) - 1 AS p, gain AS v FROM lg WHERE phase AND gain IS NOT NULL)
, ln AS (SELECT sample, max(p) AS mp FROM gl GROUP BY 1)"""


def gains(spark, sf):
    rows = logs(spark, sf).filter("is_exploration_phase AND information_gain IS NOT NULL").select("sample", "turn", "information_gain")
    return row_numbers(rows, ["sample"], ["turn"], "p").select("sample", (F.col("p") - 1).alias("p"), F.col("information_gain").alias("v"))


@query("SPA3", f"""WITH {GAINS}, pad AS (SELECT sample, unnest(generate_series(0, (SELECT max(mp) FROM ln))) AS p FROM ln)
SELECT p, {r6('avg(v)')} AS mean FROM (SELECT pad.p, gl.v FROM pad JOIN ln USING (sample) JOIN gl ON gl.sample = pad.sample AND gl.p = least(pad.p, mp)) GROUP BY 1""")
def spa3(spark, sf):
    return X.curve_carry_forward(gains(spark, sf), "sample", "p", "v")


@query("SPA4", f"WITH {LOGS} SELECT turn, {r6('avg(edge)')} AS mean FROM lg GROUP BY 1")
def spa4(spark, sf):
    return X.curve_skip_missing(logs(spark, sf), "turn", "edge_coverage")


@query("SPA5", f"""WITH v AS (SELECT user_id % 10 AS grp, 'k' AS path, CAST(json_extract(props, '$.k') AS DOUBLE) AS x FROM events UNION ALL SELECT user_id % 10, 'a.b', CASE WHEN event_id % 3 <> 0 THEN value END FROM events
  UNION ALL SELECT user_id % 10, 'l[0]', value FROM events UNION ALL SELECT user_id % 10, 'l[1]', CASE WHEN event_id % 2 = 0 THEN event_id END FROM events)
SELECT grp, path, {r6('avg(x)')} AS mean, CAST(count(x) AS BIGINT) AS n FROM v GROUP BY 1, 2 HAVING count(x) > 0""")
def spa5(spark, sf):
    from rollframe.functions.nested import average_documents
    doc = F.expr("""concat('{"k":', get_json_object(props, '$.k'), ',"a":{"b":', CASE WHEN event_id % 3 <> 0 THEN CAST(value AS STRING) ELSE 'null' END, ',"c":"x"},"l":[', value,
      CASE WHEN event_id % 2 = 0 THEN concat(',', event_id) ELSE '' END, ']}')""")
    rows = table(spark, sf, "events").select((F.col("user_id") % 10).alias("grp"), doc.alias("doc"))
    return average_documents(rows, ["grp"], "doc").filter("n > 0").select("grp", "path", "mean", "n")


@query("SPA6", f"""WITH {LOGS}, a AS (SELECT sample, count(*) AS n, sum(coalesce(gain, 0)) AS s FROM lg WHERE phase GROUP BY 1)
SELECT sample, {r6('node')} AS node_coverage, {r6('edge')} AS edge_coverage, CAST(n AS BIGINT) AS n_exploration_steps, CAST(observe AS BIGINT) AS exploration_cost, {r6('s')} AS acc_info_gain, {r6('s / n')} AS avg_info_gain FROM sx JOIN a USING (sample)""")
def spa6(spark, sf):
    return X.exploration_summary(logs(spark, sf))


@query("SPA7", f"""SELECT l_orderkey, {r6('coalesce(sum(log2(400.0 / greatest(l_quantity, 1))) / (count(*) * log2(400.0)), 0)')} AS quality FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""")
def spa7(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "initial_pos").otherwise("object").alias("name"),
                                               "l_quantity", F.lit(400).alias("cells"))
    return X.exploration_quality(rows, "cells", "l_quantity", "name", "l_orderkey")


_TASK = "CASE event_type WHEN 'view' THEN 'dir' WHEN 'click' THEN 'rot_dual' WHEN 'error' THEN 'bwd_loc_vision' ELSE 'pov' END"
ANSWERS = f"an AS (SELECT user_id AS sample, {_TASK} AS task, least(value / 30, 1) AS score FROM events)"


def answers(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("sample"), F.expr(_TASK).alias("task"), F.least(F.col("value") / 30, F.lit(1.0)).alias("score"))


@query("SPA8", f"""WITH {ANSWERS}, t AS (SELECT task, count(*) AS n, sum(score) AS s FROM an GROUP BY 1), b AS (SELECT * FROM t UNION ALL SELECT 'overall', sum(n), sum(s) FROM t WHERE task NOT IN ('rot_dual', 'bwd_loc_vision'))
SELECT task, CAST(n AS BIGINT) AS total_count, {r6('s')} AS task_score, {r6('s / n')} AS accuracy FROM b""")
def spa8(spark, sf):
    return X.group_accuracy(answers(spark, sf))


@query("SPA8_sample", f"""WITH {ANSWERS}, t AS (SELECT sample, task, count(*) AS n, sum(score) AS s FROM an GROUP BY 1, 2), b AS (SELECT * FROM t UNION ALL
  SELECT sample, 'overall', coalesce(sum(n) FILTER (task NOT IN ('rot_dual', 'bwd_loc_vision')), 0), coalesce(sum(s) FILTER (task NOT IN ('rot_dual', 'bwd_loc_vision')), 0) FROM t GROUP BY 1)
SELECT sample, task, CAST(n AS BIGINT) AS n_total, {r6('s')} AS task_score, {r6('s / nullif(n, 0)')} AS avg_accuracy FROM b""")
def spa8_sample(spark, sf):
    return X.sample_accuracy(answers(spark, sf))


@query("SPA17", f"WITH {LOGS} SELECT turn, " + ", ".join(f"{r6(f'avg({s}_{m})')} AS {s}_{m}" for s in ("global", "full", "agent") for m in M.METRICS) + " FROM ms GROUP BY 1")
def spa17(spark, sf):
    return M.per_turn_metrics(logs(spark, sf), "turn", ["global", "full", "agent"])


def sample_map_table(spark, sf):
    return M.sample_means(logs(spark, sf).filter("is_exploration_phase"), stable(spark, sf))


_SECT = [("local", "local_error"), ("global", "global_error"), ("agent", "agent_error"), ("newly", "newly_error"), ("consistency", "local_vs_global")]
SAMPLE_MAPS = LOGS + STABLE.replace("o AS (SELECT o_orderkey", ", o AS (SELECT o_orderkey", 1) + """, sm AS (SELECT sample, """ + ", ".join(
    [f"avg({s}_{m}) AS {n}_{m}" for s, n in _SECT for m in M.METRICS] + [f"max(CASE WHEN turn = t THEN full_{m} END) AS correctness_{m}" for m in M.METRICS]
    + [f"avg(probe_{m}) AS probe_{m}" for m in ("precision", "recall", "f1")]) + """ FROM ms JOIN lastk USING (sample) WHERE phase GROUP BY 1)
, steady AS (SELECT c AS sample, avg(ps) AS position_stability_avg, avg(fs) AS facing_stability_avg FROM st GROUP BY 1)
, smx AS (SELECT sm.*, position_stability_avg, facing_stability_avg, position_stability_avg AS position_update_avg, facing_stability_avg AS facing_update_avg FROM sm LEFT JOIN steady USING (sample))"""
_SMCOLS = ([f"{n}_{m}" for _, n in _SECT for m in M.METRICS] + [f"correctness_{m}" for m in M.METRICS] + [f"probe_{m}" for m in ("precision", "recall", "f1")]
           + ["position_update_avg", "facing_update_avg", "position_stability_avg", "facing_stability_avg"])


@query("SPA19", f"WITH {SAMPLE_MAPS} SELECT sample % 3 AS grp, " + ", ".join(f"{r6(f'avg({c})')} AS {c}" for c in _SMCOLS)
       + ", CAST(count(global_error_overall) AS BIGINT) AS n_global, CAST(count(local_error_overall) AS BIGINT) AS n_local, CAST(count(newly_error_overall) AS BIGINT) AS n_newly, CAST(count(probe_f1) AS BIGINT) AS n_probe FROM smx GROUP BY 1")
def spa19(spark, sf):
    return M.group_maps(sample_map_table(spark, sf).withColumn("grp", F.col("sample") % 3), "active", "grp")


@query("SPA19_passive", f"WITH {SAMPLE_MAPS} SELECT sample % 3 AS grp, " + ", ".join(f"{r6(f'avg(correctness_{m})')} AS correctness_{m}" for m in M.METRICS)
       + ", CAST(count(correctness_overall) AS BIGINT) AS n_full FROM smx GROUP BY 1")
def spa19_passive(spark, sf):
    return M.group_maps(sample_map_table(spark, sf).withColumn("grp", F.col("sample") % 3), "passive", "grp")


# ---- probes: cells of a turn, from the key of its event -----------------------------------
def probes(spark, sf):
    k = F.col("event_id")
    cell = lambda i: F.struct(((k + i * 3) % 7).alias("x"), ((k * 2 + i) % 5).alias("y"))
    idx = F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("sample"), k, F.transform(idx, cell).alias("candidates"))
    pick = lambda keep: F.filter(F.transform("candidates", lambda c, i: F.struct(c.alias("c"), keep(i).alias("k"))), lambda z: z["k"])
    rows = rows.withColumn("correct", F.transform(pick(lambda i: (k + i) % 3 == 0), lambda z: z["c"])).withColumn(
        "labels", F.transform(F.filter(idx, lambda i: (k + i) % 2 == 0), lambda i: F.chr(i + 65)))
    return rows.withColumn("labels", F.concat("labels", F.array(F.lit("Z")))).withColumn(
        "predicted", M.chosen_cells(F.col("labels"), F.col("candidates"))).withColumn(
            "explored", F.filter(F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")), F.struct((k % 7).alias("x"), F.lit(4).cast("long").alias("y"))), lambda e: k % 10 != 0)).withColumn(
                "distances", M.nearest_explored(F.col("candidates"), F.col("explored")))


PROBES = """pr AS (SELECT event_id AS k, user_id AS sample, unnest(generate_series(0, 5)) AS i FROM events)
, cell AS (SELECT *, (k + i * 3) % 7 AS x, (k * 2 + i) % 5 AS y, (k + i) % 3 = 0 AS correct, (k + i) % 2 = 0 AS picked,
   CASE WHEN k % 10 = 0 THEN CAST('inf' AS DOUBLE) ELSE sqrt(least(pow((k + i * 3) % 7, 2) + pow((k * 2 + i) % 5, 2), pow((k + i * 3) % 7 - k % 7, 2) + pow((k * 2 + i) % 5 - 4, 2))) END AS d FROM pr)
, u AS (SELECT k, sample, x, y, bool_or(correct) AS correct, bool_or(picked) AS picked, any_value(d) AS d FROM cell GROUP BY 1, 2, 3, 4)
, ps AS (SELECT k, sample, count(*) FILTER (correct AND picked) AS tp, count(*) FILTER (picked AND NOT correct) AS fp, count(*) FILTER (correct AND NOT picked) AS fn FROM u GROUP BY 1, 2)"""
_P, _R = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"
_F1 = "CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END"


@query("SPA20", f"WITH {PROBES} SELECT k AS event_id, {r6(_P)} AS precision, {r6(_R)} AS recall, {r6(_F1)} AS f1 FROM ps")
def spa20(spark, sf):
    return probes(spark, sf).select("event_id", M.cell_scores(F.col("predicted"), F.col("correct")).alias("s")).select("event_id", "s.*")


@query("SPA27", f"WITH {PROBES} SELECT k AS event_id, CAST(count(*) FILTER (picked) AS BIGINT) AS chosen, CAST(sum(x * 10 + y) FILTER (picked) AS BIGINT) AS cells FROM cell GROUP BY 1")
def spa27(spark, sf):
    return probes(spark, sf).select("event_id", F.size("predicted").cast("long").alias("chosen"),
                                    F.aggregate("predicted", F.lit(0).cast("long"), lambda a, c: a + c["x"] * 10 + c["y"]).alias("cells"))


@query("JOIN13", f"WITH {PROBES} SELECT k AS event_id, i, {r6('CASE WHEN k % 10 <> 0 THEN d END')} AS distance FROM cell")
def join13(spark, sf):
    return probes(spark, sf).select("event_id", F.posexplode("distances").alias("i", "distance")).select(
        "event_id", F.col("i").cast("long").alias("i"), text.finite(F.col("distance")).alias("distance"))


@query("SPA21", f"""WITH {PROBES}, t AS (SELECT sample, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ps WHERE tp + fn > 0 GROUP BY 1)
, c AS (SELECT sample, CASE WHEN stddev_pop(d) > 1e-9 AND stddev_pop(CASE WHEN picked THEN 1 ELSE 0 END) > 0 THEN corr(d, CASE WHEN picked THEN 1 ELSE 0 END) END AS r FROM u WHERE correct AND isfinite(d) GROUP BY 1)
SELECT sample, {r6(_P)} AS precision, {r6(_R)} AS recall, {r6(_F1)} AS f1, {r6('r')} AS distance_hit_corr FROM t LEFT JOIN c USING (sample)""")
def spa21(spark, sf):
    return M.probe_summary(probes(spark, sf))


@query("JOIN14", f"WITH {PROBES} SELECT k AS event_id, x, y, {r6('CASE WHEN isfinite(d) THEN d END')} AS distance, picked AS hit FROM u WHERE correct")
def join14(spark, sf):
    rows = probes(spark, sf).select("event_id", "predicted", "candidates", "distances", F.explode(F.array_distinct("correct")).alias("c"))
    at = F.array_position("candidates", F.col("c")).cast("int")
    return rows.select("event_id", "c.x", "c.y", text.finite(F.element_at("distances", at)).alias("distance"), F.array_contains("predicted", F.col("c")).alias("hit"))


@query("JOIN19", f"WITH {LOGS} SELECT sample, turn, {r6('gain')} AS information_gain, {r6('global_overall')} AS overall FROM ms WHERE phase AND global_overall IS NOT NULL")
def join19(spark, sf):
    rows = logs(spark, sf).filter("is_exploration_phase")
    exp, cog = rows.select("sample", "turn", "information_gain"), rows.filter("global IS NOT NULL").select("sample", "turn", F.col("global.overall").alias("overall"))
    return exp.join(cog, ["sample", "turn"])


# ---- belief revision: changes and object scores from the key of the event -----------------
def beliefs(spark, sf):
    k = F.col("event_id")
    idx = F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))
    under, blank = (lambda i: F.concat(F.lit("old_obj_"), i.cast("string"))), (lambda i: F.concat(F.lit("old obj "), i.cast("string")))
    scores = lambda s: F.map_from_entries(F.transform(idx, lambda i: F.struct(blank(i), F.struct(
        F.when((k + i) % 4 != 0, ((k + i + s) % 10) / 10).alias("pos"), (((k + i) * s) % 2).cast("double").alias("facing")))))
    changes = F.transform(F.filter(idx, lambda i: (k + i) % 3 == 0), lambda i: F.struct(under(i).alias("name"), ((k + i) % 2 == 0).alias("pos"), ((k + i) % 5 < 3).alias("ori")))
    return table(spark, sf, "events").select(F.col("user_id").alias("sample"), k, "value", changes.alias("changes"), scores(1).alias("changed_objects"),
                                             scores(3).alias("retention"), scores(7).alias("unchanged_retention"))


def _score(s):
    return f"CASE WHEN (k + i) % 4 <> 0 THEN (k + i + {s}) % 10 / 10 END", f"((k + i) * {s}) % 2"


BELIEF = """bl AS (SELECT user_id AS sample, event_id AS k, unnest(generate_series(0, 3)) AS i FROM events)
, bf AS (SELECT *, (k + i) % 3 = 0 AND (k + i) % 2 = 0 AS moved, (k + i) % 3 = 0 AND (k + i) % 5 < 3 AS turned FROM bl)
, ba AS (SELECT sample, """ + ", ".join(f"avg({_score(s)[0]}) FILTER (moved) AS {n}_pos, avg({_score(s)[1]}) FILTER (turned) AS {n}_facing" for s, n in ((1, "changed"), (3, "retention"))) + f""",
  avg({_score(7)[0]}) AS unchanged_pos, avg({_score(7)[1]}) AS unchanged_facing FROM bf GROUP BY 1)"""


@query("SPA22", f"""WITH {BELIEF} SELECT sample, """ + ", ".join(f"{r6(f'{n}_{m}')} AS {n}_{m}" for n in ("changed", "retention", "unchanged") for m in ("pos", "facing"))
       + f", {r6('1 - pow(retention_pos / nullif(unchanged_pos, 0), 2)')} AS revision_pos, {r6('1 - pow(retention_facing / nullif(unchanged_facing, 0), 2)')} AS revision_facing FROM ba")
def spa22(spark, sf):
    return M.belief_revision(beliefs(spark, sf))


@query("JOIN17", f"WITH {BELIEF} SELECT sample, {r6('changed_pos')} AS changed_pos, {r6('changed_facing')} AS changed_facing FROM ba")
def join17(spark, sf):
    return M.changed_scores(beliefs(spark, sf), "changed_objects")


INERT = """ob AS (SELECT user_id AS sample, event_id % 13 AS ox, event_id % 7 AS oy, event_id % 11 AS nx, event_id % 5 AS ny, event_id % 3 AS tx, event_id % 4 AS ty, value FROM events)
, sg AS (SELECT sample, sqrt(avg(value)) AS s FROM ob WHERE ox < 9 GROUP BY 1)
, iv AS (SELECT sample, CASE WHEN (ox - tx) * (ox - tx) + (oy - ty) * (oy - ty) > 0 AND (nx - tx) * (nx - tx) + (ny - ty) * (ny - ty) > 0 THEN
   ((nx - tx) * (ox - tx) + (ny - ty) * (oy - ty)) / (sqrt((nx - tx) * (nx - tx) + (ny - ty) * (ny - ty)) * sqrt((ox - tx) * (ox - tx) + (oy - ty) * (oy - ty)) + 1e-9)
   * exp(-((nx - ox) * (nx - ox) + (ny - oy) * (ny - oy)) / (2 * coalesce(s, 1) * coalesce(s, 1) + 1e-9)) END AS v FROM ob LEFT JOIN sg USING (sample))"""


@query("SPA23", f"WITH {INERT} SELECT sample, {r6('avg(v)')} AS inertia FROM iv GROUP BY 1")
def spa23(spark, sf):
    return M.inertia(*moved(spark, sf))


def moved(spark, sf):
    k = F.col("event_id")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("sample"), (k % 13).alias("old_x"), (k % 7).alias("old_y"), (k % 11).alias("new_x"),
                                             (k % 5).alias("new_y"), (k % 3).alias("true_x"), (k % 4).alias("true_y"), F.col("value").alias("dist_sq"))
    return rows, rows.filter("old_x < 9")


def unchanged(spark, sf):
    """The unchanged objects' metrics: those of the belief turns, and of each sample's last exploration map."""
    rows = logs(spark, sf)
    turns = rows.select("sample", (F.col("turn") + 1).alias("turn"), *[F.col("global")[m].alias(m) for m in M.METRICS])
    initial = rows.filter("is_exploration_phase").groupBy("sample").agg(F.max_by("full", "turn").alias("m")).select("sample", *[F.col("m")[m].alias(m) for m in M.METRICS])
    return turns, initial


@query("SPA24", f"""WITH {LOGS}, b AS (SELECT sample, turn + 1 AS turn, global_dir AS dir, global_facing AS facing, global_pos AS pos, global_overall AS overall FROM ms UNION ALL
  SELECT sample, 0, max(CASE WHEN turn = t THEN full_dir END), max(CASE WHEN turn = t THEN full_facing END), max(CASE WHEN turn = t THEN full_pos END), max(CASE WHEN turn = t THEN full_overall END) FROM ms JOIN lastk USING (sample) GROUP BY 1)
SELECT sample, CAST(turn AS INTEGER) AS turn, {r6('dir')} AS dir, {r6('facing')} AS facing, {r6('pos')} AS pos, {r6('overall')} AS overall FROM b""")
def spa24(spark, sf):
    turns, initial = unchanged(spark, sf)
    everyone = logs(spark, sf).select("sample").distinct().join(initial, "sample", "left")
    return M.unchanged_per_turn(turns, everyone, "sample", "turn")


@query("SPA24_retention", f"WITH {BELIEF} SELECT sample, {r6('unchanged_pos')} AS unchanged_pos, {r6('unchanged_facing')} AS unchanged_facing FROM ba")
def spa24_retention(spark, sf):
    return M.unchanged_retention(beliefs(spark, sf), "unchanged_retention")


# ---- all map metrics of a sample: its own row, then its per-turn lists as rows ----------------
_SERIES = {"turn": {f"{n}_per_turn_{m}": f"{s}_{m}" for n, s in M.SERIES.items() for m in M.METRICS} | {f"fog_probe_{n}_per_turn": f"probe_{m}" for n, m in M.PROBE.items()},
           "stability": {f"{c}_per_turn": {"p": "ps", "f": "fs"}[c[0]] for c in M.STEADY}, "belief": {f"cogmap_fb_unchanged_per_turn_{m}": m for m in M.METRICS}}
_FB = ({f"fb_{n}_{m}": f"{n}_{m}" for n in ("changed", "retention") for m in ("pos", "facing")} | {f"fb_unchanged_retention_{m}": f"unchanged_{m}" for m in ("pos", "facing")}
       | {f"fb_revision_{m}": f"1 - pow(retention_{m} / nullif(unchanged_{m}, 0), 2)" for m in ("pos", "facing")} | {"fb_inertia": "inertia"}
       | {f"fb_unchanged_{m}": f"fbm.{m}" for m in M.METRICS} | {f"fb_unchanged_exploration_{m}": f"correctness_{m}" for m in M.METRICS})
_SUMMARY = {c: c for c in _SMCOLS[:-4]} | {f"{c}_avg": f"CASE WHEN maps > 0 THEN {c[:1]}s END" for c in M.STEADY} | _FB


def _part(name, position, source, values):
    cols = [f"{r6(values[c])} AS {c}" if c in values else f"CAST(NULL AS DOUBLE) AS {c}" for c in (*_SUMMARY, *(c for p in _SERIES.values() for c in p))]
    return f"SELECT sample, '{name}' AS part, CAST({position} AS INTEGER) AS position, {', '.join(cols)} FROM {source}"


SAMPLE_WHOLE = LOGS + STABLE.replace("o AS (SELECT o_orderkey", ", o AS (SELECT o_orderkey", 1) + f"""
, lt AS (SELECT *, max(turn) FILTER (phase) OVER (PARTITION BY sample) AS t FROM ms)
, sm AS (SELECT sample, count(*) FILTER (phase) AS maps, """ + ", ".join(
    [f"avg({s}_{m}) FILTER (phase) AS {n}_{m}" for s, n in _SECT for m in M.METRICS] + [f"max(CASE WHEN turn = t THEN full_{m} END) AS correctness_{m}" for m in M.METRICS]
    + [f"avg(probe_{m}) FILTER (phase) AS probe_{m}" for m in M.PROBE.values()]) + f""" FROM lt GROUP BY 1)
, steady AS (SELECT c AS sample, avg(ps) AS ps, avg(fs) AS fs FROM st GROUP BY 1), {BELIEF}, {INERT}, inert AS (SELECT sample, avg(v) AS inertia FROM iv GROUP BY 1)
, fbt AS (SELECT sample, turn + 1 AS turn, {', '.join(f'global_{m} AS {m}' for m in M.METRICS)} FROM ms)
, fbm AS (SELECT sample, {', '.join(f'avg({m}) AS {m}' for m in M.METRICS)} FROM fbt GROUP BY 1)
, fbs AS (SELECT * FROM fbt UNION ALL SELECT sample, 0, {', '.join(f'correctness_{m}' for m in M.METRICS)} FROM sm WHERE correctness_overall IS NOT NULL)
, sx2 AS (SELECT sm.*, steady.* EXCLUDE (sample), ba.* EXCLUDE (sample), inertia, fbm FROM sm LEFT JOIN steady ON steady.sample IS NOT DISTINCT FROM sm.sample
  LEFT JOIN ba ON ba.sample IS NOT DISTINCT FROM sm.sample LEFT JOIN inert ON inert.sample IS NOT DISTINCT FROM sm.sample LEFT JOIN fbm ON fbm.sample IS NOT DISTINCT FROM sm.sample)"""


@query("SPA18", f"WITH {SAMPLE_WHOLE} " + " UNION ALL ".join([
    _part("sample", "NULL", "sx2", _SUMMARY), _part("turn", "row_number() OVER (PARTITION BY sample ORDER BY turn) - 1", "ms WHERE phase", _SERIES["turn"]),
    _part("stability", "0", "sm WHERE maps > 0", {}),
    _part("stability", "row_number() OVER (PARTITION BY sample ORDER BY k)", "(SELECT c AS sample, k, ps, fs FROM st WHERE EXISTS (SELECT 1 FROM sm WHERE maps > 0 AND sm.sample IS NOT DISTINCT FROM st.c))", _SERIES["stability"]),
    _part("belief", "row_number() OVER (PARTITION BY sample ORDER BY turn) - 1", "fbs", _SERIES["belief"])]))
def spa18(spark, sf):
    turns, initial = unchanged(spark, sf)
    initial = initial.filter("overall IS NOT NULL")
    belief = M.belief_means(beliefs(spark, sf), *moved(spark, sf), turns, initial)
    whole = M.sample_maps(logs(spark, sf), stable(spark, sf), stable_turn="scene", belief=belief, unchanged=M.unchanged_per_turn(turns, initial, "sample", "turn"))
    # Means on the middle of two roundings go the way of SQL, which rounds a product.
    return whole.withColumns({c: F.round(F.round(c, 12) * 1e6, 0) / 1e6 for c in _SUMMARY})


# By the remainder of the event: what is named, and what the room and the observation hold. The sofa stands 1 to 9 steps ahead of the lamp.
@query("SPA25_view", f"""SELECT event_id, {r6("""CASE event_id % 8 WHEN 0 THEN CASE WHEN user_id % 9 IN (2, 3) THEN 1 ELSE 0 END WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN 1
  WHEN 6 THEN CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN user_id % 9 IN (4, 5, 6, 7) THEN 1 ELSE 0 END END""")} AS score FROM events""")
def spa25_view(spark, sf):
    k = F.col("event_id") % 8
    pred = F.element_at(F.array(*[F.lit(x) for x in (" Lamp ", "chair", "chair", "ghost", "lamp", "NE", "lamp", "LAMP")]), (k + 1).cast("int"))
    answer = F.expr("""CASE WHEN event_id % 8 = 5 THEN 'north east' ELSE concat('{"answer": "', CASE event_id % 8 WHEN 2 THEN 'Chair' WHEN 1 THEN 'lamp' ELSE 'table' END, '", "room_id": ',
      CASE WHEN event_id % 8 = 6 THEN '[1]' ELSE '1' END, ', "object_positions": {"Lamp": [', user_id % 5, ', ', user_id % 3, '], "sofa": [', user_id % 5, ', ', user_id % 3 + 1 + user_id % 9,
      '], "chair": [', user_id % 5 + 12, ', ', user_id % 3, '], "door": [', user_id % 5 + 1, ', ', user_id % 3 + 1, ']}, "object_orientations": {"lamp": [0, 1], "sofa": [0, -2], "door": [0, 1]}',
      CASE WHEN event_id % 8 = 4 THEN ', "object_rooms": {"sofa": 2}' ELSE ', "object_rooms": {"sofa": [3, 1]}' END,
      ', "gate_info": {"door": {"room_ids": [1, 2], "ori_by_room": {"1": ', CASE WHEN user_id % 2 = 0 THEN '[0, -1]' ELSE '[1, 0]' END, '}}}, "final_observation": [',
      CASE WHEN event_id % 8 = 6 THEN '{"name": "Door", "direction": "front right", "distance": "near", "orientation": "on front wall"}'
        ELSE concat('{"name": "sofa", "direction": "left", "distance": "near"}, {"name": "Sofa ", "direction": "front", "distance": "', CASE WHEN event_id % 8 = 7 THEN 'slightly far' ELSE 'mid' END, '", "orientation": "facing backward"}') END, ']}') END""")
    return table(spark, sf, "events").select("event_id", scoring.score(F.lit("BackwardPovTextEvaluationTask"), pred, answer).alias("score"))


@query("SPA25", f"""SELECT event_id, {r6('''CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END WHEN 1 THEN CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0 END
  WHEN 2 THEN CASE WHEN event_id % 4 = 2 THEN 1 ELSE 0 END WHEN 3 THEN 2.0 / (2 + 1 + event_id % 3) WHEN 4 THEN CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END
  ELSE exp(-sqrt(pow(user_id % 9 - user_id % 4, 2)) / sqrt(pow(user_id % 4, 2) + 9)) END''')} AS score FROM events""")
def spa25(spark, sf):
    k = F.col("event_id")
    rows = table(spark, sf, "events").withColumn("pred", F.expr("""CASE event_id % 6
      WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN '[Move  Up, "left"]' ELSE '(left, move up)' END WHEN 1 THEN CASE event_id % 3 WHEN 0 THEN 'mid; NE' WHEN 1 THEN 'north west, medium' ELSE 'south' END
      WHEN 2 THEN CASE WHEN event_id % 4 = 2 THEN ' North-East ' ELSE 'east' END WHEN 3 THEN CASE event_id % 3 WHEN 0 THEN '(Lamp)' WHEN 1 THEN '(Lamp, x)' ELSE '(Lamp, x, y, Y)' END
      WHEN 4 THEN CASE WHEN event_id % 4 = 0 THEN ' b ' ELSE 'c' END ELSE concat('at ( ', user_id % 9, ' , 3.0) facing') END"""))
    answer = F.expr("CASE event_id % 6 WHEN 0 THEN 'move up, left' WHEN 1 THEN 'north east, mid distance' WHEN 2 THEN 'ne' END")
    task = F.expr("CASE event_id % 6 WHEN 0 THEN 'RotEvaluationTask' WHEN 1 THEN 'DirectionEvaluationTask' WHEN 2 THEN 'BackwardPovVisionEvaluationTask' WHEN 3 THEN 'presence' WHEN 4 THEN 'choice' ELSE 'location' END")
    options = {**scoring.EVALUATORS, "presence": lambda p, a: scoring.object_presence(p, F.array(F.lit("lamp"), F.lit("sofa"))),
               "choice": lambda p, a: scoring.multiple_choice(p, F.array(F.lit("A"), F.lit("B"))),
               "location": lambda p, a: scoring.location(p, (F.col("user_id") % 4).cast("double"), F.lit(3.0))}
    return rows.select("event_id", scoring.score(task, F.col("pred"), answer, options).alias("score"))


@query("SPA25_points", f"""WITH {SIMS} SELECT k AS scene, {r6('CASE WHEN m <> n THEN 0.0 ELSE (dir + pos) / 2 END')} AS score FROM sims""")
def spa25_points(spark, sf):
    said = F.array_join(F.transform("pred", lambda o: F.concat(F.lit("("), o["x"], F.lit(", "), o["y"], F.lit(")"))), " ")
    return scenes(spark, sf).select("scene", scoring.coordinate_set(said, F.col("gt")).alias("score"))


@query("SPA26", f"""WITH {LOGS}, s AS (SELECT sample, turn, (greatest(0, coalesce(full_dir, 0) - 0.125) + greatest(0, coalesce(full_facing, 0) - 0.25) + coalesce(full_pos, 0) + node) / 4 AS score, failed FROM ms)
SELECT sample, turn, {r6('score')} AS score, {r6('score * 10 - CASE WHEN failed THEN 2 ELSE 0 END')} AS reward FROM s""")
def spa26(spark, sf):
    r = M.map_reward(F.col("full.dir"), F.col("full.facing"), F.col("full.pos"), F.col("node_coverage"), F.col("is_action_fail"))
    return logs(spark, sf).select("sample", "turn", r.alias("r")).select("sample", "turn", "r.*")


@query("JOIN12", """WITH a(spelling, label) AS (VALUES ('n', 'north'), ('e', 'east'), ('s', 'south'), ('w', 'west'), ('nw', 'northwest')), l AS (SELECT event_id, ['N', 'e', ' S', 'W', 'n-w', 'up'][CAST(event_id % 6 + 1 AS INTEGER)] AS said FROM events)
SELECT event_id, coalesce(label, regexp_replace(lower(said), '[ -]+', '', 'g')) AS label FROM l LEFT JOIN a ON spelling = regexp_replace(lower(said), '[ -]+', '', 'g')""")
def join12(spark, sf):
    said = F.element_at(F.array(*[F.lit(s) for s in ("N", "e", " S", "W", "n-w", "up")]), (F.col("event_id") % 6 + 1).cast("int"))
    # The alias table is a fixed list of spellings.
    aliases = F.broadcast(spark.createDataFrame(text.alias_pairs(), "spelling string, canonical string"))
    keyed = table(spark, sf, "events").select("event_id", text.label_key(said).alias("key"))
    return keyed.join(aliases, F.col("key") == F.col("spelling"), "left").select("event_id", F.coalesce("canonical", "key").alias("label"))


def task_scenes(spark, sf):
    k = F.col("o_orderkey")
    idx = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    obj = lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("id"), ((k + i * 3) % 6).cast("double").alias("x"), ((k * 2 + i) % 5).cast("double").alias("z"),
                             ((k + i) % 4 != 0).alias("usable"), F.when((k + i) % 3 == 0, F.array(F.concat(F.lit("box"), (i % 2).cast("string")))).alias("parents"))
    spot = lambda i: F.struct((i % 3 * 2).cast("double").alias("x"), F.floor(i / 3).cast("double").alias("z"))
    return table(spark, sf, "orders").select(k.alias("scene"), F.transform(idx(3), obj).alias("objects"),
                                             F.when(k % 2 == 0, F.array(F.lit("box0"))).otherwise(F.array().cast("array<string>")).alias("closed"),
                                             F.transform(idx(6), spot).alias("positions"))


@query("JOIN18", """WITH t AS (SELECT o_orderkey AS k, unnest(generate_series(0, 2)) AS i FROM orders), tg AS (SELECT k, concat('t', i) AS id, (k + i * 3) % 6 AS x, (k * 2 + i) % 5 AS z FROM t
  WHERE (k + i) % 4 <> 0 AND NOT ((k + i) % 3 = 0 AND k % 2 = 0 AND i % 2 = 0)), p AS (SELECT k, x AS tx, z AS tz, id, unnest(generate_series(0, 5)) AS j FROM tg)
, c AS (SELECT k, id, tx, tz, CAST(j % 3 * 2 AS DOUBLE) AS sx, CAST(j // 3 AS DOUBLE) AS sz FROM p), far AS (SELECT *, md5(concat_ws('|', '0', k, id, sx, sz)) AS draw FROM c WHERE sqrt((sx - tx) * (sx - tx) + (sz - tz) * (sz - tz)) >= 2)
SELECT k AS scene, id AS target, sx AS start_x, sz AS start_z, CAST(CAST(concat('0x', substr(draw, 1, 4)) AS BIGINT) % 4 * 90 AS DOUBLE) AS rotation
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY draw) AS r FROM far) WHERE r <= 4""")
def join18(spark, sf):
    return M.navigation_tasks(task_scenes(spark, sf), 4)


@query("SET3", f"WITH {SCENES} SELECT k AS scene, string_agg(name, ',' ORDER BY name) AS unchanged FROM obj WHERE NOT seen GROUP BY 1")
def set3(spark, sf):
    names = lambda c: F.transform(c, lambda o: o["name"])
    return scenes(spark, sf).select("scene", F.array_join(F.array_sort(F.array_except(names(F.col("gt")), names(F.col("pred")))), ",").alias("unchanged")).filter("unchanged <> ''")
