"""Predicted maps against true layouts.

A map row is one logged turn: it carries its predicted and its true objects as arrays, as
the logs do. Everything about one layout is computed inside its row with array functions,
so layouts never meet each other, nothing is shuffled and no pairs are written out.
Objects are ``struct<name, x, y, ox, oy, has_orientation>``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollframe.distributed import SLICE, has_hot_key, null_safe, ordered, previous, row_numbers
from rollframe.functions import geometry as G
from rollframe.session import stage

METRICS = ["dir", "facing", "pos", "overall"]
STEADY = ["position_update", "facing_update", "position_stability", "facing_stability"]
# Per-turn lists and the section of a turn that they come from; the short names of the probe's lists.
SERIES = {"cogmap_update": "global", "cogmap_full": "full", "self_tracking": "agent"}
PROBE = {"p": "precision", "r": "recall", "f1": "f1"}
# What guessing would score, and the scales of the map reward.
DIR_BASELINE, FACING_BASELINE, REWARD_SCALE, FORCED_PENALTY = 1.0 / 8.0, 1.0 / 4.0, 10.0, 2.0


def _sum(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, o: a + value(o))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once per row, however often it is looked at."""
    return F.transform(F.array(value), use)[0]


def _find(objects: Column, name: Column) -> Column:
    return F.try_element_at(F.filter(objects, lambda p: p["name"] == name), F.lit(-1))


def match_objects(maps: DataFrame, pred: str, truth: str, out: str = "_m") -> DataFrame:
    """Each true object with the predicted one of the same name (null if there is none)."""
    return maps.withColumn(out, F.transform(truth, lambda g: F.struct(g.alias("g"), _find(F.col(pred), g["name"]).alias("p"))))


def _points(matched: Column) -> Column:
    """True and predicted positions as plain doubles, so that pair loops touch flat fields only."""
    d = lambda c: c.cast("double")
    return F.transform(matched, lambda m: F.struct(
        d(m["g"]["x"]).alias("gx"), d(m["g"]["y"]).alias("gy"), d(m["p"]["x"]).alias("px"), d(m["p"]["y"]).alias("py")))


def direction_similarity(points: Column) -> Column:
    """Share of unordered true pairs, a virtual origin included, whose predicted compass bin is right.

    ``points`` are flat positions; a missing prediction makes its pairs wrong.
    """
    bin_of = lambda dx, dy: G.octant(G.bearing(dx, dy))

    def alone(a: Column) -> Column:
        return F.when(bin_of(a["gx"], a["gy"]) == bin_of(a["px"], a["py"]), 1.0).otherwise(0.0)

    def pair(a: Column, b: Column) -> Column:
        return F.when(bin_of(a["gx"] - b["gx"], a["gy"] - b["gy"]) == bin_of(a["px"] - b["px"], a["py"] - b["py"]), 1.0).otherwise(0.0)

    n = F.size(points)
    rows = F.transform(points, lambda a, i: F.aggregate(
        F.slice(points, i + 2, F.greatest(n, F.lit(1))), alone(a), lambda acc, b: acc + pair(a, b)))
    return F.when(n == 0, 1.0).otherwise(_sum(rows, lambda x: x) / (n * (n + 1) / 2))


def facing_similarity(matched: Column) -> Column:
    """Share of oriented true objects, doors and gates aside, that face the right way; none gives 1."""
    low = lambda m: F.lower(m["g"]["name"])
    judged = F.filter(matched, lambda m: m["g"]["has_orientation"] & ~low(m).contains("door"))
    hit = _sum(judged, lambda m: F.when((m["p"]["ox"] == m["g"]["ox"]) & (m["p"]["oy"] == m["g"]["oy"]), 1.0).otherwise(0.0))
    return F.when(F.size(judged) == 0, 1.0).otherwise(hit / F.size(judged))


def coordinate_similarity_of(matched: Column, norm: Column | None = None) -> Column:
    """Mean of position and direction similarity of already matched points."""
    return (position_similarity(matched, norm) + direction_similarity(_points(matched))) / 2


def position_similarity(matched: Column, norm: Column | None = None, allow_scale: bool = False) -> Column:
    """``exp(-rmse/L)`` over matched objects times the share matched."""
    paired = F.filter(matched, lambda z: z["p"].isNotNull())
    return _once(paired, lambda m: _position(m, F.size(matched), norm, allow_scale))


def _position(m: Column, objects: Column, norm: Column | None, allow_scale: bool) -> Column:
    k = F.size(m).cast("double")
    d = lambda c: c.cast("double")
    den = _sum(m, lambda z: d(z["p"]["x"]) * z["p"]["x"] + d(z["p"]["y"]) * z["p"]["y"])

    def squares(scale: Column) -> Column:
        def gap(z: Column) -> Column:
            ex, ey = d(z["p"]["x"]) * scale - z["g"]["x"], d(z["p"]["y"]) * scale - z["g"]["y"]
            return ex * ex + ey * ey
        return _sum(m, gap)
    if allow_scale:
        inner = _sum(m, lambda z: d(z["p"]["x"]) * z["g"]["x"] + d(z["p"]["y"]) * z["g"]["y"])
        total = _once(inner / F.nullif(den, F.lit(0.0)), squares)
    else:
        total = squares(F.lit(1.0))
    rmse = F.sqrt(total / k)
    rms = F.sqrt(_sum(m, lambda z: d(z["g"]["x"]) * z["g"]["x"] + d(z["g"]["y"]) * z["g"]["y"]) / k)
    length = F.coalesce(F.nullif(norm, F.lit(0.0)), rms) if norm is not None else rms
    score = _once(length, lambda u: F.when(u > 0, F.exp(-rmse / u)).otherwise(0.0)) * k / objects
    if allow_scale:
        score = F.when(den == 0, 0.0).otherwise(score)
    return F.when(objects == 0, 1.0).when(k == 0, 0.0).otherwise(score)


def map_metrics(maps: DataFrame, pred: str = "pred", truth: str = "gt", norm: Column | None = None,
                allow_scale: bool = False, prefix: str = "") -> DataFrame:
    """Add dir, facing, pos and their mean."""
    m = match_objects(maps, pred, truth)
    m = m.withColumn("_xy", _points(F.col("_m")))
    m = m.withColumn("_d", direction_similarity(F.col("_xy"))).withColumn("_f", facing_similarity(F.col("_m"))).withColumn(
        "_p", position_similarity(F.col("_m"), norm, allow_scale))
    return m.select("*", F.col("_d").alias(f"{prefix}dir"), F.col("_f").alias(f"{prefix}facing"), F.col("_p").alias(f"{prefix}pos"),
                    ((F.col("_d") + F.col("_f") + F.col("_p")) / 3).alias(f"{prefix}overall")).drop("_m", "_xy", "_d", "_f", "_p")


def norm_length(objects: Column) -> Column:
    """Root mean square distance of the true objects from the start; 1 if there is none."""
    n = F.size(objects)
    rms = F.sqrt(_sum(objects, lambda o: o["x"].cast("double") * o["x"] + o["y"].cast("double") * o["y"]) / F.nullif(n, F.lit(0)))
    return F.coalesce(F.nullif(rms, F.lit(0.0)), F.lit(1.0))


def common_metrics(maps: DataFrame, a: str, b: str, norm: Column | None = None, allow_scale: bool = False) -> DataFrame:
    """Compare two maps on the objects they share: an empty first map is perfect, no overlap is
    wrong, a missing map has no score."""
    shared = F.filter(a, lambda o: F.exists(F.col(b), lambda q: q["name"] == o["name"]))
    cut = maps.withColumn("_a", shared).withColumn("_b", F.filter(b, lambda o: F.exists(F.col(a), lambda q: q["name"] == o["name"])))
    scored = map_metrics(cut, "_a", "_b", norm, allow_scale, prefix="_")
    gone, empty, apart = F.col(a).isNull() | F.col(b).isNull(), F.size(a) == 0, F.size("_a") == 0
    return scored.select(*maps.columns, *[
        F.when(gone, F.lit(None).cast("double")).when(empty, 1.0).when(apart, 0.0).otherwise(F.col(f"_{m}")).alias(m) for m in METRICS])


def recentered(objects: Column, agent: Column) -> Column:
    """Object positions seen from the agent; headings stay absolute."""
    def move(o: Column) -> Column:
        x, y = G.to_frame(o["x"], o["y"], agent["x"], agent["y"], agent["ox"], agent["oy"])
        return F.struct(o["name"].alias("name"), x.alias("x"), y.alias("y"), o["ox"].alias("ox"), o["oy"].alias("oy"),
                        o["has_orientation"].alias("has_orientation"))
    return F.transform(objects, move)


def local_global_consistency(maps: DataFrame, local: str, world: str, norm: Column | None = None) -> DataFrame:
    """The local map against the global one seen from its predicted agent; no agent, no score."""
    agent = maps.withColumn("_agent", _find(F.col(world), F.lit("agent")))
    seen = agent.withColumn("_world", F.when(F.col("_agent").isNotNull(), recentered(F.col(world), F.col("_agent"))))
    return common_metrics(seen, local, "_world", norm).drop("_agent", "_world")


def object_pairs_near(objects: Column, limit: float = G.PROXIMITY) -> Column:
    """Pairs of one layout that lie within the proximity limit, with bearing and distance bins."""
    def near(a: Column, i: Column) -> Column:
        close = F.filter(F.slice(objects, i + 2, F.greatest(F.size(objects), F.lit(1))),
                         lambda b: G.distance(a["x"] - b["x"], a["y"] - b["y"]) <= limit + 1e-6)
        return F.transform(close, lambda b: F.struct(
            a["name"].alias("a"), b["name"].alias("b"),
            G.octant_name(G.bearing(a["x"] - b["x"], a["y"] - b["y"])).alias("direction"),
            G.distance_bin(G.distance(a["x"] - b["x"], a["y"] - b["y"])).alias("distance")))
    return F.flatten(F.transform(objects, near))


def stability(maps: DataFrame, sample: str, turn: str, threshold: int = 1) -> DataFrame:
    """Between adjacent exploration turns: share of objects whose position and facing got no worse.

    Needs ``pred``, ``gt``, ``observed`` (names) and ``possible`` (name to position count).
    """
    # What the comparison needs of a row, and no more, goes through the ordering.
    def needed(n: Column) -> Column:
        return F.struct(n.alias("name"), _find(F.col("pred"), n).alias("p"), _find(F.col("gt"), n).alias("g"), F.try_element_at(F.col("possible"), n).alias("c"),
                        F.coalesce(F.array_contains("observed", n), F.lit(False)).alias("seen"))

    def flat(o: Column) -> Column:
        place = lambda q: F.struct(*[q[c].alias(c) for c in ("x", "y", "ox", "oy")])
        return F.struct(o["name"].alias("name"), place(o["p"]).alias("p"), place(o["g"]).alias("g"), o["g"]["has_orientation"].alias("turns"), o["c"].alias("c"), o["seen"].alias("seen"))
    known = F.filter(F.transform(F.array_distinct(F.transform("gt", lambda g: g["name"])), needed),
                     lambda o: (o["name"] != "agent") & o["p"].isNotNull() & o["g"].isNotNull())
    phase = maps.filter("is_exploration_phase")
    rows = phase.select(sample, turn, F.transform(known, flat).alias("now"))
    if has_hot_key(phase, [sample]):
        pairs = previous(ordered(rows, [sample], [turn]), [sample], [turn], {"old": "now"}).drop(SLICE)
    else:
        pairs = rows.withColumn("old", F.lag("now").over(Window.partitionBy(sample).orderBy(turn)))
    pairs = pairs.filter("old is not null")

    def four(o: Column) -> Column:
        return F.struct(o.alias("old"), _find(F.col("now"), o["name"]).alias("new"))

    def joint(z: Column) -> Column:
        return F.struct(z["old"]["name"].alias("name"), z["new"]["p"].alias("p1"), z["old"]["p"].alias("p0"), z["new"]["g"].alias("g1"), z["old"]["g"].alias("g0"),
                        z["new"]["turns"].alias("turns"), z["new"]["c"].alias("c1"), z["old"]["c"].alias("c0"))
    objs = pairs.withColumn("_o", F.transform(F.filter(F.transform(F.filter("old", lambda o: o["seen"]), four), lambda z: z["new"].isNotNull()), joint))
    dist = lambda p, g: G.distance(p["x"] - g["x"], p["y"] - g["y"])
    same = lambda p, g: (p["ox"] == g["ox"]) & (p["oy"] == g["oy"])
    still = F.filter("_o", lambda o: F.coalesce(F.abs(o["c0"] - o["c1"]) <= threshold, F.lit(False)))
    faced = F.filter("_o", lambda o: o["turns"] & ~F.lower(o["name"]).rlike("door|gate"))

    def facing(o: Column) -> Column:
        before, after = same(o["p0"], o["g0"]), same(o["p1"], o["g1"])
        return F.when(before & ~after, 0.0).when(after & ~before, 1.0).when(same(o["p1"], o["p0"]), 1.0).otherwise(0.0)
    mean = lambda arr, f: _once(arr, lambda a: F.when(F.size(a) > 0, _sum(a, f) / F.size(a)))
    pos = mean(still, lambda o: F.when(dist(o["p1"], o["g1"]) <= dist(o["p0"], o["g0"]), 1.0).otherwise(0.0))
    fac = mean(faced, facing)
    shares = objs.select(sample, turn, pos.alias("position_stability"), fac.alias("facing_stability"))
    return shares.select("*", F.col("position_stability").alias("position_update"), F.col("facing_stability").alias("facing_update"))


def per_turn_metrics(logs: DataFrame, turn: str, sections: list[str]) -> DataFrame:
    """Mean of each section's metrics per turn over samples; invalid turns carry null."""
    return logs.groupBy(turn).agg(*[F.avg(F.col(s)[m]).alias(f"{s}_{m}") for s in sections for m in METRICS])


def _with_map(mapped: Column | None) -> Column:
    return F.col("is_exploration_phase") if mapped is None else F.col("is_exploration_phase") & mapped


def sample_means(logs: DataFrame, stable: DataFrame, sample: str = "sample", turn: str = "turn", mapped: Column | None = None) -> DataFrame:
    """Per sample: mean error of each section, last correctness, consistency, probe scores.

    ``logs`` has metric structs ``local``, ``global``, ``agent``, ``newly``, ``full`` and
    ``consistency`` (null when invalid) and ``probe`` (precision, recall, f1). ``mapped`` tells
    which exploration turns carry a map; without it all do. A sample without one has nulls.
    """
    here = _with_map(mapped)
    sections = {"local": "local_error", "global": "global_error", "agent": "agent_error", "newly": "newly_error", "consistency": "local_vs_global"}
    aggs = [F.avg(F.when(here, F.col(s)[m])).alias(f"{n}_{m}") for s, n in sections.items() for m in METRICS]
    aggs += [F.max_by(F.col("full")[m], F.when(here, F.col(turn))).alias(f"correctness_{m}") for m in METRICS]
    aggs += [F.avg(F.when(here, F.col("probe")[m])).alias(f"probe_{m}") for m in PROBE.values()]
    steady = stable.groupBy(sample).agg(*[F.avg(c).alias(f"{c}_avg") for c in STEADY])
    means = null_safe(logs.groupBy(sample).agg(F.count_if(here).alias("_maps"), *aggs), steady, [sample], "left")
    return means.withColumns({f"{c}_avg": F.when(F.col("_maps") > 0, F.col(f"{c}_avg")) for c in STEADY}).drop("_maps")


def sample_series(logs: DataFrame, stable: DataFrame, sample: str = "sample", turn: str = "turn", stable_turn: str | None = None,
                  mapped: Column | None = None, unchanged: DataFrame | None = None) -> DataFrame:
    """The per-turn lists of each sample as rows of ``part`` and ``position`` (from 0, dense).

    ``turn`` rows hold the global map's own, full and self-tracking metrics and the probe of the
    turns with a map, ``stability`` rows one turn against the one before (none at first), and
    ``belief`` rows ``unchanged``, the metrics by :func:`unchanged_per_turn`. An invalid turn has nulls.
    """
    rows = logs.filter(_with_map(mapped))
    values = [F.col(s)[m].alias(f"{n}_per_turn_{m}") for n, s in SERIES.items() for m in METRICS] + [
        F.col("probe")[m].alias(f"fog_probe_{n}_per_turn") for n, m in PROBE.items()]
    at = stable_turn or turn

    def part(name: str, df: DataFrame, order: str, first: int) -> DataFrame:
        place = (F.col("_place") + (first - 1)).cast("int").alias("position")
        numbered = row_numbers(df, [sample], [order], "_place")
        return numbered.select(sample, F.lit(name).alias("part"), place, *[c for c in df.columns if c not in (sample, order)])
    turns = part("turn", rows.select(sample, turn, *values), turn, 0)
    own = rows.select(sample).distinct()
    steps = stable.select(sample, at, *[F.col(c).alias(f"{c}_per_turn") for c in STEADY])
    parts = [turns, own.withColumns({"part": F.lit("stability"), "position": F.lit(0)}), part("stability", null_safe(steps, own, [sample], "left_semi"), at, 1)]
    if unchanged is not None:
        parts.append(part("belief", unchanged.select(sample, turn, *[F.col(m).alias(f"cogmap_fb_unchanged_per_turn_{m}") for m in METRICS]), turn, 0))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sample_maps(logs: DataFrame, stable: DataFrame, sample: str = "sample", turn: str = "turn", stable_turn: str | None = None, kind: str = "active",
                mapped: Column | None = None, belief: DataFrame | None = None, unchanged: DataFrame | None = None) -> DataFrame:
    """All map metrics of each sample: a ``sample`` row with :func:`sample_means` and, if there is
    one, its row of ``belief`` (:func:`belief_means`), then the rows of :func:`sample_series`.

    Of a passive sample only the correctness counts. ``stable`` is staged, as both parts need it.
    """
    if kind not in ("active", "passive"):
        raise ValueError(f"unknown exploration kind: {kind}")
    stable = stage(stable) if kind == "active" else stable
    means = sample_means(logs, stable, sample, turn, mapped)
    head = [F.lit("sample").alias("part"), F.lit(None).cast("int").alias("position")]
    if kind == "passive":
        return means.select(sample, *head, *[f"correctness_{m}" for m in METRICS])
    if belief is not None:
        means = null_safe(means, belief, [sample], "left")
    whole = means.select(sample, *head, *[c for c in means.columns if c != sample])
    return whole.unionByName(sample_series(logs, stable, sample, turn, stable_turn, mapped, unchanged), allowMissingColumns=True)


def group_maps(samples: DataFrame, kind: str, *by: str) -> DataFrame:
    """Means over samples with the number of samples that have each part."""
    if kind not in ("active", "passive"):
        raise ValueError(f"unknown exploration kind: {kind}")
    keep = [c for c, t in samples.dtypes if t == "double" and (kind == "active" or c.startswith("correctness_"))]
    counts = {"n_full": "correctness_overall"} if kind == "passive" else {
        "n_global": "global_error_overall", "n_local": "local_error_overall", "n_newly": "newly_error_overall", "n_probe": "probe_f1"}
    return samples.groupBy(*by).agg(*[F.avg(c).alias(c) for c in keep], *[F.count(c).alias(n) for n, c in counts.items()])


def cell_scores(predicted: Column, correct: Column) -> Column:
    """Set precision, recall, F1 of predicted cells. No truth is an error; no prediction scores 0."""
    p, c = F.array_distinct(predicted), F.array_distinct(correct)
    hit = F.size(F.array_intersect(p, c)).cast("double")
    precision = F.when(F.size(p) > 0, hit / F.size(p)).otherwise(0.0)
    recall = F.when(F.size(p) > 0, hit / F.size(c)).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    checked = F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.raise_error(F.lit("no correct cells")).cast("double")).otherwise(precision)
    return F.struct(checked.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def chosen_cells(labels: Column, candidates: Column) -> Column:
    """Cells named by letters: A is the first candidate, unknown letters are ignored."""
    place = lambda s: (F.ascii(F.upper(s)) - 64).cast("int")
    return F.filter(F.transform(labels, lambda s: F.when(place(s) >= 1, F.try_element_at(candidates, place(s)))), lambda c: c.isNotNull())


def nearest_explored(points: Column, explored: Column) -> Column:
    """Distance of each point to its nearest explored cell; infinite if nothing is explored."""
    def best(p: Column) -> Column:
        gaps = F.transform(explored, lambda e: G.distance(p["x"] - e["x"], p["y"] - e["y"]))
        return F.coalesce(F.array_min(gaps), F.lit(float("inf")))
    return F.transform(points, best)


def probe_summary(logs: DataFrame, sample: str = "sample") -> DataFrame:
    """Micro precision, recall, F1 over turns, and how distance goes with being found.

    Every correct cell with a known distance, and not an infinite one, counts as one
    observation; both sides sit in the row, so cells are looked up in place and only moments leave it.
    """
    p, c = F.array_distinct("predicted"), F.array_distinct("correct")
    tp = F.size(F.array_intersect(p, c))
    at = lambda cell: F.array_position(F.col("candidates"), cell).cast("int")
    known = F.filter(F.transform(c, lambda cell: F.struct(
        F.when(at(cell) > 0, F.try_element_at(F.col("distances"), at(cell))).alias("d"),
        F.when(F.array_contains(p, cell), 1.0).otherwise(0.0).alias("h"))), lambda z: F.abs(z["d"]) < float("inf"))
    rows = logs.filter(F.size("correct") > 0).select(sample, tp.alias("tp"), (F.size(p) - tp).alias("fp"), (F.size(c) - tp).alias("fn"), known.alias("k"))
    rows = rows.select(sample, "tp", "fp", "fn", F.size("k").alias("n"), *[
        _sum(F.col("k"), f).alias(name) for name, f in (
            ("d", lambda z: z["d"]), ("h", lambda z: z["h"]), ("dd", lambda z: z["d"] * z["d"]), ("dh", lambda z: z["d"] * z["h"]))])
    s = rows.groupBy(sample).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n", "d", "h", "dd", "dh")])
    precision = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    any_ = F.col("tp") + F.col("fp") + F.col("fn") > 0
    # h is 0 or 1, so its square sums to itself.
    vd = F.col("n") * F.col("dd") - F.col("d") * F.col("d")
    vh = F.col("n") * F.col("h") - F.col("h") * F.col("h")
    corr = F.when((F.col("n") >= 2) & (vd > 1e-9) & (vh > 0), (F.col("n") * F.col("dh") - F.col("d") * F.col("h")) / F.sqrt(vd * vh))
    return s.select(sample, F.when(any_, precision).alias("precision"), F.when(any_, recall).alias("recall"),
                    F.when(any_, F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)).alias("f1"),
                    corr.alias("distance_hit_corr"))


def _plain(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def _entries(turns: DataFrame, scores: str, *keep: str) -> DataFrame:
    """A map's entries as rows. A plain explode would be given a filter that works out the map once more."""
    return turns.select(*keep, F.explode_outer(scores).alias("_name", "_s")).filter("_name IS NOT NULL")


def changed_scores(turns: DataFrame, scores: str, sample: str = "sample", prefix: str = "changed") -> DataFrame:
    """Mean position and facing score over the objects that changed in that way.

    ``scores`` is a map of object name to ``struct<pos, facing>``, ``changes`` an array of
    ``struct<name, pos, ori>`` of the same turn; names match with ``_`` read as a blank.
    """
    def changed(kind: str) -> Column:
        return F.transform(F.filter("changes", lambda c: F.coalesce(c[kind], F.lit(False))), lambda c: _plain(c["name"]))
    # The changed names are worked out once a turn, not once more for each of its objects.
    rows = turns.select(sample, changed("pos").alias("_moved"), changed("ori").alias("_turned"), F.col(scores).alias("_scores"))
    long = _entries(rows, "_scores", sample, "_moved", "_turned")
    return long.groupBy(sample).agg(*[F.avg(F.when(F.array_contains(names, _plain(F.col("_name"))), F.col(f"_s.{m}"))).alias(f"{prefix}_{m}")
                                      for names, m in (("_moved", "pos"), ("_turned", "facing"))])


def unchanged_retention(turns: DataFrame, scores: str, sample: str = "sample") -> DataFrame:
    long = _entries(turns, scores, sample)
    return long.groupBy(sample).agg(F.avg("_s.pos").alias("unchanged_pos"), F.avg("_s.facing").alias("unchanged_facing"))


def belief_revision(turns: DataFrame, sample: str = "sample") -> DataFrame:
    """Changed, retained and unchanged means, and how much less is retained than unchanged."""
    out = turns.select(sample).distinct()
    for scores in (changed_scores(turns, "changed_objects", sample, "changed"), changed_scores(turns, "retention", sample, "retention"),
                   unchanged_retention(turns, "unchanged_retention", sample)):
        out = null_safe(out, scores, [sample], "left")

    def drop(kind: str) -> Column:
        u, r = F.nullif(F.col(f"unchanged_{kind}"), F.lit(0.0)), F.col(f"retention_{kind}")
        return 1 - (r / u) * (r / u)
    return out.withColumn("revision_pos", drop("pos")).withColumn("revision_facing", drop("facing"))


def inertia(objects: DataFrame, unchanged: DataFrame, sample: str = "sample") -> DataFrame:
    """Cosine of old and new error, weighted by how little the object moved.

    ``objects`` has old, new and true positions; ``unchanged`` squared distances of the
    unchanged objects, whose root mean square sets the scale (1 without any).
    """
    sigma = unchanged.groupBy(sample).agg(F.sqrt(F.avg("dist_sq")).alias("_s"))
    vx, vy = F.col("old_x") - F.col("true_x"), F.col("old_y") - F.col("true_y")
    ex, ey = F.col("new_x") - F.col("true_x"), F.col("new_y") - F.col("true_y")
    v, e = F.sqrt(vx * vx + vy * vy), F.sqrt(ex * ex + ey * ey)
    mx, my = F.col("new_x") - F.col("old_x"), F.col("new_y") - F.col("old_y")
    s = F.coalesce("_s", F.lit(1.0))
    weight = F.when(s > 1e-9, F.exp(-(mx * mx + my * my) / (2 * s * s + 1e-9))).otherwise(1.0)
    value = F.when((v >= 1e-9) & (e >= 1e-9), (ex * vx + ey * vy) / (e * v + 1e-9) * weight)
    return objects.join(sigma, sample, "left").groupBy(sample).agg(F.avg(value).alias("inertia"))


def unchanged_per_turn(turns: DataFrame, initial: DataFrame, sample: str, turn: str) -> DataFrame:
    """The unchanged objects' metrics per belief turn, with the last exploration map as turn 0."""
    cols = [sample, turn, *METRICS]
    return initial.withColumn(turn, F.lit(0).cast(turns.schema[turn].dataType)).select(*cols).unionByName(turns.select(*cols))


def belief_means(turns: DataFrame, objects: DataFrame, distances: DataFrame, unchanged: DataFrame, initial: DataFrame, sample: str = "sample") -> DataFrame:
    """All false-belief metrics of each sample with such turns, as ``fb_`` columns.

    :func:`belief_revision` of ``turns``, :func:`inertia` of ``objects`` and ``distances``, and the
    unchanged objects' metrics: their mean over the turns and those of the last exploration map.
    """
    out = belief_revision(turns, sample)
    out = out.select(sample, *[F.col(c).alias("fb_" + c.replace("unchanged_", "unchanged_retention_")) for c in out.columns if c != sample])
    for more in (inertia(objects, distances, sample).withColumnRenamed("inertia", "fb_inertia"),
                 unchanged.groupBy(sample).agg(*[F.avg(m).alias(f"fb_unchanged_{m}") for m in METRICS]),
                 initial.select(sample, *[F.col(m).alias(f"fb_unchanged_exploration_{m}") for m in METRICS])):
        out = null_safe(out, more, [sample], "left")
    return out


def map_reward(dir_: Column, facing: Column, pos: Column, coverage: Column, forced: Column) -> Column:
    """Map score above guessing plus coverage, scaled; a forced stop costs. Invalid counts as 0."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    score = (F.greatest(F.lit(0.0), unit(dir_) - DIR_BASELINE) + F.greatest(F.lit(0.0), unit(facing) - FACING_BASELINE)
             + unit(pos) + F.coalesce(coverage, F.lit(0.0))) / 4.0
    reward = score * REWARD_SCALE - F.when(F.coalesce(forced, F.lit(False)), FORCED_PENALTY).otherwise(0.0)
    return F.struct(score.alias("score"), reward.alias("reward"))


def navigation_tasks(scenes: DataFrame, per_scene: int, min_distance: float = 2.0, away: bool = False, seed: int = 0) -> DataFrame:
    """Up to ``per_scene`` (target, start) choices of each scene, at least ``min_distance`` apart.

    A scene row carries its ``objects`` (``id, x, z, usable, parents``), the ids of
    ``closed`` containers and its ``positions``. Targets inside a closed container are left
    out. Choices are ranked by a repeatable hash inside the row.
    """
    visible = F.filter("objects", lambda o: o["usable"] & ~F.arrays_overlap(F.coalesce(o["parents"], F.array().cast("array<string>")), F.col("closed")))

    def starts(o: Column) -> Column:
        far = F.filter("positions", lambda p: G.distance(p["x"] - o["x"], p["z"] - o["z"]) >= min_distance)

        def task(p: Column) -> Column:
            draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("scene").cast("string"), o["id"], p["x"].cast("string"), p["z"].cast("string")))
            turn = G.away_heading(o["x"] - p["x"], o["z"] - p["z"]) if away else (F.conv(F.substring(draw, 1, 4), 16, 10).cast("int") % 4) * 90.0
            return F.struct(draw.alias("draw"), o["id"].alias("target"), p["x"].alias("start_x"), p["z"].alias("start_z"), turn.alias("rotation"))
        return F.transform(far, task)
    ranked = F.slice(F.array_sort(F.flatten(F.transform(visible, starts))), 1, per_scene)
    return scenes.select("scene", F.inline(ranked)).drop("draw")


def object_pairs(maps: DataFrame, objects: str, *keep: str) -> DataFrame:
    """Every unordered pair of a layout's objects as a row: names, offset and distance.

    Pairs are made inside the row of their layout, so nothing is joined; there are as many as
    half the square of its objects, which a room bounds.
    """
    def with_later(a: Column, i: Column) -> Column:
        return F.transform(F.slice(objects, i + 2, F.size(objects)), lambda b: F.struct(
            a["name"].alias("first"), b["name"].alias("second"), (a["x"] - b["x"]).cast("double").alias("dx"), (a["y"] - b["y"]).cast("double").alias("dy")))
    pairs = maps.select(*keep, F.inline(F.flatten(F.transform(objects, with_later))))
    return pairs.withColumn("distance", G.distance(F.col("dx"), F.col("dy")))
