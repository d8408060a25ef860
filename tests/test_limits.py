"""Inputs beyond former limits, null keys, broken groups and the staging folder."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from rollframe import registry
from rollframe.distributed import affine_suffix, exact_quantiles, null_safe
from rollframe.functions.nested import average_documents, nested_values
from rollframe.functions.text import error_pattern
from rollframe.operators import credit, selection, trajectories
from rollframe.session import shared_dir, stage, staging


def suffixes(spark, rows):
    df = spark.createDataFrame(rows, "g string, i long, v double")
    return sorted(((r.g, r.i, r.suffix, r.after) for r in affine_suffix(df, ["g"], "i", F.col("v"), F.lit(1.0)).collect()), key=str)


def by_hand(rows):
    out = []
    for g in {r[0] for r in rows}:
        total = 0.0
        for _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: -math.inf if r[1] is None else r[1], reverse=True):
            out.append((g, i, total + v, total))
            total += v
    return sorted(out, key=str)


SHORT = [("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", -70, 2.0), ("b", 5, 3.0), (None, 1, 1.0), (None, 2, 5.0), ("c", None, 4.0), ("c", 7, 1.0), ("d", 64, 1.0)]


@pytest.mark.parametrize("long", [0, 70, 5000])
def test_recurrence_does_not_depend_on_other_rows(spark, long):
    rows = SHORT + [("long", i, 1.0) for i in range(long)] + [(None, 100 + i, 1.0) for i in range(long and 200)]
    assert suffixes(spark, rows) == by_hand(rows)


def test_repeated_index_fails(spark):
    for rows in ([("a", 1, 1.0)] * 100, [("a", None, 1.0)] * 2, [("a", i, 1.0) for i in range(200)] + [("b", 3, 1.0), ("b", 3, 2.0)]):
        with pytest.raises(Exception, match="repeated index"):
            suffixes(spark, rows)


def test_stated_index_range(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(100)], "g string, i long, v double")
    run = lambda top: affine_suffix(df, ["g"], "i", F.col("v"), F.lit(1.0), top)
    assert run(99).agg(F.max("suffix")).first()[0] == 100
    assert run(10**6).agg(F.max("suffix")).first()[0] == 100
    with pytest.raises(Exception, match="beyond max_index"):
        run(98).collect()


def test_many_candidates(spark):
    pool = spark.range(250_000).select("id", F.when(F.col("id") < 249_996, "same").otherwise(F.col("id").cast("string")).alias("fingerprint"))
    assert sorted(r.id for r in selection.select_disjoint(pool, "id", 5).collect()) == [0, 249_996, 249_997, 249_998, 249_999]


def test_long_error_lines_stay_apart(spark):
    base = "error " + "x" * 150
    df = spark.createDataFrame([(base + "a",), (base + "b",)], "line string")
    assert df.select(error_pattern(F.col("line")).alias("p")).distinct().count() == 2


def test_long_trajectory_is_one_row(spark):
    rows = [("g", 0, t, [t], [t], [1], [0.5], None, str(t)) for t in range(1, 151)]
    df = spark.createDataFrame(rows, "group_idx string, traj_idx int, turn_idx int, prompts array<int>, responses array<int>, response_mask array<int>, "
                                     "rm_scores array<double>, image_data array<string>, extra string")
    (one,) = trajectories.concat_segments(df).collect()
    assert one.turns == 150 and len(one.responses) == 299 and one.extra == "150"


def test_deep_documents(spark):
    for depth in (1, 10, 30):
        doc = json.loads('{"k": 1}')
        for i in range(depth - 1):
            doc = {"k": i, "in": doc} if i % 2 else [doc, {"k": 0.5}]
        text = json.dumps(doc)
        want = sorted(str(v) for v in _values(doc))
        rows = spark.createDataFrame([(1, text), (2, "{broken"), (3, None), (4, '"[[[{"')], "id long, doc string")
        assert sorted(r.value for r in nested_values(rows, ["id"], "doc", "k").collect()) == want
        assert average_documents(rows.filter("id = 1"), ["id"], "doc").agg(F.sum("n")).first()[0] == len(want)


def _values(doc):
    if isinstance(doc, list):
        return [v for x in doc for v in _values(x)]
    if isinstance(doc, dict):
        return [v for k, x in doc.items() for v in ([x] if k == "k" else []) + _values(x)]
    return []


def test_null_groups_stay(spark):
    scores = spark.createDataFrame([(None, 0, 1.0), (None, 1, 3.0), ("g", 0, 2.0)], "group_idx string, traj_idx int, trajectory_score double")
    got = {(r.group_idx, r.traj_idx): r.advantage for r in credit.group_advantages(scores).collect()}
    assert got == {(None, 0): -1.0, (None, 1): 1.0, ("g", 0): 0.0}
    turns = spark.createDataFrame([(None, 0, 1, 4), (None, 0, 2, 6), ("g", 0, 1, 5)], "group_idx string, traj_idx int, turn_idx int, tokens int")
    for mode in ("token", "turn", "trajectory"):
        weighted = credit.loss_weights(turns, mode)
        assert weighted.agg(F.sum(F.col("weight") * F.col("tokens"))).first()[0] == pytest.approx(1.0)
    assert credit.back_to_copies(turns, turns.withColumn("x", F.lit(1)), ["x"]).count() == 3
    assert trajectories.first_copy_mask(turns, "tokens").count() == 3
    assert exact_quantiles(turns, ["group_idx"], "tokens", {"p50": 0.5}).count() == 2
    assert null_safe(turns, turns.select("group_idx").distinct(), ["group_idx"]).count() == 3


def test_plain_centering_keeps_small_gaps(spark):
    scores = spark.createDataFrame([("g", 0, 0.0), ("g", 1, 1e-7)], "group_idx string, traj_idx int, trajectory_score double")
    assert {r.advantage for r in credit.group_advantages(scores, normalize=False).collect()} == {-5e-8, 5e-8}
    assert {round(r.advantage, 6) for r in credit.group_advantages(scores, min_std=0.0).collect()} == {-1.0, 1.0}


def test_whitening_of_large_values(spark):
    turns = spark.createDataFrame([(1e8, 1), (1e8 + 1, 1), (1e8 + 2, 1)], "advantage double, tokens int")
    got = sorted(r.whitened for r in credit.whiten(turns).collect())
    assert got == pytest.approx([-1.0, 0.0, 1.0], abs=1e-6)


TURN = "group_idx string, traj_idx int, turn_idx int, score double, value double, tokens int, last_turn boolean, traj_success boolean, copy int"


def rollouts():
    rows = [("g", t, i, 0.1 * t + i, 0.5, 2, i == 3, t == 1, 0) for t in range(3) for i in range(1, 4)]
    rows += [("h", t, i, 0.1, 0.5, 2, i == 2, t == 0, 0) for t in range(3) for i in range(1, 3) if (t, i) != (2, 1)]
    return rows + [("g", 0, 1, 1.0, 0.5, 2, False, False, 1)]


def test_broken_trajectory_voids_its_group(spark):
    turns = spark.createDataFrame(rollouts(), TURN)
    for broken in (turns, turns.filter("group_idx = 'g' OR traj_idx <> 1")):
        out = registry.estimators.get("no_concat_episode_grpo")(broken).collect()
        assert {r.group_idx for r in out} == {"g"} and len(out) == 10
    with pytest.raises(Exception, match="contiguous"):
        credit.episode_advantages(turns, ["score"], strict=True, reward="score", success="traj_success").collect()


@pytest.mark.parametrize("name", ["no_concat_gae", "no_concat_gae_last", "no_concat_episode_grpo", "grpo"])
def test_copies_get_one_advantage(spark, name):
    out = registry.estimators.get(name)(spark.createDataFrame(rollouts(), TURN)).filter("group_idx = 'g' AND traj_idx = 0 AND turn_idx = 1").collect()
    assert len(out) == 2 and out[0].advantage == out[1].advantage and out[0].copy != out[1].copy


def test_value_at_the_last_token(spark):
    turns = spark.createDataFrame([("g", 0, 1, 1.0, [0.25, 0.75], [1, 1])], "group_idx string, traj_idx int, turn_idx int, score double, values array<double>, response_mask array<int>")
    got = [registry.estimators.get(n)(turns, whiten=False).first().advantage for n in ("no_concat_gae", "no_concat_gae_last")]
    assert got == [0.75, 0.25]


def test_staging_folder(spark):
    root = shared_dir(spark).removeprefix("file://").removeprefix("file:") + "/rollframe-stage"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with staging(spark):
        df = stage(spark.range(5))
        assert df.count() == 5 and set(os.listdir(root)) > before
    assert set(os.listdir(root)) == before

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
