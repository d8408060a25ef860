"""Checkpoint choice, lineage of results, completeness of the result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollframe.distributed import first_rows, with_row
from rollframe.functions.inference import wilson
from rollframe.operators.trajectories import assign_ids, issues

# Fixed value: the artifact type an export must carry.
EXPORT_ARTIFACT = "fsdp_lora_checkpoint_export"


def candidate_issues(candidates: DataFrame) -> DataFrame:
    """A candidate is eligible if complete, measured and saved."""
    rules = issues(
        (F.col("actual") != F.col("expected"), F.concat(F.lit("expected "), F.col("expected"), F.lit(" trajectories, found "), F.col("actual"))),
        (F.col("success_rate").isNull(), "success_rate is missing"),
        (~F.coalesce(F.col("saved"), F.lit(False)), "saved checkpoint is missing"))
    return candidates.withColumn("issues", rules).withColumn("eligible", F.size("issues") == 0)


def select_checkpoint(candidates: DataFrame, run: str = "run", strict: bool = False) -> DataFrame:
    """Per run: highest success, then fewest turns (unknown is worst), then latest step."""
    key = F.struct("success_rate", -F.coalesce(F.col("mean_turns"), F.lit(float("inf"))), "step")
    best = candidate_issues(candidates).groupBy(run).agg(
        F.count("*").alias("candidates"), F.count_if("eligible").alias("eligible"),
        F.max_by(F.when(F.col("eligible"), F.struct("step", "success_rate", "mean_turns")), F.when(F.col("eligible"), key)).alias("s"))
    if strict:
        none = F.when(F.col("eligible") == 0, F.raise_error(F.concat(F.lit("no eligible checkpoint in "), F.col(run))).cast("boolean"))
        best = best.filter(none.isNull())
    return best.select(run, "candidates", F.col("eligible").alias("eligible_candidates"), "s.*")


def seed_set_report(actual: DataFrame, declared: DataFrame, run: str = "run", **sums: Column) -> DataFrame:
    """Per run: are the episode seeds unique and equal to the declared set?

    Both sides arrive in long form and are counted together, once per (run, seed) and once per
    run. ``sums`` are added up over the episodes on the way. A null seed is a seed.
    """
    rows = actual.select(run, "seed", F.lit(1).alias("_a"), F.lit(0).alias("_d"), *[c.alias(n) for n, c in sums.items()]).unionByName(
        declared.select(run, "seed", F.lit(0).alias("_a"), F.lit(1).alias("_d")), allowMissingColumns=True)
    per = rows.groupBy(run, "seed").agg(*[F.sum(c).alias(c) for c in ("_a", "_d", *sums)])
    both = per.groupBy(run).agg(
        F.sum("_a").alias("episodes"), F.count_if(F.col("_d") > 0).alias("declared_seeds"), *[F.sum(c).alias(c) for c in sums],
        F.bool_or(F.col("_a") > 1).alias("_dup"), F.bool_or(F.col("_d") > 1).alias("_bad"),
        F.bool_or((F.col("_a") == 0) | (F.col("_d") == 0)).alias("_diff"))
    return both.withColumn("issues", issues(
        (F.col("_dup"), "episode seeds are not unique"),
        ((F.col("declared_seeds") == 0) | F.col("_bad"), "no valid frozen seed set"),
        ((F.col("declared_seeds") > 0) & ~F.col("_bad") & F.col("_diff"), "episode seeds do not match the frozen set"))
    ).drop("_dup", "_bad", "_diff")


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def final_records(evaluations: DataFrame, exports: DataFrame, trainings: DataFrame, seeds: DataFrame) -> DataFrame:
    """One record per final-test run with every break in its lineage.

    ``evaluations`` carry ``source_*`` columns; ``exports`` are keyed by ``export``,
    ``trainings`` by ``run``; ``seeds`` comes from :func:`seed_set_report`, with successes and
    turn sums per run. All joins are many-to-one.
    """
    x = exports.select("export", *[F.col(c).alias(f"x_{c}") for c in exports.columns if c != "export"])
    t = trainings.select(F.col("run").alias("t_run"), *[F.col(c).alias(f"t_{c}") for c in trainings.columns if c != "run"])
    s = seeds.select(F.col("run").alias("s_run"), "episodes", "successes", "turn_sum", F.col("issues").alias("s_issues"))
    e = (evaluations.join(x, evaluations.source_export_manifest == x.export, "left")
         .join(t, evaluations.source_run_dir == t.t_run, "left")
         .join(s, evaluations.run == s.s_run, "left")
         .withColumn("episodes", F.coalesce("episodes", F.lit(0))))
    present, trained = F.col("export").isNotNull(), F.col("t_run").isNotNull()
    required = ["source_run_dir", "source_selection_manifest", "source_export_manifest", "source_method",
                "source_train_seed", "source_checkpoint_step"]
    rules = [(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"manifest is missing {c}") for c in required]
    rules.append((~F.coalesce("source_environment", "environment").eqNullSafe(F.col("environment")), "source and evaluation environments differ"))
    rules.append((F.col("source_export_manifest").isNotNull() & ~present, "export manifest is unreadable"))
    rules += [(present & broken, text) for broken, text in (
        (~F.col("x_artifact_type").eqNullSafe(F.lit(EXPORT_ARTIFACT)), "export has the wrong artifact type"),
        (~F.col("x_status").eqNullSafe(F.lit("complete")), "export is not complete"),
        (_differs("x_model_path", "model"), "evaluated model does not match exported model"),
        (_differs("environment", "x_environment"), "evaluation/export mismatch for environment"),
        (_differs("source_method", "x_method"), "evaluation/export mismatch for source_method"),
        (_differs("source_train_seed", "x_train_seed"), "evaluation/export mismatch for source_train_seed"),
        (_differs("source_checkpoint_step", "x_checkpoint_step"), "evaluation/export mismatch for source_checkpoint_step"),
        (_differs("source_run_dir", "x_source_run_dir"), "evaluation/export mismatch for source_run_dir"))]
    rules.append((F.col("source_run_dir").isNotNull() & ~trained, "training run is unreadable"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    rules += [(trained & broken, text) for broken, text in (
        (_differs("source_method", "t_method"), "evaluation/training mismatch for source_method"),
        (_differs("source_train_seed", "t_seed"), "evaluation/training mismatch for source_train_seed"),
        (_differs("source_environment", "t_environment"), "evaluation/training mismatch for source_environment"),
        (F.col("t_concat_multi_turn").isNull(), "training manifest does not record concat_multi_turn"),
        (F.col("t_concat_multi_turn") != F.coalesce("concat_multi_turn", F.lit(False)), "context protocol does not match training"),
        (~F.col("t_status").eqNullSafe(F.lit("complete")), "source training run is not complete"),
        (~F.col("t_gate_passed").eqNullSafe(F.lit(True)), "source parity gate did not pass"),
        (~finite("t_ratio_p95"), "source parity metric ratio_p95 is missing or invalid"),
        (~finite("t_ratio_p99"), "source parity metric ratio_p99 is missing or invalid"),
        (~finite("t_mean_abs_logprob_delta"), "source parity metric mean_abs_logprob_delta is missing or invalid"))]
    rules += [(F.coalesce(F.col("n_envs"), F.lit(0)) <= 0, "manifest has invalid n_envs"),
              ((F.col("n_envs") > 0) & (F.col("episodes") != F.col("n_envs")), "episode count differs from n_envs")]
    found = F.concat(issues(*rules), F.coalesce("s_issues", F.array(F.lit("no valid frozen seed set"))))
    return e.withColumn("issues", found).select(
        "run", "environment", F.col("source_method").alias("method"), F.col("source_train_seed").alias("seed"),
        F.when((F.size("issues") > 0) & (F.col("status") == "complete"), "incomplete-artifacts").otherwise(F.col("status")).alias("status"),
        "episodes", F.coalesce("successes", F.lit(0)).alias("successes"), F.coalesce("turn_sum", F.lit(0)).alias("turn_sum"),
        F.col("t_peak_vram_mib").alias("peak_vram_mib"), F.col("t_gpu_hours").alias("gpu_hours"),
        F.col("t_ratio_p95").alias("ratio_p95"), F.col("t_ratio_p99").alias("ratio_p99"),
        F.col("t_mean_abs_logprob_delta").alias("mean_abs_logprob_delta"), F.col("t_gate_passed").alias("gate_passed"),
        F.when(F.coalesce("concat_multi_turn", F.lit(False)), "concat").otherwise("no-concat").alias("context_protocol"),
        F.col("issues"))


def final_aggregates(records: DataFrame, expected_seeds: list[int]) -> DataFrame:
    """Per environment and method; every number is null unless the group is complete."""
    seeds = sorted(set(expected_seeds))
    rate = F.when(F.col("episodes") > 0, F.col("successes") / F.col("episodes"))
    far = lambda c: F.max_by(c, F.abs(F.col(c) - 1.0))
    whole = lambda c: F.count(c) == F.count("*")
    g = records.groupBy("environment", "method").agg(
        F.countDistinct("seed").alias("n_seeds"), F.count("*").alias("_runs"),
        F.sum(F.when(F.coalesce(F.col("seed").isin(seeds), F.lit(False)), 0).otherwise(1)).alias("_odd"),
        F.count_if(F.col("status") != "complete").alias("_open"),
        F.sum("successes").alias("s"), F.sum("episodes").alias("n"), F.avg(rate).alias("macro"),
        F.coalesce(F.stddev_samp(rate), F.lit(0.0)).alias("std"), (F.sum("turn_sum") / F.nullif(F.sum("successes"), F.lit(0))).alias("turns"),
        F.when(whole("peak_vram_mib"), F.max("peak_vram_mib")).alias("vram"),
        F.when(whole("gpu_hours"), F.avg("gpu_hours")).alias("hours"), F.when(whole("gpu_hours"), F.sum("gpu_hours")).alias("hours_total"),
        F.when(whole("ratio_p95"), far("ratio_p95")).alias("p95"), F.when(whole("ratio_p99"), far("ratio_p99")).alias("p99"),
        F.when(whole("mean_abs_logprob_delta"), F.max("mean_abs_logprob_delta")).alias("delta"),
        F.every(F.coalesce("gate_passed", F.lit(False))).alias("gate"))
    found = issues(
        (F.col("_runs") != F.col("n_seeds"), "duplicate or missing training seed"),
        ((F.col("_odd") > 0) | (F.col("n_seeds") != len(seeds)), "training seeds differ from the expected set"),
        (F.col("_open") > 0, "incomplete final-test runs"))
    g = g.withColumn("issues", found).withColumn("_ok", F.size("issues") == 0)
    ok = lambda c: F.when(F.col("_ok"), c)
    ci = wilson(F.col("s"), F.col("n"))
    return g.select(
        "environment", "method", "n_seeds", ok(F.col("s") / F.nullif("n", F.lit(0))).alias("success"), ok(F.col("macro")).alias("success_macro_mean"),
        ok(F.col("std")).alias("success_seed_std"), ok(ci["low"]).alias("success_low"), ok(ci["high"]).alias("success_high"),
        ok(F.col("s")).alias("successes"), ok(F.col("n")).alias("episodes"), ok(F.col("turns")).alias("mean_turns"),
        ok(F.col("vram")).alias("peak_vram_mib"), ok(F.col("hours")).alias("gpu_hours"), ok(F.col("hours_total")).alias("gpu_hours_total"),
        ok(F.col("p95")).alias("ratio_p95"), ok(F.abs(F.col("p95") - 1)).alias("max_p95_deviation"), ok(F.col("p99")).alias("ratio_p99"),
        ok(F.abs(F.col("p99") - 1)).alias("max_p99_deviation"), ok(F.col("delta")).alias("mean_abs_logprob_delta"), ok(F.col("gate")).alias("gate_passed"),
        F.when(F.col("_ok"), "complete").otherwise("incomplete-artifacts").alias("status"), "issues")


def grid_report(aggregates: DataFrame, environments: list[str], methods: list[str]) -> DataFrame:
    """The declared environment x method grid against what is there: missing and unexpected groups."""
    spark = aggregates.sparkSession
    keys = spark.createDataFrame([(e, m) for e in environments for m in methods], "environment string, method string")
    joined = keys.withColumn("_want", F.lit(True)).join(
        aggregates.select("environment", "method", "status"), ["environment", "method"], "full_outer")
    return joined.select("environment", "method", F.coalesce("status", F.lit("incomplete-artifacts")).alias("status"),
                         F.when(F.col("status").isNull(), "missing").when(F.col("_want").isNull(), "unexpected")
                         .otherwise("present").alias("presence"))


def registry_complete(grid: DataFrame) -> DataFrame:
    ok = (F.col("presence") == "present") & (F.col("status") == "complete")
    return grid.agg(F.coalesce(F.every(ok), F.lit(False)).alias("registry_complete"))


def base_aggregate(episodes: DataFrame, *by: str) -> DataFrame:
    """The untrained model: success with interval, turns."""
    won = F.col("success")
    agg = episodes.groupBy(*by).agg(F.count("*").alias("episodes"), F.count_if(won).alias("successes"),
                                    F.avg(F.when(won, F.col("num_turns"))).alias("mean_turns"))
    ci = wilson(F.col("successes"), F.col("episodes"))
    return agg.select(*by, "episodes", "successes", (F.col("successes") / F.col("episodes")).alias("success"),
                      ci["low"].alias("success_low"), ci["high"].alias("success_high"), "mean_turns")


def fingerprint(content: Column) -> Column:
    """An 8-byte content digest as hex."""
    return F.substring(F.sha2(content, 256), 1, 16)


def select_disjoint(candidates: DataFrame, order: str, count: int, excluded: DataFrame | None = None) -> DataFrame:
    """The first ``count`` candidates in order whose fingerprint is new and not excluded.

    The same choice as examining candidates one by one: only the first holder of a
    fingerprint can be taken. Needs ``order`` unique. Too few is an error.
    """
    return _first_unseen(candidates, order, count, excluded).select(order, "fingerprint")


def _first_unseen(candidates: DataFrame, order: str, count: int, excluded: DataFrame | None) -> DataFrame:
    if count <= 0:
        raise ValueError("count must be positive")
    chosen = first_rows(candidates.select(order, "fingerprint"), order, count, "fingerprint", excluded)
    total = chosen.agg(F.count("*").alias("_n"))
    short = F.when(F.col("_n") < count, F.raise_error(F.concat(
        F.lit("not enough disjoint items: "), F.col("_n").cast("string"))).cast("boolean"))
    return with_row(chosen, total).filter(short.isNull())


def build_split(candidates: DataFrame, train: DataFrame, order: str, validation: int, test: int) -> DataFrame:
    """Train fingerprints stay; validation and then test take unseen ones.

    One selection serves both: test takes what follows validation among the unseen ones.
    """
    if validation <= 0 or test <= 0:
        raise ValueError("count must be positive")
    train = train.select(F.col(order), "fingerprint")
    held = _first_unseen(candidates, order, validation + test, train).select(
        order, "fingerprint", F.when(F.col("_pos") <= validation, "validation").otherwise("test").alias("split"))
    return train.withColumn("split", F.lit("train")).unionByName(held)


def split_problems(items: DataFrame, train_range: tuple[int, int], declared: dict[str, int] | None = None) -> DataFrame:
    """What is wrong with a split, one row per kind of problem, with a count.

    Everything is counted per fingerprint or seed first, so no pairs of items arise.
    """
    held = F.col("split") != "train"
    per = items.groupBy("fingerprint").agg(*[
        F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")])
    prints = per.agg(
        F.count_if(F.col("validation") > 1).alias("validation fingerprints repeat"),
        F.count_if(F.col("test") > 1).alias("test fingerprints repeat"),
        F.count_if((F.col("validation") > 0) & (F.col("train") > 0)).alias("validation fingerprints also in train"),
        F.count_if((F.col("test") > 0) & (F.col("train") > 0)).alias("test fingerprints also in train"),
        F.count_if((F.col("test") > 0) & (F.col("validation") > 0)).alias("test fingerprints also in validation"))
    seeds = items.filter(held).groupBy("seed").agg(F.countDistinct("split").alias("_s")).agg(
        F.count_if(F.col("_s") > 1).alias("validation and test share a seed"))
    inside = F.col("seed").between(*train_range)
    ranges = items.filter(held).agg(
        F.count_if(inside & (F.col("split") == "validation")).alias("validation seeds inside the train range"),
        F.count_if(inside & (F.col("split") == "test")).alias("test seeds inside the train range"),
        *[F.abs(F.countDistinct(F.when(F.col("split") == s, F.col("seed"))) - n).alias(f"{s} seed count does not match")
          for s, n in (declared or {}).items()])
    wide = with_row(with_row(prints, seeds), ranges)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("problem"), F.col(f"`{c}`").cast("long").alias("items")) for c in wide.columns])).alias("z")).select(
            "z.*").filter("items > 0")


def role_overlaps(identities: DataFrame, roles: list[str]) -> DataFrame:
    """Task identities (task_set, seed) that occur in two roles, per pair of roles."""
    per = identities.groupBy("environment", "task_set", "seed").agg(*[F.bool_or(F.col("role") == r).alias(r) for r in roles])
    pairs = [(a, b) for i, a in enumerate(roles) for b in roles[i + 1:]]
    hits = F.filter(F.array(*[F.struct(F.lit(a).alias("left_role"), F.lit(b).alias("right_role"),
                                       (F.col(a) & F.col(b)).alias("hit")) for a, b in pairs]), lambda p: p["hit"])
    return per.select("environment", F.explode(hits).alias("p")).groupBy("environment", "p.left_role", "p.right_role").agg(
        F.count("*").alias("identities"))


def align_tasks(turns: DataFrame, tasks: DataFrame, key: str = "uid") -> DataFrame:
    """Task fields for every generated row; a row without its task is an error."""
    known = tasks.withColumn("_known", F.lit(True))
    lost = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown uid "), F.col(key).cast("string"))).cast("boolean"))
    return turns.join(known, key, "left").filter(lost.isNull()).drop("_known")


def align_multiset(produced: DataFrame, requested: DataFrame, key: str, produced_order: str, requested_order: str) -> DataFrame:
    """Match the k-th produced row of each key with its k-th request; leftovers carry an issue."""
    a = assign_ids(produced.select(key, produced_order), key, [produced_order], "_k")
    b = assign_ids(requested.select(key, requested_order), key, [requested_order], "_k")
    both = a.join(b, [key, "_k"], "full_outer")
    return both.withColumnRenamed("_k", "position").withColumn("issues", issues(
        (F.col(produced_order).isNull(), "request without a trajectory"), (F.col(requested_order).isNull(), "trajectory without a request")))


def remaining_jobs(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs that are not finished yet. Defaults fill missing ablation and protocol; jobs
    without a full identity are never taken as done."""
    keys = ["env_name", "seed", "tag_id", "observation_ablation", "concat_multi_turn"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("observation_ablation", F.coalesce("observation_ablation", F.lit("none"))).withColumn(
            "concat_multi_turn", F.coalesce("concat_multi_turn", F.lit(True)))
    return keyed(jobs).join(keyed(done).select(*keys).distinct(), keys, "left_anti")


def manifest_difference(existing: DataFrame, requested: DataFrame, run: str = "run") -> DataFrame:
    """Keys whose values differ between two manifests (map columns), one row per key."""
    a = existing.select(run, F.explode("manifest").alias("key", "existing"))
    b = requested.select(run, F.explode("manifest").alias("key", "requested"))
    return a.join(b, [run, "key"], "full_outer").filter(~F.col("existing").eqNullSafe(F.col("requested")))


def unequal_multisets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose number of rows differs between the two sides."""
    x, y = a.groupBy(key).agg(F.count("*").alias("left_rows")), b.groupBy(key).agg(F.count("*").alias("right_rows"))
    return x.join(y, key, "full_outer").select(key, F.coalesce("left_rows", F.lit(0)).alias("left_rows"),
                                               F.coalesce("right_rows", F.lit(0)).alias("right_rows")).filter("left_rows <> right_rows")
