"""Configs, task expansion and partition contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollframe.distributed import row_numbers
from rollframe.operators.episodes import ABLATIONS
from rollframe.operators.trajectories import issues

# Names that configs may use.
ESTIMATORS = ["gae", "gpg", "grpo", "grpo_passk", "grpo_vectorized", "no_concat_episode_grpo", "no_concat_gae",
              "no_concat_gae_last", "opo", "reinforce_plus_plus", "reinforce_plus_plus_baseline", "remax", "rloo",
              "rloo_vectorized"]
CRITIC_ESTIMATORS = ["gae", "no_concat_gae", "no_concat_gae_last"]
GROUP_ESTIMATORS = ["grpo", "grpo_passk", "grpo_vectorized", "no_concat_episode_grpo", "opo", "rloo", "rloo_vectorized"]
STRATEGIES = ["fsdp", "fsdp2", "megatron"]
REWARD_MODES = ["outcome", "bounded_process", "format_gate", "custom"]
BACKENDS = ["sglang", "vllm", "openai", "hf"]
MATRIX_METHODS = ["base", "concat_grpo", "no_concat_gae", "no_concat_episode_grpo", "base_eval"]
MATRIX_ENVIRONMENTS = ["sokoban", "navigation", "frozenlake"]

TRAINING_SCHEMA = """struct<
  trainer: struct<n_gpus_per_node: double, nnodes: double, total_training_steps: double>,
  actor_rollout_ref: struct<model: struct<lora_rank: double>, actor: struct<strategy: string>,
    rollout: struct<n: double, load_format: string, layered_summon: boolean>>,
  algorithm: struct<adv_estimator: string, gamma: double, lam: double>,
  critic: struct<enable: boolean, strategy: string>, reward: struct<mode: string>,
  parity_gate: struct<enable: boolean, abort_ratio_p95: double>,
  logprob_parity: struct<enable: boolean, ratio_mean_threshold: double, ratio_p95_threshold: double>>"""
EVALUATION_SCHEMA = "struct<n_envs: double, environment: string, model_path: string, backend: string, observation_ablation: string>"


def _unknown(c: Column, allowed: list[str]) -> Column:
    return c.isNotNull() & ~c.isin(allowed)


def training_config_issues(configs: DataFrame, config: str = "config") -> DataFrame:
    """Problems of each training config, read from its JSON text."""
    c = F.col("_c")
    t, a, alg, critic = c["trainer"], c["actor_rollout_ref"], c["algorithm"], c["critic"]
    n = F.coalesce(a["rollout"]["n"], F.lit(1.0))
    est = alg["adv_estimator"]
    lora = F.coalesce(a["model"]["lora_rank"], F.lit(0.0)) > 0
    value_based = F.coalesce(est.isin(CRITIC_ESTIMATORS), F.lit(False))
    outside = lambda x, lo, hi: x.isNotNull() & ~x.between(lo, hi)
    rules = [
        (t.isNull(), "missing trainer"), (a.isNull(), "missing actor_rollout_ref"), (alg.isNull(), "missing algorithm"),
        (t.isNotNull() & (F.coalesce(t["n_gpus_per_node"], F.lit(0.0)) <= 0), "invalid n_gpus_per_node"),
        (t.isNotNull() & (F.coalesce(t["nnodes"], F.lit(1.0)) <= 0), "invalid nnodes"),
        (t["total_training_steps"] <= 0, "invalid total_training_steps"),
        (_unknown(a["actor"]["strategy"], STRATEGIES), "unknown actor strategy"),
        (a.isNotNull() & ((n <= 0) | (n != F.floor(n))), "invalid rollout.n"),
        (lora & ~a["rollout"]["load_format"].eqNullSafe("safetensors"), "adapter rollout needs load_format=safetensors"),
        (lora & ~a["rollout"]["layered_summon"].eqNullSafe(True), "adapter rollout needs layered_summon"),
        (alg.isNotNull() & est.isNull(), "missing adv_estimator"), (_unknown(est, ESTIMATORS), "unknown adv_estimator"),
        (value_based & outside(alg["gamma"], 0.0, 1.0), "invalid gamma"), (value_based & outside(alg["lam"], 0.0, 1.0), "invalid lambda"),
        (est.isin(GROUP_ESTIMATORS) & (n < 2), "group-relative estimator needs rollout.n >= 2"),
        (value_based & critic.isNull(), "estimator needs a critic"),
        (value_based & critic.isNotNull() & est.startswith("no_concat_") & ~critic["enable"].eqNullSafe(True), "estimator needs critic.enable"),
        (_unknown(critic["strategy"], STRATEGIES), "unknown critic strategy"),
        (_unknown(F.nullif(c["reward"]["mode"], F.lit("")), REWARD_MODES), "unknown reward mode"),
        (c["parity_gate"]["enable"] & (c["parity_gate"]["abort_ratio_p95"] < 1.0), "suspicious abort_ratio_p95"),
        (c["logprob_parity"]["enable"] & outside(F.coalesce(c["logprob_parity"]["ratio_mean_threshold"], F.lit(1.05)), 1.0, 2.0), "suspicious ratio_mean_threshold"),
        (c["logprob_parity"]["enable"] & outside(F.coalesce(c["logprob_parity"]["ratio_p95_threshold"], F.lit(1.2)), 1.0, 3.0), "suspicious ratio_p95_threshold")]
    return configs.withColumn("_c", F.from_json(config, TRAINING_SCHEMA)).withColumn("issues", issues(*rules)).drop("_c")


def evaluation_config_issues(configs: DataFrame, config: str = "config") -> DataFrame:
    c = F.col("_c")
    rules = [
        (c["n_envs"].isNull(), "missing n_envs"), (c["n_envs"] <= 0, "invalid n_envs"),
        (F.coalesce(c["environment"], F.lit("")) == "", "missing environment"),
        (F.coalesce(c["model_path"], F.lit("")) == "", "missing model_path"),
        (_unknown(c["backend"], BACKENDS), "unknown backend"), (_unknown(c["observation_ablation"], ABLATIONS), "unknown observation_ablation")]
    return configs.withColumn("_c", F.from_json(config, EVALUATION_SCHEMA)).withColumn("issues", issues(*rules)).drop("_c")


def matrix_method_issues(methods: DataFrame) -> DataFrame:
    """Rows ``method, advantage, concat_multi_turn, critic, rollout_n, train, eval_only`` of a matrix."""
    m, named = F.col("method"), F.col("method").isin(MATRIX_METHODS)
    trained = named & ~m.isin("base", "base_eval")
    required = ["advantage", "concat_multi_turn", "critic", "rollout_n"]
    missing = F.concat_ws(", ", *[F.when(F.col(k).isNull(), F.lit(k)) for k in sorted(required)])
    full = trained & (missing == "")
    rules = [
        (~named, F.concat(F.lit("unknown method "), m)),
        ((m == "base") & ~(F.col("train").eqNullSafe(False) & F.col("eval_only").eqNullSafe(True)), "base must not train"),
        (trained & (missing != ""), F.concat(F.lit("missing keys: "), missing)),
        (full & ~F.col("advantage").isin(ESTIMATORS), "unknown advantage"), (full & (F.col("rollout_n") <= 0), "rollout_n must be positive")]
    return methods.withColumn("issues", issues(*rules))


def matrix_environment_issues(environments: DataFrame) -> DataFrame:
    """Rows ``environment, train, validation, evaluation`` and their ``*_seeds`` arrays."""
    e, splits = F.col("environment"), ["train", "validation", "evaluation"]
    known = e.isin(MATRIX_ENVIRONMENTS)
    required = sorted([*splits, *[f"{s}_seeds" for s in splits]])
    missing = F.concat_ws(", ", *[F.when(F.col(k).isNull(), F.lit(k)) for k in required])
    rules = [(~known, F.concat(F.lit("unknown environment "), e)), (known & (missing != ""), F.concat(F.lit("missing keys: "), missing))]
    for s in splits:
        r = F.col(f"{s}_seeds")
        sized = F.size(r).isin(2, 3)
        step = F.coalesce(F.try_element_at(r, F.lit(3)), F.lit(1))
        rules += [(known & (F.trim(F.col(s)) == ""), f"{s} must be a path"), (known & r.isNotNull() & ~sized, f"{s}_seeds must be [start, stop(, step)]"),
                  (known & sized & ((F.get(r, 0) > F.get(r, 1)) | (step <= 0)), f"{s}_seeds has an invalid range")]
    return environments.withColumn("issues", issues(*rules))


def funnel_issues(stages: DataFrame, methods: list[str], environments: list[str]) -> DataFrame:
    """Rows ``stage, methods, environments, seeds`` (arrays) checked against the declared names."""
    lost = lambda c, names: F.array_except(F.coalesce(c, F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names]))
    m, e = lost(F.col("methods"), methods), lost(F.col("environments"), environments)
    return stages.withColumn("issues", issues(
        (F.size(m) > 0, F.concat(F.lit("unknown methods: "), F.concat_ws(", ", F.array_sort(m)))),
        (F.size(e) > 0, F.concat(F.lit("unknown environments: "), F.concat_ws(", ", F.array_sort(e)))),
        (F.size("seeds") == 0, "seeds must be a non-empty list")))


def _draw(*parts: Column) -> Column:
    """A repeatable number in [0, 2^31) from the parts."""
    word = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8)
    return F.conv(word, 16, 10).cast("long") % F.lit(2 ** 31)


def expand_tasks(specs: DataFrame, base_seed: int = 0, block: int = 10_000) -> DataFrame:
    """One row per task: (spec_idx, slot, task_seed).

    An explicit list is cut to ``n_envs``. ``[base]`` draws from the 31-bit range,
    ``[min, max]`` from the range with repeats, ``[min, max, limit]`` with at most ``limit``
    uses of a value. Slots are generated in blocks so that no array grows with ``n_envs``.
    """
    n, seed = F.col("n_envs").cast("long"), F.col("seed")
    size = F.size(seed)
    fail = lambda text: F.raise_error(F.concat(F.lit(text + " in spec "), F.col("spec_idx").cast("string"))).cast("boolean")
    listed = F.col("seed_list").isNotNull()
    bad = (F.when(listed & (F.size("seed_list") < n), fail("seed_list is too short"))
           .when(~listed & ~size.isin(1, 2, 3), fail("seed must have 1 to 3 items"))
           .when(~listed & (size >= 2) & (F.get(seed, 0) > F.get(seed, 1)), fail("empty seed range"))
           .when(~listed & (size == 3) & ((F.get(seed, 1) - F.get(seed, 0) + 1) * F.get(seed, 2) < n), fail("seed range cannot supply n_envs")))
    checked = specs.filter(bad.isNull())

    def numbered(df: DataFrame, total: Column, name: str) -> DataFrame:
        blocks = df.filter(total > 0).withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((total - 1) / block))))
        return blocks.withColumn(name, F.explode(F.sequence(
            F.col("_b") * block, F.least((F.col("_b") + 1) * block, total) - 1))).drop("_b")

    out = ["spec_idx", F.col("slot").cast("long").alias("slot"), F.col("task_seed").cast("long").alias("task_seed")]
    explicit = checked.filter(listed).select("spec_idx", n.alias("_n"), F.posexplode("seed_list").alias("slot", "task_seed")).filter("slot < _n")
    draw = _draw(F.lit(base_seed), F.col("spec_idx"), F.col("slot"))
    span = F.get(seed, 1).cast("long") - F.get(seed, 0) + 1
    free = numbered(checked.filter(~listed & (size < 3)), n, "slot").withColumn(
        "task_seed", F.when(size == 1, draw).otherwise(F.get(seed, 0) + draw % span))
    pool = numbered(checked.filter(~listed & (size == 3)), span * F.get("seed", 2), "_i")
    value = F.get("seed", 0) + F.floor(F.col("_i") / F.get("seed", 2))
    ranked = pool.select("spec_idx", n.alias("_n"), value.alias("task_seed"), "_i", _draw(F.lit(base_seed), F.col("spec_idx"), F.col("_i")).alias("_h"))
    limited = row_numbers(ranked, ["spec_idx"], ["_h", "_i"], "_r").filter("_r <= _n").withColumn("slot", F.col("_r") - 1)
    return explicit.select(*out).unionByName(free.select(*out)).unionByName(limited.select(*out))


def partition_issues(partitions: DataFrame) -> DataFrame:
    """Declared seed ranges against configs, per (environment, role)."""
    listed = F.col("seed_list").isNotNull()
    lo = F.when(listed, F.array_min("seed_list")).otherwise(F.get("seed", 0))
    hi = F.when(listed, F.array_max("seed_list")).otherwise(F.get("seed", 1))
    repeat = F.coalesce(F.try_element_at("seed", F.lit(3)), F.lit(0))
    count = F.when(listed, F.size("seed_list")).otherwise(hi - lo + 1)
    span = F.array(lo, hi)
    return partitions.withColumn("issues", issues(
        (listed & (F.size(F.array_distinct("seed_list")) != F.size("seed_list")), "seed_list repeats"),
        (listed & F.col("declared").isNotNull() & (F.col("declared") != span), "declared range does not span the seed_list"),
        (~listed & ~F.col("declared").eqNullSafe(span), "declared range differs from the config"),
        (~listed & F.col("role").isin("train", "validation") & (repeat != 1), "repeat must be 1"),
        (~listed & (F.col("role") == "evaluation") & ~repeat.isin(0, 1), "invalid evaluation repeat"),
        (~F.col("n_envs").eqNullSafe(count), "n_envs differs from the seed count")))


def expected_validation(specs: DataFrame, run: str = "run") -> DataFrame:
    """Sum of ``n_envs`` per run; a missing or non-positive count is an error."""
    bad = F.when(F.coalesce(F.col("n_envs"), F.lit(0)) <= 0, F.raise_error(F.lit("n_envs must be positive")).cast("boolean"))
    return specs.filter(bad.isNull()).groupBy(run).agg(F.sum("n_envs").alias("validation_n_envs"))
