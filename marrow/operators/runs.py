"""Run tables: configurations, their scores and their costs, compared and rolled up.

A run is a row (context_window, approach, model, top_k, f1_macro, ..).  The unified order
of runs is (context_window, approach, model, top_k); where scores are equal, the first
row in that order wins.  Run tables are small next to item tables, yet every operator is
a plain aggregate, window by model, or equi join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions import LABELS, ratio

RUN = ["context_window", "approach", "model", "top_k"]
#: Display names and order of sizes; other names pass through.
SHORT_NAMES = {"model-3b": "3B", "model-8b": "8B", "model-14b": "14B", "model-32b": "32B", "vote-similarity": "vote"}
SIZES = {"model-3b": 3, "model-8b": 8, "model-14b": 14, "model-32b": 32}


def _order() -> list[Column]:
    return [F.col(c) for c in RUN]


def _map(values: dict, c: str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in values.items() for v in kv)), F.col(c))


def _best(df: DataFrame, by: list[str], value: str = "f1_macro") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(value), *_order())
    return df.where(F.col(value).isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def tag_context(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Context window from a folder name like items_ctx4096."""
    return df.withColumn("tag_context", F.try_to_number(F.nullif(F.regexp_extract(path_col, r"_ctx(\d+)", 1), F.lit("")), F.lit("999999999")).cast("long"))


def tag_runs(df: DataFrame, path_col: str = "path", rules: list[tuple[str, str]] | None = None, other: str | None = "unknown") -> DataFrame:
    """Approach by the first rule whose text is in the path; dataset is the first part, seed the second or unknown."""
    rules = rules or [("few_shot", "few_shot"), ("flawed", "fine_tune_flawed"), ("fixed", "fine_tune_fixed")]
    tag = F.lit(other).cast("string")
    for text, name in reversed(rules):
        tag = F.when(F.contains(F.col(path_col), F.lit(text)), name).otherwise(tag)
    parts = F.split(path_col, "/")
    return df.withColumn("tag_approach", tag).withColumn("tag_dataset", parts[0]).withColumn("tag_seed", F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("unknown")))


def concat_runs(dfs: list[DataFrame]) -> DataFrame:
    """Union of run tables; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def unify_runs(df: DataFrame) -> DataFrame:
    """Distinct rows with their ordinal in unified order; ordinals come from counts per context window, a handful of rows."""
    rows = df.dropDuplicates()
    sizes = rows.groupBy("context_window").agg(F.count("*").alias("n"))
    before = sizes.select("context_window", (F.sum("n").over(Window.orderBy("context_window")) - F.col("n")).alias("before"))
    w = Window.partitionBy("context_window").orderBy("approach", "model", "top_k", *[c for c in df.columns if c not in RUN])
    ranked = rows.withColumn("rn", F.row_number().over(w)).join(F.broadcast(before), "context_window")
    return ranked.withColumn("ordinal", F.col("before") + F.col("rn") - 1).drop("rn", "before")


def cost_rollup(preds: DataFrame, by: list[str] = RUN) -> DataFrame:
    p, g = "prompt_tokens", "generated_tokens"
    return preds.groupBy(*by).agg(F.count("*").alias("total_issues"), F.sum(p).alias("total_prompt_tokens"), F.round(F.avg(p), 6).alias("avg_prompt_tokens"), F.min(p).alias("min_prompt_tokens"), F.max(p).alias("max_prompt_tokens"), F.sum(g).alias("total_generated_tokens"), F.round(F.avg(g), 6).alias("avg_generated_tokens"))


def throughput(rollup: DataFrame, costs: DataFrame) -> DataFrame:
    return rollup.join(costs, RUN).withColumn("issues_per_second", F.round(ratio(F.col("total_issues"), F.col("wall_time_s")), 6))


def best_configs(runs: DataFrame) -> DataFrame:
    return _best(runs, ["model", "approach"]).select("model", "approach", "context_window", "top_k", "f1_macro", "invalid_rate")


def zero_shot_gain(runs: DataFrame, base_context: int = 2048) -> DataFrame:
    """Per model: zero-shot F1, best few-shot F1, gain; and the mean gain over models on every row."""
    few = runs.where(F.col("approach") == "few_shot")
    zero = few.where((F.col("top_k") == 0) & (F.col("context_window") == base_context)).select("model", F.col("f1_macro").alias("f1_zero"))
    best = _best(few.where("top_k > 0"), ["model"]).select("model", F.col("f1_macro").alias("f1_best"), "top_k", "context_window")
    j = zero.join(best, "model").withColumn("gain", F.round(F.col("f1_best") - F.col("f1_zero"), 4))
    return j.crossJoin(F.broadcast(j.agg(F.round(F.avg("gain"), 6).alias("mean_gain"))))


def heatmap(runs: DataFrame, contexts: list[int]) -> DataFrame:
    """(model, top_k) by context: mean F1, and how many cells of the model's best value the row holds."""
    few = runs.where(F.col("approach") == "few_shot")
    cells = few.groupBy("model", "top_k", "context_window").agg(F.avg("f1_macro").alias("f1"))
    cells = cells.withColumn("is_best", (F.abs(F.col("f1") - F.max("f1").over(Window.partitionBy("model"))) < 0.0001).cast("int"))
    pick = lambda c: F.max(F.when(F.col("context_window") == c, F.col("f1")))
    return cells.groupBy("model", "top_k").agg(*(F.round(pick(c), 4).alias(f"ctx_{c}") for c in contexts), F.sum("is_best").alias("n_best_cells"))


def invalid_heatmap(runs: DataFrame, ks: list[int], limit: float = 0.10) -> DataFrame:
    """(context_window, top_k): mean invalid rate over the models present, models at or above the limit."""
    few = runs.where((F.col("approach") == "few_shot") & F.col("top_k").isin(*ks))
    return few.groupBy("context_window", "top_k").agg(F.round(F.avg("invalid_rate"), 6).alias("mean_invalid_rate"), F.count(F.when(F.col("invalid_rate") >= limit, 1)).alias("n_flagged"), F.count("*").alias("n_models"))


def invalid_rollup(runs: DataFrame) -> DataFrame:
    """Mean invalid rate per model and over all models (model null)."""
    return runs.where(F.col("approach") == "few_shot").rollup("model").agg(F.round(F.avg("invalid_rate"), 6).alias("mean_invalid_rate"))


def _with_cost(rows: DataFrame, costs: DataFrame) -> DataFrame:
    """The first matching cost row, by the order of its figures."""
    w = Window.partitionBy(*RUN).orderBy("wall_time_s", "gpu_peak_memory_mb")
    one = costs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return rows.join(one, RUN, "left").withColumn("total_time_s", F.col("wall_time_s") + F.coalesce("training_time_s", F.lit(0.0)))


def cost_performance(runs: DataFrame, costs: DataFrame) -> DataFrame:
    """Costs at the best configuration, and memory as a share of the model's fine-tuned best."""
    best = _with_cost(best_configs(runs), costs)
    tuned = best.where(F.col("approach") == "fine_tune").select("model", F.col("gpu_peak_memory_mb").alias("tuned_mb"))
    return best.join(tuned, "model", "left").select("model", "approach", "context_window", "top_k", "f1_macro", "total_time_s", "gpu_peak_memory_mb", F.round(ratio(F.col("gpu_peak_memory_mb"), F.col("tuned_mb")), 6).alias("memory_share"))


def time_ratio(performance: DataFrame) -> DataFrame:
    few = performance.where(F.col("approach") == "few_shot").select("model", F.col("total_time_s").alias("few_s"))
    tuned = performance.where(F.col("approach") == "fine_tune").select("model", F.col("total_time_s").alias("tuned_s"))
    j = few.join(tuned, "model")
    return j.select("model", F.round(ratio(F.col("few_s"), F.col("tuned_s")), 6).alias("time_ratio"), (F.col("few_s") < F.col("tuned_s")).alias("is_faster"))


def marginal_value(runs: DataFrame) -> DataFrame:
    """Best few-shot F1 over the best vote F1: delta and percent."""
    floor = runs.where(F.col("approach") == "vote").agg(F.max("f1_macro").alias("f1_floor"))
    best = _best(runs.where(F.col("approach") == "few_shot"), ["model"]).select("model", "f1_macro")
    j = best.crossJoin(F.broadcast(floor))
    d = F.col("f1_macro") - F.col("f1_floor")
    return j.select("model", "f1_macro", "f1_floor", F.round(d, 4).alias("delta"), F.round(ratio(d, F.col("f1_floor")) * 100, 4).alias("delta_pct"))


def scaling_steps(runs: DataFrame) -> DataFrame:
    """Best F1 by model size per approach: gain over the next smaller model, and whether few-shot beats fine-tune."""
    best = _best(runs.where(F.col("approach").isin("few_shot", "fine_tune")), ["model", "approach"]).withColumn("size", _map(SIZES, "model"))
    step = F.col("f1_macro") - F.lag("f1_macro").over(Window.partitionBy("approach").orderBy("size"))
    s = best.withColumn("step_gain", F.round(step, 4))
    other = F.max(F.when(F.col("approach") == "fine_tune", F.col("f1_macro"))).over(Window.partitionBy("model"))
    return s.withColumn("vs_tuned", F.when(F.col("f1_macro") > other, "beats").when(F.col("f1_macro") < other, "trails").otherwise("equals")).select("model", "approach", "size", "f1_macro", "step_gain", "vs_tuned")


def best_k_by_context(runs: DataFrame) -> DataFrame:
    return _best(runs.where((F.col("approach") == "few_shot") & (F.col("top_k") > 0)), ["model", "context_window"]).select("model", "context_window", "approach", "top_k", "f1_macro")


def best_by_context(runs: DataFrame) -> DataFrame:
    """Per model: best and worst context at its best k, and the spread; the smaller context wins ties."""
    b = best_k_by_context(runs)
    return b.groupBy("model").agg(
        F.max_by("context_window", F.struct("f1_macro", -F.col("context_window"))).alias("best_context"),
        F.min_by("context_window", F.struct("f1_macro", "context_window")).alias("worst_context"),
        F.round(F.max("f1_macro") - F.min("f1_macro"), 4).alias("spread"),
    )


def delta_by_context(runs: DataFrame) -> DataFrame:
    """Best few-shot F1 at each context minus the model's best fine-tuned F1."""
    tuned = runs.where(F.col("approach") == "fine_tune").groupBy("model").agg(F.max("f1_macro").alias("tuned"))
    return best_k_by_context(runs).join(tuned, "model").select("model", "context_window", "top_k", F.round(F.col("f1_macro") - F.col("tuned"), 4).alias("delta"))


def cost_by_context(runs: DataFrame, costs: DataFrame) -> DataFrame:
    return _with_cost(best_k_by_context(runs), costs).select("model", "context_window", "top_k", "f1_macro", "wall_time_s", "gpu_peak_memory_mb")


def marginal_returns(runs: DataFrame, costs: DataFrame, least: int = 3) -> DataFrame:
    """Changes of F1, memory and time from one context to the next, of models with ``least`` contexts."""
    c = cost_by_context(runs, costs)
    w = Window.partitionBy("model")
    o = w.orderBy("context_window")
    d = lambda x, n: F.round(F.col(x) - F.lag(x).over(o), n)
    s = c.withColumn("n", F.count("*").over(w)).withColumn("from_context", F.lag("context_window").over(o))
    s = s.select("model", "from_context", "context_window", d("f1_macro", 4).alias("d_f1"), d("gpu_peak_memory_mb", 4).alias("d_memory_mb"), d("wall_time_s", 4).alias("d_time_s"), "n")
    return s.where((F.col("n") >= least) & F.col("from_context").isNotNull()).drop("n")


def time_by_context(runs: DataFrame, costs: DataFrame) -> DataFrame:
    tuned = cost_performance(runs, costs).where(F.col("approach") == "fine_tune").select("model", F.col("total_time_s").alias("tuned_s"))
    r = ratio(F.col("wall_time_s"), F.col("tuned_s"))
    return cost_by_context(runs, costs).join(tuned, "model").select("model", "context_window", F.round(r, 6).alias("time_ratio"), (r <= 1.0).alias("within"))


def summary_configs(runs: DataFrame) -> DataFrame:
    """Configurations to carry forward: the best of each approach per model, and the best run of all."""
    best = best_configs(runs).select(F.lit("by_model").alias("kind"), "model", "approach", "context_window", "top_k", "f1_macro")
    top = _best(runs.withColumn("everything", F.lit(1)), ["everything"]).select(F.lit("overall").alias("kind"), "model", "approach", "context_window", "top_k", "f1_macro")
    return best.unionByName(top)


def pareto(runs: DataFrame, costs: DataFrame) -> DataFrame:
    """Runs that no other beats in both F1 and memory (equal memory: the higher F1 first).

    The best F1 of each memory value is taken first, so the running maximum is one task over
    distinct memory values (megabytes of a device, some ten thousand at most), not over runs.
    """
    r = _with_cost(runs, costs).where("gpu_peak_memory_mb is not null and f1_macro is not null")
    w = Window.partitionBy("gpu_peak_memory_mb").orderBy(F.desc("f1_macro"), *_order())
    top = r.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    before = F.max("f1_macro").over(Window.orderBy("gpu_peak_memory_mb").rowsBetween(Window.unboundedPreceding, -1))
    return top.withColumn("before", before).where("before is null or f1_macro > before").select(*RUN, "f1_macro", "gpu_peak_memory_mb")


def seed_ablation(runs: DataFrame) -> DataFrame:
    """runs (arm, seed, f1_macro): mean and deviation per arm, and the mean less that of arm ``random``."""
    g = runs.groupBy("arm").agg(F.round(F.avg("f1_macro"), 6).alias("f1_mean"), F.round(F.stddev_samp("f1_macro"), 6).alias("f1_std"), F.count("*").alias("n_seeds"))
    base = g.where(F.col("arm") == "random").agg(F.max("f1_mean").alias("base"))
    return g.crossJoin(F.broadcast(base)).select("arm", "f1_mean", "f1_std", "n_seeds", F.round(F.col("f1_mean") - F.col("base"), 6).alias("over_random"))


def crossover(table: DataFrame) -> DataFrame:
    """(model, pool_size, approach, f1_macro) -> per model the first size from which fine-tune stays at or above few-shot."""
    p = table.groupBy("model", "pool_size").agg(F.max(F.when(F.col("approach") == "few_shot", F.col("f1_macro"))).alias("few"), F.max(F.when(F.col("approach") == "fine_tune", F.col("f1_macro"))).alias("tuned"))
    p = p.where("few is not null and tuned is not null")
    later = Window.partitionBy("model").orderBy(F.desc("pool_size"))
    p = p.withColumn("stays", F.min((F.col("tuned") >= F.col("few")).cast("int")).over(later))
    return p.groupBy("model").agg(F.min(F.when(F.col("stays") == 1, F.col("pool_size"))).alias("crossover_size"), F.count("*").alias("n_sizes"))


def sweep_winner(sweep: DataFrame) -> DataFrame:
    """(layer, multiplier, f1_macro) -> best layer at multiplier -1, then its best multiplier; first rows win ties."""
    first = Window.orderBy(F.desc("f1_macro"), "layer", "multiplier")
    layer = sweep.where("multiplier = -1").withColumn("rn", F.row_number().over(first)).where("rn = 1").select("layer")
    own = sweep.join(F.broadcast(layer), "layer").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return own.select("layer", "multiplier", "f1_macro")


def ablation_table(runs: DataFrame, arm_col: str, ks: list[int]) -> DataFrame:
    """One row per arm with F1 at each k and the best k (smallest on ties)."""
    return runs.groupBy(arm_col).agg(*(F.max(F.when(F.col("k") == k, F.col("f1_macro"))).alias(f"k_{k}") for k in ks), F.max_by("k", F.struct("f1_macro", -F.col("k"))).alias("best_k"), F.max("f1_macro").alias("best_f1"))


def dataset_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per class: F1 of score row b less that of a, and its share of the macro gap."""
    x = a.crossJoin(F.broadcast(b.select(*(F.col(f"f1_{v}").alias(f"b_{v}") for v in LABELS))))  # two rows of scores
    each = x.select(F.explode(F.array(*(F.struct(F.lit(v).alias("label"), F.col(f"f1_{v}").alias("f1_a"), F.col(f"b_{v}").alias("f1_b")) for v in LABELS))).alias("x")).select("x.*")
    d = each.withColumn("delta", F.round(F.col("f1_b") - F.col("f1_a"), 4))
    total = F.sum("delta").over(Window.partitionBy(F.lit(0)))
    return d.withColumn("gap_share", F.round(ratio(F.col("delta"), total), 4))


def short_names(df: DataFrame, col: str = "model") -> DataFrame:
    return df.withColumn("short_name", F.coalesce(_map(SHORT_NAMES, col), F.col(col)))


def timing_rollup(timing: DataFrame) -> DataFrame:
    """(stage, dataset, model, approach, seconds) -> seconds and rows per stage and approach."""
    return timing.groupBy("stage", "approach").agg(F.round(F.sum("seconds"), 4).alias("seconds"), F.count("*").alias("n"))


def compare_variants(scores: DataFrame, baseline: str) -> DataFrame:
    """(model, variant, f1_macro) of one convention: delta to the baseline, and the best variant of the model."""
    base = scores.where(F.col("variant") == baseline).select("model", F.col("f1_macro").alias("base"))
    best = scores.groupBy("model").agg(F.max_by("variant", F.struct("f1_macro", "variant")).alias("best_variant"))
    return scores.join(base, "model", "left").join(best, "model").select("model", "variant", "f1_macro", F.round(F.col("f1_macro") - F.col("base"), 4).alias("delta"), (F.col("variant") == F.col("best_variant")).alias("is_best"))


def k_study(runs: DataFrame, context: int) -> DataFrame:
    """F1 of each k at one context beside the fine-tuned row (top_k null)."""
    few = runs.where((F.col("approach") == "few_shot") & (F.col("context_window") == context)).select("model", "top_k", "f1_macro")
    tuned = runs.where((F.col("approach") == "fine_tune") & (F.col("context_window") == context)).select("model", F.lit(None).cast(runs.schema["top_k"].dataType).alias("top_k"), "f1_macro")
    return few.unionByName(tuned)
