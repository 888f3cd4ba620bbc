"""Error analysis: predictions (item_id, ground_truth, predicted_label) with neighbours (test_id, neighbor_rank, neighbor_label, similarity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions import LABELS, ratio


def label_mix(neighbors: DataFrame, k: int) -> DataFrame:
    """(item_id, c_bug, c_feature, c_question) of the first k neighbours."""
    return neighbors.where(F.col("neighbor_rank") < k).groupBy(F.col("test_id").alias("item_id")).agg(*(F.count(F.when(F.col("neighbor_label") == v, 1)).alias(f"c_{v}") for v in LABELS))


def _outcome(preds: DataFrame) -> DataFrame:
    return preds.withColumn("outcome", F.when(F.col("ground_truth") == F.col("predicted_label"), F.concat(F.lit("right_"), "ground_truth")).otherwise(F.concat("ground_truth", F.lit("_as_"), "predicted_label")))


def neighbor_mix(preds: DataFrame, mix: DataFrame) -> DataFrame:
    """Per outcome: mean and median neighbour count of each class."""
    j = _outcome(preds).join(mix, "item_id")
    return j.groupBy("outcome").agg(F.count("*").alias("n"), *(F.round(F.avg(f"c_{v}"), 6).alias(f"mean_{v}") for v in LABELS), *(F.percentile(f"c_{v}", F.lit(0.5)).cast("double").alias(f"median_{v}") for v in LABELS))


def neighbor_histogram(preds: DataFrame, mix: DataFrame, k: int) -> DataFrame:
    """Errors by number of neighbours with the true label, with percent; empty bins are there."""
    own = F.coalesce(*(F.when(F.col("ground_truth") == v, F.col(f"c_{v}")) for v in LABELS))
    e = preds.where("ground_truth <> predicted_label").join(mix, "item_id").groupBy(own.alias("n_same")).agg(F.count("*").alias("n_errors"))
    bins = preds.sparkSession.range(k + 1).withColumnRenamed("id", "n_same")
    h = bins.join(e, "n_same", "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))
    return h.withColumn("pct", F.round(ratio(F.col("n_errors"), F.sum("n_errors").over(Window.partitionBy(F.lit(0)))) * 100, 4))


def signal_ignored(preds: DataFrame, mix: DataFrame, by: tuple[str, ...] = ("ground_truth", "predicted_label")) -> DataFrame:
    """Share of errors whose neighbours had the true label at least as often as the predicted one."""
    count_of = lambda c: F.coalesce(*(F.when(F.col(c) == v, F.col(f"c_{v}")) for v in LABELS), F.lit(0))
    e = preds.where("ground_truth <> predicted_label").join(mix, "item_id")
    return e.groupBy(*by).agg(F.count("*").alias("n_errors"), F.round(F.avg((count_of("ground_truth") >= count_of("predicted_label")).cast("double")), 6).alias("ignored_rate"))


def contingency(pairs: DataFrame) -> DataFrame:
    """One row: both right, only a, only b (errors of a that b recovers), both wrong."""
    a, b = F.col("pred_a") == F.col("ground_truth"), F.col("pred_b") == F.col("ground_truth")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return pairs.agg(n(a & b, "both_right"), n(a & ~b, "only_a"), n(~a & b, "only_b"), n(~a & ~b, "both_wrong"))


def recall_delta(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Per model and class: recall of approach a less that of b (score rows by model and approach)."""
    pick = lambda s, p: scores.where(F.col("approach") == s).select("model", *(F.col(f"recall_{v}").alias(f"{p}_{v}") for v in LABELS))
    j = pick(a, "a").join(pick(b, "b"), "model")
    return j.select("model", F.explode(F.array(*(F.struct(F.lit(v).alias("label"), F.round(F.col(f"a_{v}") - F.col(f"b_{v}"), 4).alias("delta")) for v in LABELS))).alias("x")).select("model", "x.*")


def universal_errors(preds: DataFrame, model_col: str = "model") -> DataFrame:
    """Items that all models get wrong."""
    n = preds.agg(F.count_distinct(model_col).alias("n_models"))
    g = preds.groupBy("item_id", "ground_truth").agg(F.count_distinct(F.when(F.col("predicted_label") != F.col("ground_truth"), F.col(model_col))).alias("n_wrong"))
    return g.crossJoin(F.broadcast(n)).where("n_wrong = n_models").select("item_id", "ground_truth")


def error_by_similarity(preds: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Error rate by tenths of the best neighbour's similarity."""
    top = neighbors.where("neighbor_rank = 0").select(F.col("test_id").alias("item_id"), F.floor(F.col("similarity") * 10).cast("long").alias("band"))
    return preds.join(top, "item_id").groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg((F.col("ground_truth") != F.col("predicted_label")).cast("double")), 6).alias("error_rate"))


def error_samples(preds: DataFrame, mix: DataFrame, n: int) -> DataFrame:
    """The first n errors of each kind by item, with neighbour counts (a report, so the limit is the point)."""
    e = preds.where("ground_truth <> predicted_label").join(mix, "item_id")
    w = Window.partitionBy("ground_truth", "predicted_label").orderBy("item_id")
    return e.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("item_id", "ground_truth", "predicted_label", *(f"c_{v}" for v in LABELS))
