"""Score calibration and ensembles over class scores (item_id, ground_truth, label, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions import LABELS


def _argmax(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Best label per item; equal scores fall to the first class in fixed order."""
    order = F.array_position(F.array(*(F.lit(v) for v in LABELS)), F.col("label"))
    best = F.max_by("label", F.struct(F.col(score), -order))
    return df.groupBy(*by, "item_id", "ground_truth").agg(best.alias("predicted_label"))


def batch_calibrate(scores: DataFrame, by: list[str], score: str = "score", digits: int = 12) -> DataFrame:
    """Softmax per item, minus the batch mean of the class, plus 1/3, argmax."""
    item = Window.partitionBy(*by, "item_id")
    e = F.exp(F.col(score) - F.max(score).over(item))
    p = scores.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(item))
    means = p.groupBy(*by, "label").agg(F.avg("p").alias("mean"))
    c = p.join(F.broadcast(means), [*by, "label"]).withColumn("calibrated", F.round(F.col("p") - F.col("mean") + 1.0 / 3.0, digits))
    return _argmax(c, by, "calibrated")


def contrast_scores(a: DataFrame, b: DataFrame, alphas: list[float]) -> DataFrame:
    """(alpha, item, label, score): a - alpha b for each alpha."""
    j = a.select("item_id", "ground_truth", "label", F.col("score").alias("a")).join(b.select("item_id", "label", F.col("score").alias("b")), ["item_id", "label"])
    each = j.withColumn("alpha", F.explode(F.array(*(F.lit(float(x)) for x in alphas))))
    return each.select("alpha", "item_id", "ground_truth", "label", F.round(F.col("a") - F.col("alpha") * F.col("b"), 9).alias("score"))


def contrast(a: DataFrame, b: DataFrame, alphas: list[float]) -> DataFrame:
    return _argmax(contrast_scores(a, b, alphas), ["alpha"], "score")


def calibrated_contrast(a: DataFrame, b: DataFrame, alphas: list[float]) -> DataFrame:
    return batch_calibrate(contrast_scores(a, b, alphas), ["alpha"])


def override(pairs: DataFrame, margins: DataFrame, threshold: float, question_only: bool = False) -> DataFrame:
    """pred_a, but pred_b where they differ and b's margin is above the threshold (if asked, only to question)."""
    j = pairs.join(margins, "item_id")
    take = (F.col("pred_a") != F.col("pred_b")) & (F.col("margin") > threshold)
    if question_only:
        take = take & (F.col("pred_b") == "question")
    return j.select("item_id", "ground_truth", F.when(take, F.col("pred_b")).otherwise(F.col("pred_a")).alias("predicted_label"))


def pair_winner(pairs: DataFrame) -> DataFrame:
    """Per pair of disagreeing labels trust the classifier that is right more often (a on a tie)."""
    stats = pairs.where("pred_a <> pred_b").groupBy("pred_a", "pred_b").agg(F.count(F.when(F.col("pred_a") == F.col("ground_truth"), 1)).alias("ra"), F.count(F.when(F.col("pred_b") == F.col("ground_truth"), 1)).alias("rb"))
    j = pairs.join(F.broadcast(stats), ["pred_a", "pred_b"], "left")  # at most 16 rows of labels
    return j.select("item_id", "ground_truth", F.when(F.col("rb") > F.col("ra"), F.col("pred_b")).otherwise(F.col("pred_a")).alias("predicted_label"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Shares: both agree, either is right (the ceiling of any choice between them), each right."""
    avg = lambda c: F.round(F.avg(c.cast("double")), 6)
    a, b = F.col("pred_a") == F.col("ground_truth"), F.col("pred_b") == F.col("ground_truth")
    return pairs.agg(F.count("*").alias("n"), avg(F.col("pred_a") == F.col("pred_b")).alias("agreement"), avg(a | b).alias("oracle_accuracy"), avg(a).alias("accuracy_a"), avg(b).alias("accuracy_b"))


def oracle_labels(pairs: DataFrame) -> DataFrame:
    return pairs.select("item_id", "ground_truth", F.when(F.col("pred_b") == F.col("ground_truth"), F.col("pred_b")).otherwise(F.col("pred_a")).alias("predicted_label"))


def vote_prior(neighbors: DataFrame, k: int) -> DataFrame:
    """(test_id, prior): counts of neighbour labels as JSON."""
    n = lambda v: F.count(F.when(F.col("neighbor_label") == v, 1))
    g = neighbors.where(F.col("neighbor_rank") < k).groupBy("test_id").agg(*(n(v).alias(v) for v in LABELS))
    return g.select("test_id", F.to_json(F.struct(*LABELS)).alias("prior"))


def margin_of(neighbors: DataFrame, k: int) -> DataFrame:
    """(item_id, margin): votes of the most frequent label less those of the next."""
    n: list[Column] = [F.count(F.when(F.col("neighbor_label") == v, 1)) for v in LABELS]
    g = neighbors.where(F.col("neighbor_rank") < k).groupBy(F.col("test_id").alias("item_id")).agg(F.sort_array(F.array(*n), asc=False).alias("c"))
    return g.select("item_id", (F.col("c")[0] - F.col("c")[1]).alias("margin"))
