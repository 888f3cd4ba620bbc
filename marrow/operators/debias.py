"""Neighbour lists without an over-represented class (test_id, neighbor_rank, neighbor_label, ..)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions import fold_label

#: Words that count as either class here.
BUGS = ("bug", "bugfix", "defect", "issue", "fix")
QUESTIONS = ("question", "support", "howto", "help")


def debias(neighbors: DataFrame, k: int, margin: int = 3, mode: str = "margin", wide: int = 16, keys: tuple[str, ...] = ("test_id",)) -> DataFrame:
    """The first k neighbours of each query, changed by ``mode``; ranks stay, but for backfill.

    margin: if there are bugs, and at most ``margin`` more than questions, all bugs go (a
    list may become empty).  always: bugs go, the list is filled from the first ``wide``.
    replace: always, where the margin holds.  cap: the best-ranked bug stays, others go.
    """
    label = fold_label("neighbor_label")
    w = Window.partitionBy(*keys)
    own = neighbors.where(F.col("neighbor_rank") < max(k, wide if mode in ("always", "replace") else k))
    own = own.withColumn("is_bug", label.isin(*BUGS)).withColumn("is_question", label.isin(*QUESTIONS))
    inside = F.col("neighbor_rank") < k
    bugs, questions = F.count(F.when(inside & F.col("is_bug"), 1)).over(w), F.count(F.when(inside & F.col("is_question"), 1)).over(w)
    gated = (bugs > 0) & (bugs - questions <= margin)
    own = own.withColumn("gated", gated)
    if mode == "margin":
        out = own.where(inside & ~(F.col("gated") & F.col("is_bug")))
    elif mode == "cap":
        nth = F.row_number().over(Window.partitionBy(*keys, "is_bug").orderBy("neighbor_rank"))
        out = own.where(inside).withColumn("nth", nth).where(~F.col("is_bug") | (F.col("nth") <= 1)).drop("nth")
    elif mode in ("always", "replace"):
        on = F.lit(True) if mode == "always" else F.col("gated")
        kept = own.where(~(on & F.col("is_bug")))
        rank = F.row_number().over(w.orderBy("neighbor_rank"))
        out = kept.withColumn("rn", rank).where(F.col("rn") <= k).withColumn("neighbor_rank", (F.col("rn") - 1).cast(neighbors.schema["neighbor_rank"].dataType)).drop("rn")
    else:
        raise ValueError(f"no such mode: {mode}")
    return out.drop("is_bug", "is_question", "gated")


def debias_report(neighbors: DataFrame, debiased: DataFrame, k: int) -> DataFrame:
    """One row: queries, queries whose list changed in size, queries left without neighbours."""
    before = neighbors.where(F.col("neighbor_rank") < k).groupBy("test_id").agg(F.count("*").alias("n_before"))
    after = debiased.groupBy("test_id").agg(F.count("*").alias("n_after"))
    j = before.join(after, "test_id", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))
    return j.agg(F.count("*").alias("n_items"), F.count(F.when(F.col("n_after") < F.col("n_before"), 1)).alias("n_debiased"), F.count(F.when(F.col("n_after") == 0, 1)).alias("n_zero_shot"))
