"""Neighbour-vote classification of a neighbour table (test_id, neighbor_rank, similarity, neighbor_label, test_label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions import canonical_label
from marrow.operators.retrieve import explode_k

SCHEMES = ("similarity", "shepard", "majority")


def _winner(scores: Column, scheme: str) -> Column:
    """The label of the best score; among equal ones the first, which is that of the best-ranked neighbour."""
    best = F.array_max(F.transform(scores, lambda s: s[scheme]))
    return F.get(F.filter(scores, lambda s: s[scheme] == best), F.lit(0))["label"]


def _folded(near: Column, ks: list[int], schemes: tuple[str, ...]) -> Column:
    """array<struct<k, one label a scheme>> of a list in rank order, in one pass: scores of the labels so far, and the winners at each of ``ks``."""
    doubles = ", ".join(f"{s}: double" for s in schemes)
    start = F.struct(F.lit(0).alias("i"), F.array().cast(f"array<struct<label: string, {doubles}>>").alias("scores"), F.array().cast(f"array<struct<k: int, {', '.join(f'{s}: string' for s in schemes)}>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        own = F.when(x["label"].isNull(), 0.0)
        weight = {"similarity": own.otherwise(x["similarity"]), "shepard": own.otherwise(x["similarity"] * x["similarity"]), "majority": own.otherwise(1.0)}
        first = F.struct(x["label"].alias("label"), *(weight[s].cast("double").alias(s) for s in schemes))
        more = lambda s: F.struct(s["label"].alias("label"), *((s[c] + weight[c]).alias(c) for c in schemes))
        same = lambda s: s["label"].eqNullSafe(x["label"])
        now = F.when(F.exists(acc["scores"], same), F.transform(acc["scores"], lambda s: F.when(same(s), more(s)).otherwise(s))).otherwise(F.concat(acc["scores"], F.array(first)))
        k = acc["i"] + 1

        def held(scores: Column) -> Column:
            row = F.struct(k.alias("k"), *(_winner(scores, s).alias(s) for s in schemes))
            return F.struct(k.alias("i"), scores.alias("scores"), F.when(k.isin(*ks), F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

        return F.transform(F.array(now), held)[0]  # binds the scores once

    return F.aggregate(near, start, add, lambda acc: acc["out"])


def vote_sweep(neighbors: DataFrame, ks: list[int], schemes: tuple[str, ...] = SCHEMES) -> DataFrame:
    """(scheme, k, test_id, ground_truth, predicted_label) for every scheme and every usable k.

    A k is used if every query has that many neighbours.  Weights are the similarity, its
    square or one; a label's score is summed in rank order (so that ties are exact), and
    among equal scores the label of the best-ranked neighbour wins.  A null label scores 0.
    One shuffle by query (none for a table bucketed by test_id), and one pass over each
    list gives all ks and schemes; a list becomes several rows only at the end.
    """
    lists = neighbors.groupBy("test_id", "test_label").agg(F.array_sort(F.collect_list(F.struct("neighbor_rank", "similarity", canonical_label("neighbor_label").alias("label")))).alias("near"))
    wanted = sorted({int(k) for k in ks if k >= 1})
    if not wanted:
        wanted = [0]
    usable = lists.agg(F.min(F.size("near")).alias("most"))
    folded = lists.select("test_id", "test_label", F.explode(_folded(F.slice("near", 1, max(1, wanted[-1])), wanted, schemes)).alias("x"))
    kept = folded.join(F.broadcast(usable), F.col("x.k") <= F.col("most"))  # one row
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("scheme"), F.col(f"x.{s}").alias("label")) for s in schemes))).alias("s")
    return kept.select("x.k", "test_id", F.col("test_label").alias("ground_truth"), each).select("s.scheme", "k", "test_id", "ground_truth", F.col("s.label").alias("predicted_label"))


def vote(neighbors: DataFrame, k: int, scheme: str = "similarity") -> DataFrame:
    return vote_sweep(neighbors, [k], (scheme,))


def to_predictions(votes: DataFrame, items: DataFrame) -> DataFrame:
    """Votes in the common 13-column prediction shape."""
    t = items.select(F.col("item_id").alias("test_id"), "title", "body")
    flags = [F.lit(False).alias(c) for c in ("truncated", "neighbors_truncated", "query_truncated")]
    return votes.join(t, "test_id").select(
        F.col("test_id").alias("test_idx"),
        "title",
        "body",
        "ground_truth",
        "predicted_label",
        F.col("predicted_label").alias("raw_output"),
        *flags,
        F.lit(0).alias("tokens_removed"),
        F.concat(F.lit("vote-"), "scheme").alias("parsed_via"),
        F.lit(0).alias("prompt_tokens"),
        F.lit(0).alias("generated_tokens"),
        "scheme",
        "k",
    )


def vote_accuracy(votes: DataFrame) -> DataFrame:
    return votes.groupBy("scheme", "k").agg(F.avg((F.col("predicted_label") == F.col("ground_truth")).cast("double")).alias("accuracy"))


def shares(neighbors: DataFrame, k: int) -> DataFrame:
    """(test_id, test_label, label, share) of the similarity vote, for calibration."""
    top = explode_k(neighbors, [k])
    s = top.groupBy("test_id", "test_label", F.col("neighbor_label").alias("label")).agg(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("neighbor_rank", "similarity"))), lambda x: x["similarity"]), F.lit(0.0), lambda acc, x: acc + x).alias("score"))
    return s.withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy("test_id"))).drop("score")
