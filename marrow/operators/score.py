"""Scores of predictions under two conventions that are never mixed.

Strict: every row counts, an invalid output is an error.  Valid-only: rows with an
invalid output are left out first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.functions import LABELS, fold_label, ratio


def _counts(preds: DataFrame, by: list[str]) -> DataFrame:
    """All counts that either convention needs, in one partial aggregate; ok_* are those of rows with a valid prediction."""
    x = preds.select(*by, fold_label("ground_truth").alias("t"), fold_label("predicted_label").alias("p"))
    n = lambda c: F.count(F.when(c, 1))
    ok = F.col("p").isin(*LABELS)
    counts = [F.count("*").alias("n"), n(F.col("p") == "invalid").alias("n_invalid"), n(F.col("t") == F.col("p")).alias("right")]
    counts += [n(ok).alias("ok_n"), n(ok & (F.col("t") == F.col("p"))).alias("ok_right")]
    for v in LABELS:
        counts += [n((F.col("t") == v) & (F.col("p") == v)).alias(f"tp_{v}"), n(F.col("p") == v).alias(f"pp_{v}"), n(F.col("t") == v).alias(f"support_{v}"), n(ok & (F.col("t") == v)).alias(f"ok_support_{v}")]
    return x.groupBy(*by).agg(*counts)


def _measures(ok: str = "", digits: int = 4) -> dict[str, Column]:
    """accuracy, and precision, recall, F1 and support per class, macro and weighted; ``ok`` "ok_" for valid rows only."""
    r = lambda c: F.round(c, digits)
    support = {v: F.col(f"{ok}support_{v}") for v in LABELS}
    x = {"precision": {v: ratio(F.col(f"tp_{v}"), F.col(f"pp_{v}")) for v in LABELS}, "recall": {v: ratio(F.col(f"tp_{v}"), support[v]) for v in LABELS}}
    x["f1"] = {v: ratio(x["precision"][v] * x["recall"][v] * 2, x["precision"][v] + x["recall"][v]) for v in LABELS}
    total = lambda cs: reduce(lambda a, b: a + b, cs)
    out = {"accuracy": r(ratio(F.col(f"{ok}right"), F.col(f"{ok}n")))}
    for v in LABELS:
        out |= {f"{name}_{v}": r(x[name][v]) for name in x} | {f"support_{v}": support[v]}
    for name in x:
        out[f"{name}_macro"] = r(total(x[name].values()) / len(LABELS))
        out[f"{name}_weighted"] = r(ratio(total(x[name][v] * support[v] for v in LABELS), total(support.values())))
    return out


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def evaluate_strict(preds: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: counts, accuracy, precision, recall, F1 per class, macro and weighted; one partial aggregate."""
    head = {"total_issues": F.col("n"), "invalid_count": F.col("n_invalid"), "invalid_rate": F.round(ratio(F.col("n_invalid"), F.col("n")), 4)}
    return _counts(preds, by).select(*by, *_named(head | _measures()))


def evaluate_valid(preds: DataFrame, by: list[str], percent: bool = False) -> DataFrame:
    """The same over rows with a valid prediction; invalid_* describe all rows (as percent with two digits if asked)."""
    bad = F.col("n") - F.col("ok_n")
    rate = F.round(ratio(bad, F.col("n")) * 100, 2) if percent else F.round(ratio(bad, F.col("n")), 4)
    return _counts(preds, by).where("ok_n > 0").select(*by, *_named({"total_issues": F.col("ok_n"), "invalid_count": bad, "invalid_rate": rate} | _measures("ok_")))


def confusion(preds: DataFrame, by: list[str]) -> DataFrame:
    """Rows (group, truth) with a count per prediction, invalid included, and recall."""
    x = preds.select(*by, fold_label("ground_truth").alias("truth"), fold_label("predicted_label").alias("p"))
    n = lambda v: F.count(F.when(F.col("p") == v, 1))
    g = x.groupBy(*by, "truth").agg(*(n(v).alias(f"n_{v}") for v in (*LABELS, "invalid")), F.count("*").alias("support"), F.round(ratio(F.count(F.when(F.col("p") == F.col("truth"), 1)), F.count("*")), 4).alias("recall"))
    return g


def class_report(scores: DataFrame, by: list[str]) -> DataFrame:
    """A score row as one row per class."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("label"), F.col(f"precision_{v}").alias("precision"), F.col(f"recall_{v}").alias("recall"), F.col(f"f1_{v}").alias("f1"), F.col(f"support_{v}").alias("support")) for v in LABELS)))
    return scores.select(*by, each.alias("x")).select(*by, "x.*")


def convention_gap(preds: DataFrame, by: list[str]) -> DataFrame:
    """Strict minus valid-only macro-F1 and accuracy per run, from one aggregate."""
    strict, valid = _measures(), _measures("ok_")
    gap = lambda name: F.round(strict[name] - valid[name], 4)
    out = {"f1_strict": strict["f1_macro"], "f1_valid": valid["f1_macro"], "f1_gap": gap("f1_macro"), "accuracy_gap": gap("accuracy")}
    return _counts(preds, by).where("ok_n > 0").select(*by, *_named(out))
