"""Quality rules with thresholds that adapt to language and source.

Base measures of each text are counted in whole numbers.  Of four ratios (parts per
million) every (lang, source) keeps a mergeable quantile sketch: a log-linear histogram
with a relative error of 1/32, whose buckets are counted by an ordinary aggregate, so
that partial sketches add up in any order.  A ratio's fences lie beyond an upper (for word
length also a lower) quantile of its group by a multiple of the distance between two of its
quantiles.  Where most documents of a group have none of something (symbols), those quantiles
have no spread; the fence then lies at a part of a quantile of the group's documents that
have some, which the same sketch tells.  No fence has a fixed place: what a group does as a
rule is its norm.  A group of fewer than LEAST_DOCS documents takes the sketch of its language.  A document is kept if it passes the base rules and all
fences of its group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from marrow.llm.common import WHITE, checkpointed, utf8

SYMBOLS = b"#*$%&|<>"
#: Ratio: percentiles p and q, factor: the upper fence is q + factor (q - p).  Ratios that are zero in most
#: documents of a clean group and large in a few (repeats) are measured by their far tail.
FENCES = {"symbols": (25, 75, 3), "dup_lines": (50, 99, 1), "repeats": (50, 99, 1), "word_length": (25, 75, 5)}
#: Ratios with a lower fence as well: p - factor (q - p).
TWO_SIDED = ("word_length",)
#: Ratio: percentile of the documents that aren't zero, and the part of it by which a fence is beyond its quantile at least.
SOME = {"symbols": (25, 4)}
#: The same as a fixed distance for ratios with a spread of their own: one part in a hundred (word_length: a tenth of a character).
LEAST_WIDTH = {"dup_lines": 10_000, "repeats": 10_000, "word_length": 100}
#: Documents past the base rules that a group needs for fences of its own.
LEAST_DOCS = 100
_RATIOS = {"symbols": "n_symbols * 1000000 div word_chars", "dup_lines": "n_dup_lines * 1000000 div greatest(n_lines, 1)", "repeats": "n_repeat_words * 1000000 div n_words", "word_length": "word_chars * 1000 div n_words"}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def measures_of(text: bytes | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    chars = len(text.translate(None, WHITE).decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    triples = list(zip(words, words[1:], words[2:]))
    found = Counter(triples)
    again = 0
    if len(found) < len(triples):
        upto = 0  # first word not counted yet
        for i, t in enumerate(triples):
            if found[t] > 1:
                again += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), again


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per input row: id, g0, g1.. (the group columns) and the counts of the whole text."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *(docs[c].alias(f"g{k}") for k, c in enumerate(group_cols)))
    groups = [src.schema[f"g{k}"] for k in range(len(group_cols))]
    schema = T.StructType([src.schema["id"], *groups, *(T.StructField(c, T.LongType()) for c in _COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures_of(t) for t in utf8(batch.column(1))]
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + k) for k in range(len(groups))), *counts], schema.names)

    return src.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def bucket_of(value: Column) -> Column:
    """Sketch bucket of a whole number: exact below 64, then 32 buckets to a power of two."""
    e = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (e * 32 + F.expr("0")).cast("long") + F.call_function("shiftright", value, e)


def bucket_top(bucket: Column) -> Column:
    """Largest value of a bucket."""
    e = F.greatest(F.floor(bucket / 32).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", bucket - e * 32 + 1, e) - 1


def sketches(counted: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable sketches: rows (groups, rule, bucket, n) of documents that pass the base rules."""
    each = counted.where(~base_failed()).select(*groups, F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.expr(x).alias("value")) for r, x in _RATIOS.items()))).alias("x"))
    return each.groupBy(*groups, F.col("x.rule").alias("rule"), bucket_of(F.col("x.value")).alias("bucket")).agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, rule, total, p, q, some): documents of a sketch, the two quantiles of its rule, and that of SOME (0 where all are zero)."""
    w = Window.partitionBy(*groups, "rule")
    zero = F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(w)
    s = sketch.select(*groups, "rule", "bucket", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("total"), zero.alias("zero"))
    percent = F.element_at(F.create_map(*(F.lit(x) for r in FENCES for x in (r, SOME.get(r, (0, 1))[0]))), F.col("rule"))
    beyond = (F.col("bucket") > 0) & ((F.col("upto") - F.col("zero")) * 100 >= (F.col("total") - F.col("zero")) * percent)

    def at(k: int) -> Column:
        percent = F.element_at(F.create_map(*(F.lit(x) for r, f in FENCES.items() for x in (r, f[k]))), F.col("rule"))
        return bucket_top(F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("bucket"))))

    return s.groupBy(*groups, "rule").agg(F.max("total").alias("total"), at(0).alias("p"), at(1).alias("q"), F.coalesce(bucket_top(F.min(F.when(beyond, F.col("bucket")))), F.lit(0).cast("long")).alias("some"))


def fences(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group with the fences of each rule: upper ones (fence_*), and lower ones (least_*) of TWO_SIDED.

    A small group's fences come from the merged sketches of all groups that share all but its
    last column.
    """
    wide = [F.col(g).alias(f"w{k}") for k, g in enumerate(groups[:-1])]
    merged = sketch.groupBy(*groups[:-1], "rule", "bucket").agg(F.sum("n").alias("n"))
    merged = _quantiles(merged, groups[:-1]).select(*wide, F.col("rule").alias("wrule"), *(F.col(c).alias(f"w_{c}") for c in ("p", "q", "some")))
    same = F.col("rule") == F.col("wrule")
    for k, g in enumerate(groups[:-1]):
        same = same & F.col(g).eqNullSafe(F.col(f"w{k}"))
    small = F.col("total") < LEAST_DOCS
    x = _quantiles(sketch, groups).join(merged, same).select(*groups, "rule", *(F.when(small, F.col(f"w_{c}")).otherwise(F.col(c)).alias(c) for c in ("p", "q", "some")))
    out = []
    for r, (_, _, factor) in FENCES.items():
        least = F.floor(F.col("some") / SOME[r][1]).cast("long") if r in SOME else F.lit(LEAST_WIDTH[r])
        width = F.greatest(F.lit(factor) * (F.col("q") - F.col("p")), least)
        out.append(F.max(F.when(F.col("rule") == r, F.col("q") + width)).alias(f"fence_{r}"))
        if r in TWO_SIDED:
            out.append(F.max(F.when(F.col("rule") == r, F.col("p") - width)).alias(f"least_{r}"))
    return x.groupBy(*groups).agg(*out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per input row: id, the counts, base_failed, kept and the fences of its group.

    Null and empty texts have no words, so fail the base rules; null group values form a
    group of their own; a group without a passing document has no fences (null) and keeps
    nothing; repeated rows count and come back as often as given; no other column is read.
    Fences are one row per group; a hot group's documents are a join that Spark splits.
    """
    groups = [f"g{k}" for k in range(len(group_cols))]
    counted = checkpointed(measures(docs, id_col, text_col, group_cols))
    names = [f"fence_{r}" for r in FENCES] + [f"least_{r}" for r in TWO_SIDED]
    limits = fences(sketches(counted, groups), groups).select(*(F.col(g).alias(f"of_{g}") for g in groups), *names)
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    within = F.lit(True)
    for r, x in _RATIOS.items():
        within = within & (F.expr(x) <= F.col(f"fence_{r}"))
        if r in TWO_SIDED:
            within = within & (F.expr(x) >= F.col(f"least_{r}"))
    out = counted.join(limits, same, "left").withColumn("base_failed", base_failed())
    return out.select("id", *_COUNTS, "base_failed", F.when(F.col("base_failed"), False).otherwise(F.coalesce(within, F.lit(False))).alias("kept"), *names)
