"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.llm.common import checkpointed


def _edges(df: DataFrame, *pairs: tuple[Column | str, Column | str]) -> DataFrame:
    """An edge (u, v) for each of ``pairs`` of each row; a union would plan what df is made of once for each."""
    struct = lambda p: F.struct(*(F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for c, n in zip(p, ("u", "v"))))
    return df.select(F.inline(F.array(*map(struct, pairs))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node that can be reached.

    Large-star and small-star steps alternate until the edges no longer change; they then
    are stars around the roots.  Each round is written to the checkpoint folder, and only
    a count and a sum of hashes come to the driver.  Nulls and loops are left out; an
    empty table gives an empty table.
    """
    ab = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    ab = checkpointed(ab)
    before = None
    while True:
        both = _edges(ab, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = _edges(met, (F.greatest("v", "m"), F.least("v", "m")), ("u", "m")).where("u <> v").distinct()
        ab = checkpointed(small)
        now = tuple(ab.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return ab.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(ab.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
