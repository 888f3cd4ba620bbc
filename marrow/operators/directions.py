"""Class directions in a vector table (item_id, layer, labels, vector)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.functions import dot, l2_normalize, norm


def _sums(df: DataFrame, by: list[str]) -> DataFrame:
    """(by.., rows, total): each task's sum of its vectors of a group (and length), as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            vectors = batch.column(len(by))
            sizes = np.diff(np.asarray(vectors.offsets))
            numbers: dict[tuple, int] = {}
            keys = zip(*(batch.column(c).to_pylist() for c in range(len(by))), sizes.tolist())
            own = np.array([numbers.setdefault(k, len(numbers)) for k in keys], np.int64)
            flat, first = np.asarray(vectors.flatten()), np.cumsum(sizes) - sizes
            for key, at in numbers.items():
                rows = np.flatnonzero(own == at)
                total = flat[first[rows][:, None] + np.arange(key[-1])].sum(0)
                got = held.setdefault(key, [0, np.zeros(key[-1])])
                got[0] += len(rows)
                got[1] += total
        if held:
            cols = [pa.array([k[c] for k in held], f.type) for c, f in enumerate(batch.schema) if c < len(by)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1].tolist() for v in held.values()], pa.list_(pa.float64()))], [*by, "rows", "total"])

    src = df.where("vector is not null").select(*by, F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    fields = [src.schema[c] for c in by] + [T.StructField("rows", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))]
    return src.mapInArrow(run, T.StructType(fields))


def _means(df: DataFrame, by: list[str], digits: int = 12) -> DataFrame:
    """Mean vector per group by position, from one partial sum per task and group."""
    each = _sums(df, by).select(*by, "rows", F.posexplode("total").alias("pos", "x"))
    m = each.groupBy(*by, "pos").agg((F.sum("x") / F.sum("rows")).alias("x"))
    return m.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: F.round(s["x"], digits)).alias("vector"))


def _minus(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def mean_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """(layer, vector): mean of class a minus mean of class b."""
    m = _means(df.where(F.col("labels").isin(a, b)), ["layer", "labels"])
    left = m.where(F.col("labels") == a).select("layer", F.col("vector").alias("va"))
    right = m.where(F.col("labels") == b).select("layer", F.col("vector").alias("vb"))
    return left.join(right, "layer").select("layer", _minus("va", "vb").alias("vector"))


def pair_difference(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """(layer, vector): mean over pairs (a_id, b_id) of a's vector minus b's."""
    a = df.select("layer", F.col("item_id").alias("a_id"), F.col("vector").alias("va"))
    b = df.select("layer", F.col("item_id").alias("b_id"), F.col("vector").alias("vb"))
    d = pairs.select("a_id", "b_id").join(a, "a_id").join(b, ["layer", "b_id"]).select("layer", _minus("va", "vb").alias("vector"))
    return _means(d, ["layer"])


def variant_difference(df: DataFrame, a: str, b: str, variant_col: str = "variant") -> DataFrame:
    """(layer, vector): mean over items of variant a minus variant b of the same item."""
    left = df.where(F.col(variant_col) == a).select("layer", "item_id", F.col("vector").alias("va"))
    right = df.where(F.col(variant_col) == b).select("layer", "item_id", F.col("vector").alias("vb"))
    return _means(left.join(right, ["layer", "item_id"]).select("layer", _minus("va", "vb").alias("vector")), ["layer"])


def layer_norms(directions: DataFrame) -> DataFrame:
    return directions.select("layer", F.round(norm("vector"), 4).alias("l2_norm"))


def _with_direction(df: DataFrame, directions: DataFrame) -> DataFrame:
    """One direction a layer: a handful of rows."""
    return df.join(F.broadcast(directions.select("layer", F.col("vector").alias("direction"))), "layer", "left")


def shift_vectors(df: DataFrame, directions: DataFrame, multiplier: float, layers: list[int] | None = None) -> DataFrame:
    """x + m v in the chosen layers (default: all that have a direction)."""
    on = F.col("direction").isNotNull() & (F.col("layer").isin(*layers) if layers is not None else F.lit(True))
    moved = F.zip_with("vector", "direction", lambda x, v: x.cast("double") + F.lit(multiplier) * v)
    return _with_direction(df, directions).withColumn("vector", F.when(on, moved).otherwise(F.col("vector").cast("array<double>"))).drop("direction")


def remove_direction(df: DataFrame, directions: DataFrame) -> DataFrame:
    """x - (x.r) r with r the unit direction of the layer; a zero direction changes nothing.

    Directions are made unit before the join, and x.r is bound once for a vector.
    """
    unit = directions.select("layer", l2_normalize("vector").alias("vector"))
    less = lambda along: F.zip_with("vector", "direction", lambda x, r: x.cast("double") - along * r)
    out = F.transform(F.array(dot("vector", "direction")), less)[0]
    return _with_direction(df, unit).withColumn("vector", F.when(F.col("direction").isNotNull(), out).otherwise(F.col("vector").cast("array<double>"))).drop("direction")
