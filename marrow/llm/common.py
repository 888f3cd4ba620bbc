"""Helpers that several corpus operators share."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space in word rules: blank and \x09-\x0D, which is what bytes.split() splits on.
WHITE = b" \t\n\x0b\x0c\r"
#: Documents above this many characters are left out of training samples (never out of scoring).
SAMPLE_CHARS = 65_536
#: Most rows and characters of a training sample, all labels together.
SAMPLE_ROWS, SAMPLE_TOTAL = 20_000, 64_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where a local session leaves it unset (tests).

    A cluster without that setting is an error: executors would write to disks of their own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        held = sc._jsc.sc().getCheckpointDir()
    return named or held.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: smaller than a checkpoint where rows are many."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string")) % n


def labelled_sample(docs: DataFrame, per_label: int, labels: DataFrame | None = None, label_col: str = "label", id_col: str = "doc_id", text_col: str = "text", salt: str = "sample") -> list[tuple]:
    """At most ``per_label`` rows (label, text) of each label, in an order fixed by a hash of the id.

    Labels come from ``labels`` (id, label), or from the column ``label_col`` of docs.  Rows
    without id, label or text and rows of over SAMPLE_CHARS characters are left out before
    the choice.  An id that comes with several labels or texts has the least of each, so the
    sample doesn't depend on the order of tasks.  Counts by prefix of the hash tell where a
    label's sample ends, so only that many ids are ranked.  The result may go to the driver:
    it holds at most SAMPLE_ROWS rows and SAMPLE_TOTAL characters, shared equally by labels.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *([docs[label_col].alias("label")] if labels is None else []))
    src = src.where(F.col("id").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    keys = src.select("id", F.length("text").alias("n"), *(["label"] if labels is None else []))
    keys = keys if labels is None else keys.join(labels.select("id", "label"), "id")
    keys = checkpointed(keys.where("label is not null").groupBy("id").agg(F.min("label").alias("label"), F.min("n").alias("n")).withColumn("h", F.xxhash64(F.lit(salt), F.col("id").cast("string"))))
    counts = keys.groupBy("label", F.shiftright("h", 52).alias("prefix")).agg(F.count("*").alias("rows"))
    w = Window.partitionBy("label").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = counts.withColumn("upto", F.sum("rows").over(w)).where(F.col("upto") - F.col("rows") < per_label).groupBy("label").agg(F.max("prefix").alias("last"))
    near = keys.join(small_side(checkpointed(cuts)), "label").where(F.shiftright("h", 52) <= F.col("last"))
    n_labels = max(1, cuts.count())
    order = Window.partitionBy("label").orderBy("h", F.col("id").cast("string"))
    ranked = near.withColumn("rn", F.row_number().over(order)).withColumn("chars", F.sum("n").over(order))
    chosen = checkpointed(ranked.where((F.col("rn") <= min(per_label, SAMPLE_ROWS // n_labels)) & (F.col("chars") <= SAMPLE_TOTAL // n_labels)).select("id", "label"))
    texts = src.select("id", "text").join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # at most SAMPLE_ROWS rows
    return [(r["label"], r["text"]) for r in sorted(texts.collect(), key=lambda r: r["id"])]


def broadcast_object(spark: SparkSession, value):
    """A function that gives ``value`` on executors; the value travels once to each, its classes with it."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string array as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


#: Rows that a task makes Python objects of at a time.
SLICE_ROWS = 500


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows`` rows: what a task makes of texts doesn't grow with Spark's batches, nor stays with the worker."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


class HashIndex:
    """Row numbers of distinct non-zero 64-bit keys, in an open-addressing table that numpy probes."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        rest = np.arange(len(keys))
        at = self._start(keys)
        while len(rest):
            free = self.slots[at] == 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.slots[at[won]] = keys[rest[won]]
            self.rows[at[won]] = rest[won]
            left = np.ones(len(rest), bool)
            left[won] = False
            rest, at = rest[left], (at[left] + 1) & self.mask

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self._start(keys)
        got = self.slots[at]
        out = np.where(got == keys, self.rows[at], -1)
        rest = np.flatnonzero((got != keys) & (got != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            got = self.slots[at[rest]]
            hit = got == keys[rest]
            out[rest[hit]] = self.rows[at[rest[hit]]]
            rest = rest[~hit & (got != 0)]
        return out


#: Most bytes of a side that is broadcast; a larger side is left to a shuffle join.
SMALL_BYTES = 10_000_000


def small_side(df: DataFrame, row_bytes: Column | int = 100) -> DataFrame:
    """A written table as the small side of a join: broadcast if its rows have SMALL_BYTES or fewer in all, else as it is.

    ``row_bytes`` is the size of a row; a column where rows hold arrays.
    """
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= SMALL_BYTES else df
