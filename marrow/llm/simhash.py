"""SimHash near-dedup with pivot distance tables.

A fingerprint has bit i set if over half of the shingle hashes have.  Each distinct
fingerprint gets its row of Hamming distances to PIVOTS reference fingerprints once, in a
written table.  To link fingerprints at a small Hamming distance d, rows of that table are
dealt into buckets of equal bits: of d+1 bands one must agree.  A bucket that holds over BUCKET fingerprints is dealt anew
by bands of its remaining bits, again and again, so that no bucket grows with a group of
near copies, and nothing is lost.  By the triangle inequality two fingerprints whose rows
differ by more than d in any coordinate are further apart than d: in a bucket, order by
the first coordinate bounds the partners looked at, pairs whose largest coordinate
difference is above d are discarded, and survivors are verified.  (Cells of the
coordinates alone can't deal: a distance of random fingerprints to a pivot has a spread of
4, so a cell that keeps pairs within 3 together holds half of all rows.)  Each bucket gives at most one link for each
fingerprint (to the least of its component there), not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.llm.common import checkpointed, slices, stored, utf8
from marrow.llm.graph import components

SEED = 42
#: Buckets above this are dealt anew by their remaining bits.
BUCKET = 512
#: With this many bits left a bucket has at most 2 ** 11 distinct fingerprints and is taken as it is.
LAST_BITS = 11
#: Pivots: XXH64 of their numbers.
PIVOTS = np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(32)], np.uint64)


def fingerprint_of(text: bytes | None, shingle: int = 3) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        parts: list[bytes] = [b" ".join(words)]
    else:
        parts = [b" ".join(t) for t in zip(*(words[k:] for k in range(shingle)))]
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(parts), 1 << 16):
        h = np.array([digest(p, SEED) for p in parts[lo : lo + (1 << 16)]], "<u8")
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(parts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed 64-bit number.

    Shingles are runs of ``shingle`` words, repeats included, A-Z in lower case; a shorter
    text is one shingle; a null text or one without words has fingerprint zero.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint_of(t, shingle) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return src.mapInArrow(run, schema)


def _bands(free: list[int], n: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(free), n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _children(mask: int, distance: int) -> list[int]:
    """The masks that fix one more band of the bits that ``mask`` leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in band) for band in _bands(free, distance + 1)]


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, first, row): the first pivot distance of each fingerprint, and all of them as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(table[:, 0].astype(np.int32)), pa.array([x.tobytes() for x in table], pa.binary())], ["fp", "first", "row"])

    return fps.select("fp").mapInArrow(run, "fp long, first int, row binary")


def pairs_in_buckets(bucket_end: np.ndarray, fp: np.ndarray, table: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``distance``; rows are sorted by bucket and first pivot distance."""
    table = table.astype(np.int8)
    first = table[:, 0]
    i, out_i, out_j = np.arange(len(fp)), [], []
    s = 1
    while len(i):
        j = i + s
        i = i[j < bucket_end[i]]
        i = i[first[i + s] - first[i] <= distance]  # sorted: no later partner is nearer
        near = np.ones(len(i), bool)
        for lo in range(1, table.shape[1], 8):  # the largest difference of eight coordinates at a time
            k = np.flatnonzero(near)
            near[k] = np.abs(table[i[k], lo : lo + 8] - table[i[k] + s, lo : lo + 8]).max(1) <= distance
        a = i[near]
        near = np.bitwise_count(fp[a] ^ fp[a + s]) <= distance
        out_i.append(a[near])
        out_j.append(a[near] + s)
        s += 1
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def _stars(a: np.ndarray, b: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge from each linked fingerprint to the first row of its component."""
    if not len(a):
        return fp[:0], fp[:0]
    label = np.arange(len(fp))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    k = np.flatnonzero(label != np.arange(len(fp)))
    return fp[k], fp[label[k]]


def _scan(dealt: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) of buckets (mask, key); a partition streams through, one bucket carried over at a time."""
    sorted_rows = dealt.repartition("mask", "key").sortWithinPartitions("mask", "key", "first", "fp")

    def edges(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = np.r_[0, new, len(fp)]
        end = np.repeat(bounds[1:], np.diff(bounds))
        fp = fp.view(np.uint64)
        a, b = _stars(*pairs_in_buckets(end, fp, table, distance), fp)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            cols.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, len(PIVOTS)))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            mask, key, fp = cols[:3]
            if not len(fp):
                continue
            last = len(fp) - 1
            same = (mask == mask[last]) & (key == key[last])
            cut = int(np.flatnonzero(same)[0])
            held = [x[cut:] for x in cols]
            if cut:
                yield edges(*(x[:cut] for x in cols))
        if held is not None:
            yield edges(*held)

    return sorted_rows.select("mask", "key", "fp", "row").mapInArrow(run, "a long, b long").distinct()


def links(fps: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose closure is that of all pairs within ``distance``."""
    spark = fps.sparkSession
    fps = stored(pivot_table(fps.select("fp").where("fp is not null").distinct()))
    level, masks, parts = fps.withColumn("mask", F.lit(0).cast("long")), [0], []
    while True:
        children = {m: _children(m, distance) for m in masks}
        pairs = spark.createDataFrame([(_signed(m), _signed(c)) for m, cs in children.items() for c in cs], "mask long, child long")
        dealt = level.join(F.broadcast(pairs), "mask").select(F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("key"), "fp", "first", "row").dropDuplicates(["mask", "fp"])
        masks = sorted({c for cs in children.values() for c in cs})
        if 64 - min(m.bit_count() for m in masks) <= LAST_BITS:
            parts.append(_scan(dealt, distance))
            break
        hot = checkpointed(dealt.groupBy("mask", "key").count().where(F.col("count") > bucket).select("mask", "key"))
        if hot.isEmpty():
            parts.append(_scan(dealt, distance))
            break
        parts.append(_scan(dealt.join(hot, ["mask", "key"], "left_anti"), distance))
        level = checkpointed(dealt.join(hot, ["mask", "key"], "left_semi").select("fp", "first", "row", "mask"))
        masks = sorted(r["mask"] & ((1 << 64) - 1) for r in hot.select("mask").distinct().collect())  # at most (distance + 1) ** level
    return reduce(DataFrame.unionByName, parts)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: id, fp (signed), component_id (the smallest id of its class).

    Texts link when their fingerprints differ in at most ``distance`` bits.  Copies share a
    fingerprint and are met by one aggregate, so a large group costs no more than its
    rows.  Null and empty texts share fingerprint zero and link like any other; a null id
    gets the class of its text; repeated rows give repeated results; other columns are
    not read.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    by_fp = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(by_fp, distance, bucket))
    own = by_fp.join(roots, by_fp["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = own.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = own.join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("id", "fp", "component_id")
