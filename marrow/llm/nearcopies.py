"""Near copies by the exact similarity of their shingle sets.

1. Candidates: a text's set of shingle hashes has BANDS band keys of ROWS minima each; sets
   of similarity s share one with probability 1 - (1 - s ** ROWS) ** BANDS.  Sets that share
   a key are tied to the least set of that key, so a key of any size gives one edge a set,
   and components of these edges are groups that hold all candidates.
2. Verification: the sets of a group meet once, in cells of two blocks of at most some BLOCK / 2
   sets and HASHES / 2 hashes each (a longer set alone), so that a group of any size, and of texts of any length, fits.  Within a cell all sets are linked that are
   connected by pairs of the wanted similarity, by exact intersections.  Jaccard distance
   is a metric: sizes and distances to the first sets (pivots) rule out most pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.llm.common import checkpointed, slices, small_side, stored, utf8
from marrow.llm.graph import components

SEED = 43
BANDS, ROWS = 24, 5
#: Most sets in a cell, and hashes of all its sets.
BLOCK, HASHES = 4096, 4_000_000
#: Hashes of a cell that are compared with a set at once, unless one set has more.
AT_ONCE = 200_000
#: Pivots of a cell.
PIVOTS = 8
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)


def shingles_of(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of runs of ``shingle`` words, A-Z in lower case; a shorter text is one."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    runs = {b" ".join(t) for t in zip(*(words[k:] for k in range(shingle)))} if len(words) > shingle else {b" ".join(words)}
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, SEED) for x in runs), np.uint64, len(runs)))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """The band keys of a set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 2048):
        low = np.minimum(low, ((hashes[lo : lo + 2048, None] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))).min(0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def linked(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges whose closure is that of all pairs of at least ``similarity``: each popped set meets those not reached yet."""
    size = np.array([len(x) for x in sets])
    begin = np.r_[0, np.cumsum(size)]
    known = np.unique(np.concatenate(sets))
    flat = np.empty(int(begin[-1]), np.int32)
    for p, x in enumerate(sets):
        flat[begin[p] : begin[p + 1]] = np.searchsorted(known, x)
    mark = np.zeros(len(known), bool)
    del known
    left, edges, tables = np.flatnonzero(size), [], []
    far = 1 - similarity + 1e-9

    def likeness(x: int, others: np.ndarray) -> np.ndarray:
        mark[flat[begin[x] : begin[x + 1]]] = True
        ends, found = np.cumsum(size[others]), []
        cuts = np.unique(np.searchsorted(ends, np.arange(AT_ONCE, ends[-1], AT_ONCE), side="right"))
        for some in np.split(others, cuts):
            if len(some):
                n = size[some]
                start = np.r_[0, np.cumsum(n)[:-1]]
                at = np.repeat(begin[some] - start, n) + np.arange(n.sum())
                both = np.add.reduceat(mark[flat[at]], start, dtype=np.int64)
                found.append(both / (size[x] + n - both))
        mark[flat[begin[x] : begin[x + 1]]] = False
        return np.concatenate(found)

    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            if len(tables) < PIVOTS:
                d = np.ones(len(sets))
                full = np.flatnonzero(size)
                d[full] = 1 - likeness(x, full)
                tables.append(d)
            fits = np.minimum(size[left], size[x]) >= (similarity - 1e-9) * np.maximum(size[left], size[x])
            for d in tables:
                fits &= np.abs(d[left] - d[x]) <= far
            near = left[fits]
            if len(near):
                near = near[likeness(x, near) >= similarity]
                edges += [(x, int(y)) for y in near]
                frontier += near.tolist()
                left = left[~np.isin(left, near)]
    return edges


def _edges(cells: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Edges (a, b) of the sets of each cell (root, i, j); a partition streams through, one cell held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, keys, sets = None, [], []

        def done() -> pa.RecordBatch:
            e = linked(sets, similarity) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([keys[p] for p, _ in e], pa.int64()), pa.array([keys[q] for _, q in e], pa.int64())], ["a", "b"])

        for batch in slices(batches):
            roots, i, j, key = (batch.column(k).to_pylist() for k in range(4))
            for here, k, t in zip(zip(roots, i, j), key, utf8(batch.column(4))):
                if here != cell:
                    if keys:
                        yield done()
                    cell, keys, sets = here, [], []
                keys.append(k)
                sets.append(shingles_of(t, shingle))
        if keys:
            yield done()

    dealt = cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "key")
    return dealt.select("root", "i", "j", "key", "text").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = BLOCK, hashes: int = HASHES) -> DataFrame:
    """One row per input row: id, component_id (the smallest id of its class).

    Texts link when the Jaccard similarity of their shingle sets is ``similarity`` or more.
    Texts without words are one class, as are equal sets; a null id gets the class of its
    text; repeated rows give repeated results; other columns are not read.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("hash"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("hash", T.LongType()), T.StructField("key", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles_of(t, shingle) for t in utf8(batch.column(1))]
            key = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            bands = [bands_of(x) if len(x) else np.zeros(0, np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(key), pa.array([len(x) for x in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema.names)

    prints = stored(src.mapInArrow(run, schema))
    by_key = stored(prints.groupBy("key").agg(F.min("id").alias("least"), F.min("hash").alias("hash"), F.min("size").alias("size"), F.min("bands").alias("bands")))
    each = by_key.select("key", F.explode("bands").alias("band"))
    shared = small_side(checkpointed(each.groupBy("band").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("band", "first")))
    groups = components(each.join(shared, "band").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b")).distinct())
    sized = groups.join(by_key.select("key", "hash", "size"), F.col("node") == F.col("key")).select("hash", "key", "root", "size")
    n = F.greatest(F.ceil(F.count("*") / F.lit(max(block // 2, 1))), F.ceil(F.sum("size") / F.lit(max(hashes // 2, 1)))).cast("int")
    blocks = sized.groupBy("root").agg(n.alias("blocks")).withColumn("blocks", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")))
    wanted = sized.join(blocks, "root").select("hash", "key", "root", "blocks")
    wanted = small_side(checkpointed(wanted))
    # a hash names one text of each set; its copies are left out before texts move
    texts = src.select("hash", "text").join(wanted, "hash").dropDuplicates(["hash"])
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    cells = texts.withColumn("own", own).select("root", "key", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "text")
    roots = components(checkpointed(_edges(cells, similarity, shingle)))
    classes = by_key.select("key", "least").join(roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select("id", "key").join(classes.join(lowest, "root").select("key", "component_id"), "key").select("id", "component_id")
