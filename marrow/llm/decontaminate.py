"""Benchmark decontamination with broadcast sets of normalised test n-grams.

Normal form: A-Z lower-cased; words are runs of ASCII letters, digits and characters
beyond ASCII.  Each benchmark item gives its windows of 13 words (a shorter item: one
window of all its words).  Windows are broadcast in blocks of at most some BLOCK_WINDOWS and
BLOCK_BYTES, so a broadcast never grows with the benchmark, nor with the length of its words; beyond one block the corpus is scanned once a
block and the findings of a row are united.  A scan looks up words in the vocabulary of
the block, takes windows made of known words only, compares a rolling hash, and verifies
each hit word by word.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marrow.llm.common import checkpointed, stored, utf8

WINDOW = 13
#: Windows in one broadcast, and their bytes: about 100 MB in a Python worker.
BLOCK_WINDOWS, BLOCK_BYTES = 400_000, 40_000_000
_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_FOLD = bytes(c if c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_BASE = np.uint64(0x100000001B3)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item, window, n): each item's normalised windows; items without words have none."""
    src = items.select(items[item_col].alias("item"), items[text_col].alias("text")).where("item is not null")
    schema = T.StructType([T.StructField("item", src.schema["item"].dataType), T.StructField("window", T.BinaryType()), T.StructField("n", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, size = [], [], []
            for i, t in enumerate(utf8(batch.column(1))):
                w = words_of(t)
                k = min(window, len(w))
                for j in range(len(w) - k + 1 if k else 0):
                    at.append(i)
                    out.append(b" ".join(w[j : j + k]))
                    size.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.binary()), pa.array(size, pa.int32())], ["item", "window", "n"])

    return src.mapInArrow(run, schema).distinct()


class WindowSet:
    """The windows of one block, by length, with their items."""

    def __init__(self, rows: list[tuple]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[bytes, list] = {}
        lengths: dict[int, list[int]] = {}
        for item, window, n in rows:
            window = bytes(window)
            if window not in self.items:
                ids = np.array([[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window.split()]], np.uint64)
                lengths.setdefault(n, []).append(int(_hash(ids)[0]))
            self.items.setdefault(window, []).append(item)
        self.hashes = {n: np.unique(np.array(h, np.uint64)) for n, h in sorted(lengths.items())}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Which words are hit (None: none), and the items that occur."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        unknown = np.zeros(len(words) + 1, np.int64)
        np.cumsum(ids == 0, out=unknown[1:])
        hit, found = None, set()
        for n, known in self.hashes.items():
            if len(words) < n:
                break
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            h = _hash(ids[at[:, None] + np.arange(n)]) if len(at) < 200_000 else np.concatenate([_hash(ids[p[:, None] + np.arange(n)]) for p in np.array_split(at, len(at) // 100_000)])
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in at[known[k] == h]:
                own = self.items.get(b" ".join(words[i : i + n]))
                if own:
                    found.update(own)
                    hit = np.zeros(len(words), bool) if hit is None else hit
                    hit[i : i + n] = True
        return hit, found


def _hash(ids: np.ndarray) -> np.ndarray:
    h = np.zeros(len(ids), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ids.shape[1]):
            h = (h ^ ids[:, j]) * _BASE + np.uint64(j)
    return h


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    d = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return list(zip(d[::2].tolist(), d[1::2].tolist()))


def find_overlap(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, n_words, items (sorted array), runs (array of [begin, end) word positions that are hit).

    ``windows`` comes from item_windows().  Null and empty texts have no words and no hits;
    an empty benchmark gives rows without hits; repeated rows give repeated results; other
    columns are not read.  With one block there is no shuffle of documents; with more, one
    block after the other is broadcast, scanned to a written table and released.
    """
    return _overlap(docs, windows, id_col, text_col, block_windows, block_bytes).drop("key")


def _blocks(windows: DataFrame, block_windows: int, block_bytes: int) -> int:
    """In how many blocks windows are dealt, by their number and by their bytes."""
    n, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window").cast("long")), F.lit(0))).first()
    return max(1, -(-n // block_windows), -(-size // block_bytes))


def _overlap(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, block_windows: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """find_overlap() with key, a hash of id and text."""
    spark = docs.sparkSession
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    windows = checkpointed(windows)
    blocks = _blocks(windows, block_windows, block_bytes)
    item_type = windows.schema["item"].dataType
    item_kind = to_arrow_type(item_type)
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(item_type)), T.StructField("runs", T.ArrayType(span))])
    src = src.select("id", "text", F.xxhash64("id", "text").alias("key"))

    def scan(block: int):
        part = windows.where(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == block) if blocks > 1 else windows
        held = spark.sparkContext.broadcast(cloudpickle.dumps(WindowSet([tuple(r) for r in part.collect()])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(held.value)
            run_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            for batch in batches:
                size, items, runs = [], [], []
                for t in utf8(batch.column(1)):
                    w = words_of(t)
                    hit, found = own.scan(w) if w else (None, ())
                    size.append(len(w))
                    items.append(sorted(found))
                    runs.append([{"begin": a, "end": b} for a, b in _runs(hit)] if hit is not None else [])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(items, pa.list_(item_kind)), pa.array(runs, run_type)], ["id", "key", "n_words", "items", "runs"])

        return src.mapInArrow(run, schema), held

    if blocks == 1:
        return scan(0)[0]
    parts = []
    for b in range(blocks):
        found, held = scan(b)
        # the first block has a row for each document, the others only their hits
        parts.append(stored(found if b == 0 else found.where(F.size("runs") > 0)).withColumn("block", F.lit(b)))
        held.destroy()
    every = reduce(DataFrame.unionByName, parts)
    # a row found in every block; identical rows count as copies and are given back as often as they came
    met = every.groupBy("id", "key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"), F.sum((F.col("block") == 0).cast("int")).alias("copies"))
    # unite overlapping runs, in order
    united = F.aggregate(
        "runs",
        F.array().cast(T.ArrayType(span)),
        lambda acc, r: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= r["begin"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), F.greatest(F.element_at(acc, -1)["end"], r["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(r))),
    )
    out = met.withColumn("runs", F.when(F.size("runs") > 0, united).otherwise(F.col("runs")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("id", "key", "n_words", "items", "runs")


def hit_words(runs: str = "runs"):
    """Number of words in an array of runs."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["begin"])


def is_contaminated(n_hit, n_words):
    """A document is contaminated when at least a twentieth of its words is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def remove_runs(text: bytes | None, runs: list[tuple[int, int]]) -> bytes | None:
    """The text without the bytes from the first to the last word of each run."""
    if not text or not runs:
        return text
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, last = [], 0
    for a, b in runs:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def without_spans(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(id, text) with every hit span cut out of the text; for corpora that keep the rest of a document.

    Null stays null.  Rows are joined on the id and a hash of id and text, so ids may repeat
    or be null, and repeated rows give repeated results.
    """
    runs = _overlap(docs, windows, id_col, text_col, block_windows).where(F.size("runs") > 0).dropDuplicates(["id", "key"]).select(F.col("id").alias("rid"), F.col("key").alias("rkey"), "runs")
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[id_col], docs[text_col]).alias("key"))
    both = src.join(runs, (F.col("key") == F.col("rkey")) & F.col("id").eqNullSafe(F.col("rid")), "left").select("id", "text", "runs")
    schema = T.StructType([both.schema["id"], both.schema["text"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [remove_runs(t, [(r["begin"], r["end"]) for r in rs or []]) for t, rs in zip(utf8(batch.column(1)), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "text"])

    return both.mapInArrow(run, schema)
