"""Spelling variants: words one edit apart, each led to its commonest neighbour.

Words are counted in tasks first.  Frequent ones are compared densely: the remainders of a
block's words stand in padded code-point matrices, one aligned left and one right, and the
matrices of a block are compared row by row with each other.  Two words whose common
prefix and common suffix together reach the longer length minus one are one edit apart.

Blocks are dealt exactly.  If t has L code points and s is one edit away and no longer,
the edit lies in the first half of t, and they share the last L - L//2 code points, or
behind it, and they share the first L//2.  So each word goes to the blocks of both halves,
for its own length and the next.  What lies between the shared prefix and suffix is the
remainder; a block of over BLOCK words is dealt anew by the halves of its remainder, which
ends at remainders of one code point, so no block grows with the number of words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.llm.common import checkpointed, small_side, stored

#: Most words of a block, and cells compared at once.
BLOCK, CELLS = 2048, 4_000_000
#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 400_000
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5


def _counted(ids: list, texts: list[bytes | None], least_length: int, noise: int | None, into: Counter) -> Iterator[Counter]:
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)
    for i, text in zip(ids, texts):
        if not text:
            continue
        own = Counter(runs.findall(text.lower().decode()))  # of bytes, lower() folds A-Z alone
        seed = zlib.crc32(f"{'' if i is None else i}:".encode())
        for w, n in own.items():
            if noise and not (h := zlib.crc32(w.encode(), seed)) % noise:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
                if len(w) < least_length:
                    continue
            into[w] += n
        if len(into) > HELD_WORDS:
            yield into
            into.clear()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, noise: int | None = None) -> DataFrame:
    """(word, n) of runs of Latin letters of at least ``least_length`` code points, A-Z lower-cased.

    With ``noise``, a run whose crc32 (of id, colon and run) it divides loses the code point
    that crc32 modulo its length names; a run then too short goes.  A null id is written as
    nothing; null texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        as_batch = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for full in _counted(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), least_length, noise, total):
                yield as_batch(full)
        yield as_batch(total)

    src = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_KEY = ["size", "head", "tail", "shared"]


def _halves(word: Column, size: Column, head: Column, tail: Column) -> Column:
    """The two blocks, among words that share ``head`` and ``tail`` code points, that hold what is one edit from ``word`` at longer length ``size``."""
    half = F.floor((size - head - tail) / 2).cast("int")
    first = F.struct(size.alias("size"), (head + half).alias("head"), tail.alias("tail"))
    last = F.struct(size.alias("size"), head.alias("head"), (size - head - half).alias("tail"))
    return F.array(first, last)


def _dealt(words: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """(word, n, size, head, tail, shared) of all blocks of each word, or of the halves of the blocks in ``at``."""
    if at is None:
        n = F.length("word")
        zero = F.lit(0)
        blocks = F.concat(_halves(F.col("word"), n, zero, zero), _halves(F.col("word"), n + 1, zero, zero))
        rows = words.select("word", "n", F.explode(blocks).alias("b"))
    else:
        rows = at.select("word", "n", F.explode(_halves(F.col("word"), F.col("size"), F.col("head"), F.col("tail"))).alias("b"))
    shared = F.concat(F.substring(F.col("word"), F.lit(1), F.col("b.head")), F.when(F.col("b.tail") > 0, F.right(F.col("word"), F.col("b.tail"))).otherwise(""))
    return rows.select("word", "n", "b.size", "b.head", "b.tail", shared.alias("shared"))


def _blocks(words: DataFrame, block: int) -> DataFrame:
    """One row per block of two to ``block`` words: size, head, tail, shared, words (word, n)."""
    dealt, out = stored(_dealt(words)), None
    while True:
        large = dealt.groupBy(*_KEY).agg(F.count("*").alias("rows")).where((F.col("rows") > block) & (F.col("size") - F.col("head") - F.col("tail") > 1))
        large = checkpointed(large.select(*_KEY))
        n = large.count()
        rest = dealt.join(small_side(large), _KEY, "left_anti") if n else dealt
        out = rest if out is None else out.unionByName(rest)
        if not n:
            return out.groupBy(*_KEY).agg(F.collect_list(F.struct("word", "n")).alias("words")).where(F.size("words") > 1)
        dealt = stored(_dealt(words, dealt.join(small_side(large), _KEY, "left_semi")))


def _tile(left: np.ndarray, right: np.ndarray, long: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, row, row, common prefix) of the pairs one edit apart in blocks of padded remainders (block, row, code point)."""
    r = left.shape[2]
    shape = (left.shape[0], left.shape[1], left.shape[1])
    found = []
    for m, columns in ((left, range(r)), (right, range(r - 1, -1, -1))):
        same, n = np.ones(shape, bool), np.zeros(shape, np.int32 if r > 250 else np.uint8)
        for j in columns:
            same &= m[:, :, None, j] == m[:, None, :, j]
            n += same
        found.append(n)
    hit = found[0] + found[1] >= r - 1
    hit &= (long[:, :, None] | long[:, None, :]) & held[:, :, None] & held[:, None, :] & np.triu(np.ones(shape[1:], bool), 1)
    g, i, j = np.nonzero(hit)
    return g, i, j, found[0][g, i, j]


def _compared(blocks: list[tuple[int, int, int, str, list[str]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of word numbers (counted through all blocks) that are one edit apart, each pair in one block only."""
    first = np.cumsum([0, *(len(b[4]) for b in blocks)])
    kinds: dict[tuple[int, int], list[int]] = {}
    for k, (size, head, tail, _, words) in enumerate(blocks):
        kinds.setdefault((1 << (len(words) - 1).bit_length(), size - head - tail), []).append(k)
    for (m, r), own in sorted(kinds.items()):
        step = max(1, CELLS // (m * m))
        for lo in range(0, len(own), step):
            some = own[lo : lo + step]
            long, held, at, bare = np.zeros(len(some) * m, bool), np.zeros(len(some) * m, bool), np.zeros(len(some) * m, np.int64), []
            behind = np.zeros(len(some), np.int16)
            for x, k in enumerate(some):
                size, head, tail, shared, words = blocks[k]
                rows = slice(x * m, x * m + len(words))
                held[rows], at[rows], long[rows] = True, np.arange(first[k], first[k + 1]), [len(w) == size for w in words]
                bare += [w[head : len(w) - tail].encode("latin-1") for w in words] + [b""] * (m - len(words))
                behind[x] = ord(shared[head]) if tail else -1
            left = np.frombuffer(b"".join([w.ljust(r, b"\0") for w in bare]), np.uint8).reshape(len(some), m, r)
            right = np.frombuffer(b"".join([w.rjust(r, b"\0") for w in bare]), np.uint8).reshape(len(some), m, r)
            g, i, j, prefix = _tile(left, right, long.reshape(-1, m), held.reshape(-1, m))
            longer = np.where(long[g * m + i], i, j)
            both = long[g * m + i] & long[g * m + j]
            # the common prefix goes on into the shared tail: another block has this pair
            further = ~both & (prefix == r - 1) & (left[g, longer, r - 1] == behind[g])
            g, i, j = g[~further], i[~further], j[~further]
            yield at[g * m + i], at[g * m + j]


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) for each two words of a table (word, n) that one inserted, deleted or replaced code point parts, both ways.

    Words are distinct, of Latin letters up to U+00FF and of two code points or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            inner = lists.flatten()
            word, n = inner.field(0), inner.field(1)
            ends = (np.asarray(lists.offsets) - lists.offsets[0].as_py()).tolist()
            plain = word.to_pylist()
            blocks = [(*key, plain[s:e]) for *key, s, e in zip(*(batch.column(c).to_pylist() for c in range(4)), ends, ends[1:])]
            for a, b in _compared(blocks):
                if len(a):
                    x, y = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
                    yield pa.RecordBatch.from_arrays([word.take(x), word.take(y), n.take(y)], ["word", "near", "near_n"])

    blocks = _blocks(words, block)
    return blocks.select(*_KEY, "words").mapInArrow(run, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a table (word, form) whose chains end: each round doubles the steps that a word has gone."""
    at = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("mid"), F.col("root").alias("next"))
        further = checkpointed(at.join(on, at["root"] == on["mid"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        at = further.select("word", "root")
        if further.where("went").isEmpty():
            return at


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, noise: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per word of at least ``least_length`` code points and ``least_count`` occurrences: word, n, n_near, form, form_n, root.

    n_near counts the words one edit away.  form is the commonest of them (of equal ones
    the first in code-point order) if it occurs at least ``factor`` times as often, and
    form_n its count, else both are null; root is the end of the chain of forms, or the
    word itself.  As counts grow along a chain, it ends.  Null and empty texts have no words, whole texts
    are read, repeated rows count each time, and other columns are not read; an empty table
    gives no rows.
    """
    words = stored(count_words(docs, id_col, text_col, least_length, noise).where(F.col("n") >= least_count))
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    enough = F.col("near_n") >= factor * F.col("n")
    found = stored(found.select("word", "n", "n_near", F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n")))
    return found.join(_roots(found.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
