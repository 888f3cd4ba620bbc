"""Language ID by prediction by partial matching (PPM).

For each language a variable-order byte context tree is counted on a bounded sample and
then frozen.  A byte's code length is that of PPM with escape method C: in the longest
context seen, count/(total+distinct), or the escape distinct/(total+distinct) and on to
the next shorter context, down to 1/256.  The language with the shortest code wins.

As statistics are frozen, the code length of a gram (context and byte) in every language
is worked out once, with all its escapes.  Scoring a byte is then a lookup of its longest
gram in one table of all languages; only where no language has seen that gram does it
add each language's escape cost and look up the next shorter one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marrow.llm.common import broadcast_object, HashIndex, slices, utf8

#: Sample rows for each language (the bound of the model's size).
SAMPLE_PER_LANG = 400
#: Longest context in bytes; at most 6, so that a gram fits in 56 bits.
ORDER = 4
CHUNK_BYTES = 1 << 18
#: Bytes whose evidence counts for the score.
EVIDENCE_BYTES = 40
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _grams(data: np.ndarray, within: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For k = 1, 2 ..: at t the k bytes that end there, tagged with k (0 where the text is shorter); one k is held at a time."""
    b = data.astype(np.uint64)
    g = b.copy()
    for k in range(1, longest + 1):
        if k > 1:
            g[k - 1 :] |= b[: len(b) - k + 1] << np.uint64(8 * (k - 1))
        x = g | np.uint64(k << 56)
        x[within < k - 1] = 0
        yield x


class PpmModel:
    """Frozen code lengths: an index of gram keys, rows of bits for each language."""

    def __init__(self, langs: list[str], keys: np.ndarray, cost: np.ndarray, escape: np.ndarray, root: np.ndarray, order: int):
        self.langs, self.order, self.root = langs, order, root.astype(np.float32)
        self.find = HashIndex(keys).find
        self.cost, self.escape = cost.astype(np.float32, copy=False), escape.astype(np.float32, copy=False)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each whole text in each language; long texts go in chunks."""
        n, L, K = len(texts), len(self.langs), self.order + 1
        total = np.zeros((n, L))
        starts = np.zeros(n + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=starts[1:])
        data = np.frombuffer(b"".join(texts), np.uint8)
        step = max(1 << 14, CHUNK_BYTES * 4 // max(4, L))
        for lo in range(0, len(data), step):
            hi, back = min(len(data), lo + step), max(0, lo - K)
            pos = np.arange(back, hi)
            doc = np.searchsorted(starts, pos, side="right") - 1
            within = pos - starts[doc]
            grams = list(_grams(data[back:hi], within, K))
            cut = lo - back
            doc, within = doc[cut:], within[cut:]
            here = np.arange(hi - lo)
            open_at = here[:0]
            for k in range(K, 0, -1):
                fresh = here if k == K and not (within < K - 1).any() else here[np.minimum(within + 1, K) == k]
                open_at = np.concatenate([open_at, fresh]) if len(open_at) else fresh
                row = self.find(grams[k - 1][cut + open_at])
                hit = row >= 0
                self._add(total, doc[open_at[hit]], self.cost[row[hit]])
                open_at = open_at[~hit]
                if not len(open_at):
                    continue
                if k > 1:
                    ctx = self.find(grams[k - 2][cut + open_at - 1])
                    seen = ctx >= 0
                    self._add(total, doc[open_at[seen]], self.escape[ctx[seen]])
                else:
                    total += np.bincount(doc[open_at], minlength=n)[:, None] * (self.root.astype(float) + 8.0)
        return total

    def _add(self, total: np.ndarray, doc: np.ndarray, rows: np.ndarray) -> None:
        for j in range(rows.shape[1]):
            total[:, j] += np.bincount(doc, weights=rows[:, j], minlength=len(total))


def _bounded(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in parts of CHUNK_BYTES bytes or one text."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK_BYTES:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of several counts, and their sums."""
    grams, at = np.unique(np.concatenate([u for u, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(grams)).astype(np.int64)


def train(sample: list[tuple[str, str]], order: int = ORDER) -> PpmModel | None:
    """Count and freeze the trees of a bounded sample of rows (language, text); None without rows."""
    by: dict[str, list[bytes]] = {}
    for lang, text in sample:
        if text:
            by.setdefault(lang, []).append(text.encode())
    langs = sorted(by)
    if not langs:
        return None
    K, L = order + 1, len(langs)
    counted: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(K)]
    for lang in langs:
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(K)]
        for texts in _bounded(by[lang]):
            data = np.frombuffer(b"".join(texts), np.uint8)
            size = np.array([len(t) for t in texts])
            within = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
            for k, g in enumerate(_grams(data, within, K)):
                found[k].append(np.unique(g[g != 0], return_counts=True))
        for k in range(K):
            counted[k].append(_merged(found[k]))
    keys, cost, escape, base = [], [], [], 0
    before_keys, before_cost, before_escape, root = np.zeros(0, np.uint64), np.zeros((0, L)), np.zeros((0, L)), np.zeros(L)
    for k in range(1, K + 1):
        own = np.unique(np.concatenate([u for u, _ in counted[k - 1]]))
        body = own & np.uint64((1 << 56) - 1)
        ctx_of = (body >> np.uint64(8)) | np.uint64((k - 1) << 56)
        tail = (body & np.uint64((1 << (8 * (k - 1))) - 1)) | np.uint64((k - 1) << 56)
        bits = np.zeros((len(own), L))
        esc_here = np.zeros((len(before_keys) if k > 1 else 1, L))
        for j in range(L):
            u, c = counted[k - 1][j]
            n = np.zeros(len(own))
            n[np.searchsorted(own, u)] = c
            at = np.searchsorted(before_keys, ctx_of) if k > 1 else np.zeros(len(own), np.int64)
            size = len(before_keys) if k > 1 else 1
            total = np.bincount(at, weights=n, minlength=size)
            distinct = np.bincount(at, weights=n > 0, minlength=size)
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                seen = -np.log2(n / (total + distinct)[at])
            shorter = before_cost[np.searchsorted(before_keys, tail), j] if k > 1 else np.full(len(own), 8.0)
            bits[:, j] = np.where(n > 0, seen, esc[at] + shorter)
            esc_here[:, j] = esc
        if k == 1:
            root = esc_here[0]
        else:
            escape[-1] = esc_here.astype(np.float32)
        counted[k - 1] = []
        keys.append(own)
        cost.append(bits.astype(np.float32))  # the model keeps no more digits
        escape.append(np.zeros((len(own), L), np.float32))
        before_keys, before_cost = own, bits
    return PpmModel(langs, np.concatenate(keys), np.concatenate(cost), np.concatenate(escape), root, order)


def has_letter(text: bytes | None) -> bool:
    """Has the text a character of a letter category?  (Digits and fractions in other scripts have none.)"""
    return bool(text) and bool(_ASCII_LETTER.search(text) or any(map(str.isalpha, text.decode("utf-8", "replace"))))


def identify(docs: DataFrame, model: PpmModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1), bits_per_byte of the winner, and the columns ``keep`` as keep_*.

    Null texts and texts without a letter (so empty ones, too) get ``und`` and score 0, as
    does every text without a model.  Equal code lengths fall to the first language by
    name.  Repeated rows give repeated results; other columns are not read.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *(docs[c].alias(f"keep_{c}") for c in keep))
    schema = T.StructType([src.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType()), *src.schema.fields[2:]])
    names = schema.names
    held = broadcast_object(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held()
        for batch in slices(batches):
            texts = utf8(batch.column(1))
            ok = np.array([m is not None and has_letter(t) for t in texts], bool)
            lang, score, per = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if ok.any():
                own = [t for t, x in zip(texts, ok) if x]
                size = np.array([len(t) for t in own], float)
                bits = m.bits(own)
                best = bits.argmin(1)
                gap = (bits - bits.min(1, keepdims=True)) / size[:, None] * np.minimum(size, EVIDENCE_BYTES)[:, None]
                score[ok] = 1 / np.exp2(-np.minimum(gap, 500)).sum(1)
                per[ok] = bits.min(1) / size
                for i, b in zip(np.flatnonzero(ok), best):
                    lang[i] = m.langs[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(per), *batch.columns[2:]], names)

    return src.mapInArrow(run, schema)
