"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes, and only the document has a label.  Every
passage is encoded (counts of byte-class pairs and measures of repetition, through a
learned layer), a learned gate gives it a weight, weights are normalised over the document,
and the weighted mean of its passages' codes is scored:

    h = tanh(x W + b)    e = (tanh(h V) * sigmoid(h U)) w    a = softmax of e over the document
    score = sigmoid(sum(a h) c + d)

All of it is fitted at once by gradient steps on documents' labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marrow.llm.common import broadcast_object, utf8

#: Labelled rows of each label that the model may use (with the bounds of labelled_sample on rows, characters and length).
SAMPLE_PER_LABEL = 800
#: Bytes of a passage; passages encoded together; bytes of texts scored together (a longer text alone).
PASSAGE, TOGETHER, STEP_BYTES = 256, 4096, 1 << 22
#: Size of a passage's code and of the gate.
CODE, GATE = 16, 8
EPOCHS, BATCH, RATE, DECAY = 16, 48, 0.01, 1e-4

#: Bytes told apart alone; the others fall into the ranges below.
_SINGLE = " \n\t.,!?|#$%&*<>:;-_/'\"()"
_RANGES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.int64)  # 0: any other byte
    for k, chars in enumerate([*_SINGLE, *_RANGES], 1):
        kind[list(chars.encode())] = k
    last = kind.max()
    kind[0x80:0xC0], kind[0xC0:0xE0], kind[0xE0:] = last + 1, last + 2, last + 3
    return kind


CLASS = _classes()
KINDS = int(CLASS.max()) + 1
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
MEASURES = 4
WIDTH = KINDS * KINDS + MEASURES


def cut(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts joined, the lengths of all passages, and how many passages each text has (an empty one has one, empty)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    many = np.maximum(1, -(-sizes // PASSAGE))
    lengths = np.full(many.sum(), PASSAGE, np.int64)
    lengths[np.cumsum(many) - 1] = sizes - (many - 1) * PASSAGE
    return b"".join(texts), lengths, many


def features(data: bytes | memoryview, lengths: np.ndarray) -> np.ndarray:
    """One row per passage: roots of shares of byte-class pairs; share of distinct words and of words like the one before, log of words, 1 if none.

    A passage's features depend on its own bytes only.
    """
    n, d = len(lengths), np.frombuffer(data, np.uint8)
    of = np.repeat(np.arange(n), lengths)
    out = np.zeros((n, WIDTH), np.float32)
    if len(d):
        kind = CLASS[d]
        key = of * (KINDS * KINDS) + kind * KINDS
        inside = of[1:] == of[:-1]
        pairs = np.bincount((key[:-1] + kind[1:])[inside], minlength=n * KINDS * KINDS).reshape(n, -1)
        np.sqrt(pairs / np.maximum(1, lengths - 1)[:, None], out=out[:, : KINDS * KINDS], casting="unsafe")
        own = np.flatnonzero(~_WHITE[d])
        first = np.ones(len(own), bool)
        first[1:] = (np.diff(own) > 1) | (of[own[1:]] != of[own[:-1]])
        starts = np.flatnonzero(first)
        words = np.bincount(of[own[starts]], minlength=n)
        if len(starts):
            place = np.arange(len(own)) - starts[np.cumsum(first) - 1]
            h = np.add.reduceat((d[own].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63], starts)
            h ^= h >> np.uint64(31)
            h *= _POWERS[0]
            at = of[own[starts]].astype(np.uint64)
            like = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
            held = np.sort((at << np.uint64(48)) | (h >> np.uint64(16)))
            new = np.r_[True, held[1:] != held[:-1]]
            distinct = np.bincount((held[new] >> np.uint64(48)).astype(np.int64), minlength=n)
            repeated = np.bincount(at[1:][like].astype(np.int64), minlength=n)
            some = np.maximum(1, words)
            out[:, -4], out[:, -3] = distinct / some, repeated / some
        out[:, -2], out[:, -1] = np.log1p(words) / 4, words == 0
    else:
        out[:, -1] = 1
    return out


def _encoded(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Features of all passages of texts, TOGETHER passages at a time."""
    data, lengths, _ = cut(texts)
    at = np.concatenate([[0], np.cumsum(lengths)])
    for lo in range(0, len(lengths), TOGETHER):
        hi = min(len(lengths), lo + TOGETHER)
        yield features(memoryview(data)[at[lo] : at[hi]], lengths[lo:hi])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Weights W, b (passage code), V, U, w (gate), c, d (score of a document)."""

    NAMES = ("W", "b", "V", "U", "w", "c", "d")

    def __init__(self, seed: int = 11, width: int = WIDTH):
        r = np.random.default_rng(seed)
        part = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.W, self.b = part(width, CODE), np.zeros(CODE, np.float32)
        self.V, self.U, self.w = part(CODE, GATE), part(CODE, GATE), part(GATE)
        self.c, self.d = part(CODE), np.zeros(1, np.float32)

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code and attention logit of each passage."""
        h = np.tanh(x @ self.W + self.b)
        return h, (np.tanh(h @ self.V) * _sigmoid(h @ self.U)) @ self.w

    @staticmethod
    def weights(e: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Attention of each passage, summing to 1 in each document."""
        first = np.cumsum(many) - many
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), many))
        return a / np.repeat(np.add.reduceat(a, first), many)

    def documents(self, h: np.ndarray, e: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, attention weights and weighted code of documents with ``many`` passages each."""
        a = self.weights(e, many)
        z = np.add.reduceat(a[:, None] * h, np.cumsum(many) - many)
        return _sigmoid(z @ self.c + self.d), a, z

    def gradients(self, x: np.ndarray, many: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of documents."""
        h = np.tanh(x @ self.W + self.b)
        t, s = np.tanh(h @ self.V), _sigmoid(h @ self.U)
        p, a, z = self.documents(h, (t * s) @ self.w, many)
        out = (p - y) / len(y)
        per = np.repeat(out, many)
        toward = h @ self.c
        e = per * a * (toward - np.repeat(z @ self.c, many))
        gate = e[:, None] * self.w
        gt, gs = gate * s * (1 - t * t), gate * t * s * (1 - s)
        gh = (per * a)[:, None] * self.c + gt @ self.V.T + gs @ self.U.T
        gx = gh * (1 - h * h)
        return {"W": x.T @ gx, "b": gx.sum(0), "V": h.T @ gt, "U": h.T @ gs, "w": (t * s).T @ e, "c": z.T @ out, "d": out.sum(keepdims=True)}

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, number of passages and largest attention weight of each text."""
        _, _, many = cut([b""] if not texts else texts)
        parts = [self.passages(x) for x in _encoded(texts)]
        h, e = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        p, a, _ = self.documents(h, e, many)
        return p, many, np.maximum.reduceat(a, np.cumsum(many) - many)


def train(sample: list[tuple[int, str]], seed: int = 11) -> AttentionModel | None:
    """Fit on bounded labelled rows (label, text); None where a label has no row."""
    if {0, 1} - {y for y, _ in sample}:
        return None
    texts, y = [t.encode() for _, t in sample], np.array([y for y, _ in sample], np.float32)
    xs = [np.concatenate([f.astype(np.float16) for f in _encoded([t])]) for t in texts]
    model, r = AttentionModel(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(getattr(model, k)) for k in model.NAMES}
    square = {k: np.zeros_like(getattr(model, k)) for k in model.NAMES}
    step = 0
    for _ in range(EPOCHS):
        order = r.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            own = order[lo : lo + BATCH]
            many = np.array([len(xs[k]) for k in own])
            step += 1
            for k, g in model.gradients(np.concatenate([xs[k] for k in own]).astype(np.float32), many, y[own]).items():
                v = getattr(model, k)
                g = g.astype(np.float32) + DECAY * v
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                v -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return model


def score(docs: DataFrame, model: AttentionModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), n_passages, attention (the largest weight of a passage).

    Every passage of the whole text is encoded.  A null or empty text is one empty passage.
    Without a model (a label without rows) the score is 0.5.  Repeated rows give repeated
    results; other columns are not read, so their names can't clash.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType()), T.StructField("attention", T.DoubleType())])
    held = broadcast_object(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held()
        for batch in batches:
            texts, lo = [t or b"" for t in utf8(batch.column(1))], 0
            sizes = np.array([len(t) for t in texts])
            while lo < len(texts):
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:]), STEP_BYTES)))
                some = texts[lo:hi]
                if own is None:
                    _, _, many = cut(some)
                    p, top = np.full(len(some), 0.5), 1 / many
                else:
                    p, many, top = own.score(some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(np.asarray(v, k)) for v, k in ((p, float), (many, np.int64), (top, float)))], schema.names)
                lo = hi

    return src.mapInArrow(run, schema)
