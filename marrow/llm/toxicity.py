"""Toxicity by compression distance.

Two dictionaries are trained by zstandard's own trainer, one on toxic and one on ordinary
text.  A document is cut in windows of a few words; each window is compressed with either
dictionary, and the saving of the toxic one over the ordinary one (in bytes) is the
window's distance.  A document's largest savings, and how many windows save one, two and
three bytes, are weighed by a logistic fit on labelled rows that didn't train the
dictionaries (FOLDS folds take turns); the score is 0.7 where the rows of that fit
show FALSE_ALARMS of the ordinary ones above it.

The trainer keeps what is frequent, which in either class is the language itself.  It is
therefore given the stretches of class text that are markedly more frequent there
(likelihood ratio over five-byte grams), document by document.  Every window starts with
one anchor that both dictionaries hold, so that each frame has a sequence section and a
short match already counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marrow.llm.common import utf8

#: Labelled rows of each class that the model may use.
SAMPLE_PER_LABEL = 2400
WINDOW_WORDS = 4
#: Size of a dictionary, and of the segments and grams that its training weighs.
DICTIONARY_BYTES, SEGMENT, TRAINED_GRAM = 4096, 32, 6
#: Every row of the fit is scored with dictionaries that the other folds trained.
FOLDS = 4
#: Share of ordinary rows above a score of 0.7.
FALSE_ALARMS = 0.005
GRAM = 5
ANCHOR = bytes(range(1, 32))
#: A window longer than this (words without blanks) is cut in pieces of PIECE bytes.
LONGEST_WINDOW, PIECE = 256, 64


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # intercept first


def _windows(text: bytes | None, words: int = WINDOW_WORDS) -> list[bytes]:
    w = text.lower().split() if text else []
    out = []
    for i in range(0, len(w), words):
        x = b" ".join(w[i : i + words])
        out += [x] if len(x) <= LONGEST_WINDOW else [x[k : k + PIECE] for k in range(0, len(x), PIECE)]
    return [ANCHOR + b" " + x + b" " for x in out]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters(window_log=15, hash_log=14, chain_log=14, search_log=5, min_match=3, target_length=16, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


#: Values of _features.
FEATURES = 10


def _features(text: bytes | None, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> list[float]:
    """The four largest savings; logs of how many windows save 1, 2 and 3 bytes or more; shares of 2 and 1; log of the windows (-1: none)."""
    ws = _windows(text)
    a, b = toxic.compress, ordinary.compress
    saved = sorted((len(b(x)) - len(a(x)) for x in ws), reverse=True)
    many = [sum(x >= k for x in saved) for k in (1, 2, 3)]
    n = max(1, len(ws))
    return [*([max(0, x) for x in saved[:4]] + [0] * 4)[:4], *map(math.log1p, many), many[1] / n, many[0] / n, math.log(n) if ws else -1.0]


def _grams(word: bytes) -> list[bytes]:
    return [word[i : i + GRAM] for i in range(max(1, len(word) - GRAM + 1))]


def _presence(texts: list[bytes]) -> Counter:
    found: Counter = Counter()
    for t in texts:
        found.update({g for w in set(t.lower().split()) for g in _grams(b" " + w + b" ")})
    return found


def _loglik(k: float, n: float, p: float) -> float:
    return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if k < n else 0.0)


def _typical(own: Counter, n: int, other: Counter, m: int, ratio: float = 8, least: float = 12) -> set[bytes]:
    """Grams whose document rate is ``ratio`` times that of the other class, with a likelihood ratio of ``least``."""
    out = set()
    for g, a in own.items():
        b = other.get(g, 0)
        if a >= 5 and a / n >= ratio * (b + 0.5) / m:
            p = (a + b) / (n + m)
            if 2 * (_loglik(a, n, a / n) + _loglik(b, m, b / m) - _loglik(a, n, p) - _loglik(b, m, p)) >= least:
                out.add(g)
    return out


def _stretches(word: bytes, keep: set[bytes]) -> bytes:
    """The stretches of a word that typical grams cover."""
    w = b" " + word + b" "
    gs = _grams(w)
    out, i = [], 0
    while i < len(gs):
        j = i
        while j < len(gs) and gs[j] in keep:
            j += 1
        if j > i:
            out.append(w[i : j - 1 + GRAM])
        i = j + 1
    return b"".join(out)


def _dictionary(texts: list[bytes], keep: set[bytes]) -> bytes:
    """Trained by zstandard on one sample for each document; of too few samples to train on, the samples themselves."""
    seen: dict[bytes, bytes] = {}
    samples = []
    for t in texts:
        words = t.lower().split()
        for w in set(words).difference(seen):
            seen[w] = _stretches(w, keep)
        x = b"".join(map(seen.__getitem__, words))[:DICTIONARY_BYTES]
        if x:
            samples.append(x)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT, d=TRAINED_GRAM).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionaries(toxic: list[bytes], plain: list[bytes], own: Counter, other: Counter) -> tuple[bytes, bytes]:
    """Of texts and their grams' document counts."""
    return _dictionary(toxic, _typical(own, len(toxic), other, len(plain))), _dictionary(plain, _typical(other, len(plain), own, len(toxic)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 5.0) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def _table(texts: list[bytes], toxic: bytes, ordinary: bytes) -> np.ndarray:
    a, b = _compressor(toxic), _compressor(ordinary)
    return np.array([_features(t, a, b) for t in texts], dtype=float).reshape(-1, FEATURES)


def train(sample: list[tuple[int, str]]) -> ToxicityModel | None:
    """Fit on bounded labelled rows (label, text); None where a class has fewer than FOLDS."""
    toxic = [t.encode() for x, t in sample if x == 1]
    plain = [t.encode() for x, t in sample if x == 0]
    if min(len(toxic), len(plain)) < FOLDS:
        return None
    folds = [[c[k::FOLDS] for c in (toxic, plain)] for k in range(FOLDS)]
    found = [[_presence(c) for c in fold] for fold in folds]
    total = [sum((f[c] for f in found), Counter()) for c in (0, 1)]
    xs, ys = [], []
    for k, fold in enumerate(folds):
        rest = [[t for j, f in enumerate(folds) if j != k for t in f[c]] for c in (0, 1)]
        xs.append(_table(fold[0] + fold[1], *_dictionaries(*rest, *(total[c] - found[k][c] for c in (0, 1)))))
        ys.append(np.r_[np.ones(len(fold[0])), np.zeros(len(fold[1]))])
    x, y = np.concatenate(xs), np.concatenate(ys)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - mean) / spread, y)
    z = np.c_[np.ones(len(x)), (x - mean) / spread] @ w
    edge = np.quantile(z[y == 0], 1 - FALSE_ALARMS, method="higher") + 1e-6
    slopes = w[1:] / spread
    return ToxicityModel(*_dictionaries(toxic, plain, *total), (float(w[0] - slopes @ mean - edge + math.log(0.7 / 0.3)), *map(float, slopes)))


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), top_saving (bytes), n_windows.

    Whole texts are scored, one row at a time, so a task holds one batch.  A null or empty
    text has no windows and gets the score of a document without savings; without a model
    (an empty class) the score is 0.  Repeated rows give repeated results; other columns
    are not read, so their names can't clash.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("top_saving", T.LongType()), T.StructField("n_windows", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is not None:
            ca, cb, w = _compressor(model.toxic), _compressor(model.ordinary), np.array(model.weights)
        for batch in batches:
            if model is None:
                f, p = np.zeros((batch.num_rows, FEATURES)), np.zeros(batch.num_rows)
                n = np.zeros(batch.num_rows)
            else:
                f = np.array([_features(t, ca, cb) for t in utf8(batch.column(1))], dtype=float).reshape(-1, FEATURES)
                p = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(f)), f] @ w, -30, 30)))
                n = np.rint(np.exp(f[:, -1])) * (f[:, -1] >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(f[:, 0].astype("int64")), pa.array(np.asarray(n, "int64"))], ["id", "score", "top_saving", "n_windows"])

    return src.mapInArrow(run, schema)
