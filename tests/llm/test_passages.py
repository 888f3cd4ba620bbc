"""Multiple-instance quality model: features and attention by brute force, gradients by differences, held-out accuracy."""

import math
import random

import numpy as np
import pytest

from marrow.llm import passages
from marrow.llm.queries import QUERIES
from tests.compare import DATA
from tests.llm.test_operators import both, edge  # noqa: F401


def _feature(x):
    """The features of one passage, byte by byte."""
    out = np.zeros(passages.WIDTH)
    for a, b in zip(x, x[1:]):
        out[passages.CLASS[a] * passages.KINDS + passages.CLASS[b]] += 1 / (len(x) - 1)
    out[:-4] = np.sqrt(out[:-4])
    w = x.split()
    out[-4] = len(set(w)) / max(1, len(w))
    out[-3] = sum(a == b for a, b in zip(w, w[1:])) / max(1, len(w))
    out[-2], out[-1] = math.log1p(len(w)) / 4, not w
    return out


def _texts():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeéß#|A.") for _ in range(r.randint(1, 9)))
    return [b"", b" ", b"x", ("éa " * 200).encode(), *(" ".join(word() for _ in range(n)).encode() for n in (3, 40, 300)), b"y" * 1000]


def _brute_score(m, text):
    h, e = [], []
    for k in range(0, max(1, len(text)), passages.PASSAGE):
        v = np.tanh(_feature(text[k : k + passages.PASSAGE]) @ m.W + m.b)
        h.append(v)
        e.append((np.tanh(v @ m.V) / (1 + np.exp(-(v @ m.U)))) @ m.w)
    a = np.exp(e) / np.exp(e).sum()
    return 1 / (1 + math.exp(-(sum(x * v for x, v in zip(a, h)) @ m.c + m.d[0])))


@pytest.mark.parametrize("together", [1, 3, 4096])
def test_scores_brute_force(monkeypatch, together):
    monkeypatch.setattr(passages, "TOGETHER", together)
    m = passages.AttentionModel(5)
    p, many, top = m.score(_texts())
    assert p == pytest.approx([_brute_score(m, t) for t in _texts()], abs=1e-5)
    assert many.tolist() == [max(1, -(-len(t) // passages.PASSAGE)) for t in _texts()]
    assert all(0 < a <= 1 + 1e-6 for a in top) and top[0] == 1


def test_gradients_by_differences():
    r = np.random.default_rng(0)
    m = passages.AttentionModel(3, width=6)
    for k in m.NAMES:
        setattr(m, k, getattr(m, k).astype(float))
    x, many, y = r.normal(size=(9, 6)), np.array([1, 5, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p, _, _ = m.documents(*m.passages(x), many)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in m.gradients(x, many, y).items():
        v = getattr(m, name)
        for at in [*np.ndindex(v.shape)][:12]:
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            assert g[at] == pytest.approx((up - loss()) / 2e-6, abs=1e-6)
            v[at] = old


def test_attention_finds_the_passage_that_decides():
    """Only one passage of each bad document is bad; its weight is learned from documents' labels."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeiourstlnm") for _ in range(r.randint(3, 9)))
    sample = []
    for k in range(160):
        parts = [" ".join(word() for _ in range(60))[: passages.PASSAGE].ljust(passages.PASSAGE) for _ in range(5)]
        if k % 2:
            parts[k % 5] = ("###| " * 100)[: passages.PASSAGE]
        sample.append((1 - k % 2, "".join(parts)))
    m = passages.train(sample[:120])
    for k in range(120, 160):
        y, t = sample[k]
        x = passages.features(t.encode(), np.full(5, passages.PASSAGE))
        h, e = m.passages(x)
        p, a, _ = m.documents(h, e, np.array([5]))
        assert (p[0] >= 0.5) == y
        assert y or a.argmax() == k % 5


def test_held_out(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    r = QUERIES["op11_quality"](spark, sf)
    rows = r.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    assert len(rows) > 80 and sum(x["predicted"] == x["quality"] for x in rows) / len(rows) > 0.97
    assert r.where("score < 0 or score > 1 or score is null").count() == 0
    assert r.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_edges(spark, edge):  # noqa: F811
    m = passages.AttentionModel(5)
    for x in both(spark, edge):
        got = passages.score(x, m).collect()
        assert len(got) == x.count() and all(0 <= r["score"] <= 1 for r in got)
        assert {r["score"] for r in passages.score(x, None).collect()} <= {0.5}
    of = {r["id"]: r["score"] for r in passages.score(edge.where("doc_id in (1, 2, 6)"), m).collect()}
    assert of[1] == of[2] and len(of) == 3
    assert passages.train([(1, "a")]) is None and passages.train([]) is None
