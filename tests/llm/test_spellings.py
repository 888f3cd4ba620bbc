"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from marrow.llm import spellings
from marrow.llm.queries import QUERIES
from tests.compare import DATA
from tests.llm.test_operators import both, edge  # noqa: F401


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    return a != b and len(a) - len(b) <= 1 and any(a[:i] + a[i + 1 :] == (b[:i] + b[i + 1 :] if len(a) == len(b) else b) for i in range(len(a)))


def brute(rows, least_length=6, least_count=5, factor=5, noise=199):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            if noise:
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if h % noise == 0:
                    w = "".join(c for k, c in enumerate(w) if k != h % len(w))
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least_length and k >= least_count}
    # words that share the pattern with one code point left out are one edit apart, or one is it
    near = {w: set() for w in n}
    holes = {}
    for w in n:
        for k in range(len(w)):
            holes.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    for w in n:
        for k in range(len(w)):
            cut = w[:k] + w[k + 1 :]
            near[w] |= {x for x in holes[cut] | ({cut} & n.keys()) | holes.get(w, set()) if one_edit(w, x)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_query_brute_force(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(r[3] is not None for r in want) > 20
    assert got(QUERIES["op13_spellings"](spark, sf)) == want


@pytest.mark.parametrize("block", [2, 8, 2048])
def test_dense_words(spark, block):
    """Few letters and short words, so that nearly all are near each other and edits are ambiguous; blocks are dealt anew."""
    r = random.Random(3)
    words = ["".join(r.choice("aabß") for _ in range(r.randint(3, 7))) for _ in range(900)]
    rows = [(k, " ".join(r.choice(words) for _ in range(60))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ours = spellings.group_spellings(df, least_length=3, least_count=2, factor=2, noise=7, block=block)
    assert got(ours) == brute(rows, 3, 2, 2, 7)


def test_chains_ties_and_repeats(spark):
    text = " ".join(["letters"] * 150 + ["lettters"] * 30 + ["letttters"] * 6 + ["letterr"] * 150 + ["Naïveté", "naïvete"] * 5 + ["naÏveté"] * 5)
    rows = [(1, text), (1, text), (None, text), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = {x["word"]: x for x in spellings.group_spellings(df).collect()}
    assert (r["letttters"]["form"], r["letttters"]["root"]) == ("lettters", "letters")
    assert r["letters"]["form"] is None and r["letters"]["n"] == 450 and r["letters"]["n_near"] == 2
    assert r["naÏveté"]["n_near"] == 1 and r["naïvete"]["form"] is None
    assert got(spellings.group_spellings(df)) == brute(rows, noise=None)


def test_edges(spark, edge, monkeypatch):  # noqa: F811
    monkeypatch.setattr(spellings, "HELD_WORDS", 2)
    long = spark.createDataFrame([(i, "x" * 300_000 + " " + "x" * 300_001) for i in range(5)], "doc_id long, text string")
    assert [(len(r["word"]), r["n_near"]) for r in spellings.group_spellings(long).orderBy("word").collect()] == [(300_000, 1), (300_001, 1)]
    for x in both(spark, edge):
        rows = [(r["doc_id"], r["text"]) for r in x.collect()]
        assert got(spellings.group_spellings(x, noise=3)) == brute(rows, noise=3)
