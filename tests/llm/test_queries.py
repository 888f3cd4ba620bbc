"""Registered corpus queries against their SQL, and accuracy where there is none."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from marrow.llm import decontaminate, langid, linededup
from marrow.llm.queries import ORACLES, QUERIES, train_langid
from tests.compare import DATA, check, connect

SF = DATA.replace("sf0.001", "sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    check(spark, connect(), QUERIES[name], ORACLES[name])


def test_toxicity_held_out(spark):
    r = QUERIES["op1_toxicity"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = r.where("held_out").join(labels, "doc_id").collect()
    toxic = [x for x in rows if x["toxic"] == 1]
    plain = [x for x in rows if x["toxic"] == 0]
    # a third of some 400 labels train and test here; see the README for larger tables
    assert sum(x["predicted"] for x in toxic) / len(toxic) > 0.5
    assert sum(x["predicted"] for x in plain) / len(plain) < 0.03
    assert r.where("score < 0 or score > 1 or score is null").count() == 0
    assert r.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_langid_held_out(spark):
    r = QUERIES["op5_langid"](spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = r.where("held_out").join(lang, "doc_id").collect()
    assert len(rows) > 150
    assert sum(x["lang"] == x["lang_pred"] for x in rows) / len(rows) > 0.98


def test_urls(spark):
    r = QUERIES["op6_urls"](spark, SF).toPandas()
    assert set(r.verdict) == {"allow", "block"} and r.rule.isna().any()
    assert (r[r.rule == "net/es/"].verdict == "block").all() and (r[r.rule == "com/"].verdict == "allow").all()


def test_sentencepiece_round_trip(spark):
    r = QUERIES["op3_sentencepiece"](spark, SF)
    assert r.where("not exact").count() == 0


def _brute_language(docs):
    """Ids that stay: a letter, and a best language at least as likely as all others together over EVIDENCE_BYTES."""
    model = train_langid(docs)
    stay = set()
    for r in docs.collect():
        t = (r["text"] or "").encode()
        if not any(map(str.isalpha, t.decode())):
            continue
        bits = model.bits([t])[0]
        gap = (bits - bits.min()) / len(t) * min(len(t), langid.EVIDENCE_BYTES)
        if 1 / (2.0 ** -gap).sum() >= corpus_pipeline.LEAST_LANG_SCORE:
            stay.add(r["doc_id"])
    return stay


def _brute_contaminated(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for t in items:
        w = words(t)
        n = min(decontaminate.WINDOW, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[n].add(tuple(w[k : k + n]))
    bad = set()
    for i, t in docs:
        w = words(t)
        hit = {k + j for n, own in windows.items() for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in own for j in range(n)}
        if hit and 20 * len(hit) >= len(w):
            bad.add(i)
    return bad


def _brute_sets(docs):
    """Smallest id of each class of shingle sets at SIMILARITY or more."""
    n = corpus_pipeline.SHINGLE
    sets = {}
    for i, t in docs:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= corpus_pipeline.SIMILARITY * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_pipeline(spark):
    """Every stage against a brute-force version on its own input."""
    from tests.llm.test_operators import brute_lines, brute_near

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        given = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        out = stage(spark, docs, DATA).toPandas()
        text = dict(zip(out.doc_id, out.text))
        if name != "SentencePiece":
            assert list(out.columns) == list(corpus_pipeline.COLUMNS) and out.n_chars.notna().all()
        if name == "language ID":
            assert set(text) == _brute_language(docs)
        elif name == "line dedup":
            want = {i: t for i, t in brute_lines(given, linededup.RUN_WORDS).items() if t == dict(given)[i] or re.search(r"[^\x20\x09-\x0D]", t)}
            assert text == want and len(want) < len(given)
        elif name == "SimHash near-dedup":
            prints, sets = brute_near(dict(given), corpus_pipeline.SHINGLE, corpus_pipeline.DISTANCE), _brute_sets(given)
            assert set(text) == {i for i, _ in given if prints[i] == i and sets[i] == i}
        elif name == "benchmark decontamination":
            assert set(text) == {i for i, _ in given} - _brute_contaminated(given, items)
        else:
            assert text == dict(given) and out.exact.all()
        docs = spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long") if name != "SentencePiece" else docs
    assert corpus_pipeline.run(spark, DATA).count() == len(out)
