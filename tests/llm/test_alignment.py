"""Alignment of tokenizers against both libraries, text by text."""

import bisect
import hashlib
from collections import Counter, defaultdict

import pytest

from marrow.llm import alignment
from marrow.llm.queries import BYTE_MODEL, PIECE_MODEL, QUERIES
from tests.compare import DATA
from tests.llm.test_operators import SCHEMA, edge  # noqa: F401


@pytest.fixture(scope="module")
def pair():
    return alignment.load_pair(BYTE_MODEL, PIECE_MODEL)


def brute(rows, pair):
    """Measures of (doc_id, text) rows, every text encoded whole by the two libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_str(pair.a), sentencepiece.SentencePieceProcessor(model_proto=pair.b)
    a.encode_special_tokens = True
    out_a = alignment.ByteLevel(pair.a).out
    out_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    done, counts = [], Counter()
    for i, text in rows:
        links, groups, x, y = [], [], [], []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            want = (" " + text).encode()
            if b"".join(out_a[k] for k in x) != want or b"".join(out_b[k] for k in y) != want:
                x, y = [], []
        ends = [defaultdict(list), defaultdict(list)]
        for out, ids, e in ((out_a, x, ends[0]), (out_b, y, ends[1])):
            at = 0
            for k in ids:
                at += len(out[k])
                e[at].append(k)
        both = sorted(set(ends[0]) & set(ends[1]))
        parts = [[[] for _ in both] for _ in ends]
        for e, own in zip(ends, parts):
            for at, ids in e.items():
                own[bisect.bisect_left(both, at)] += map(str, ids)
        for at, p, q in zip(both, *parts):
            links += [(k, m) for k in ends[0][at] for m in ends[1][at]]
            groups.append(",".join(p) + "|" + ",".join(q))
        counts.update(links)
        done.append((i, len(x), len(y), len(both), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, q), n in counts.items():
        most[q] = max(most[q], n)
    return sorted(((i, na, nb, ng, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if na else "") for i, na, nb, ng, ls, g in done), key=repr)


def test_query_brute_force(spark, pair):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_alignment"](spark, DATA).collect()), key=repr)
    assert got == brute(rows, pair)


def test_joined_table_gives_the_same(spark, pair):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a, b = (alignment.align(docs, pair, table_bytes=n) for n in (1 << 30, -1))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (a, b)]
    assert "MapInArrow" in plans[0] and "MapInArrow" not in plans[1]
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_edges(spark, edge, pair, monkeypatch):  # noqa: F811
    odd = [(20, " leading and  double  blanks "), (21, "\n line\nbreaks \n and\ttabs \t"), (22, "<|endoftext|> and <s> </s> <unk> <0x41>"), (23, "a▁b"), (24, "combining ́ mark   no-break 　 wide"), (25, "don't we'll I'm 12345 3.14 ... !!! ???"), (26, "漢字 and 🎉🎉 emoji"), (27, "a b"), (28, "  ​ x"), (29, "naïve ﬁ ² Ǆ"), (30, "\x00 \x7f \x80"), (31, "  "), (32, "\n")]
    df = edge.unionByName(spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in odd], SCHEMA))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute(rows, pair)
    assert sorted(map(tuple, alignment.align(df, pair).collect()), key=repr) == want
    assert {r[0]: r[1] for r in want}[23] == 0
    monkeypatch.setattr(alignment, "MEMO", 1)
    monkeypatch.setattr(alignment, "STEP_CHARS", 10)
    monkeypatch.setattr(alignment, "STEP_LINKS", 1)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 2)
    assert sorted(map(tuple, alignment.align(df, pair).collect()), key=repr) == want
    assert alignment.align(df.limit(0), pair).count() == 0
    texts = {r["id"]: r["groups"] for r in alignment.align(df, pair, groups="text").collect()}
    assert hashlib.sha256(texts[27].encode()).hexdigest() == [r for r in want if r[0] == 27][0][-1] and texts[1] == ""
    assert "groups" not in alignment.align(df, pair, groups=None).columns


def test_other_library_gives_the_same_ids(pair):
    a = alignment.ByteLevel(pair.a)
    for t in (" don't stop", " \n\n x  y", " ﬁ ² 漢字 🎉", " " + "ab" * 5000):
        assert a.fast is not None and a.encode(t).tolist() == a.encode(t, long=True).tolist()
