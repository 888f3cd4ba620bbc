"""Corpus operators against brute force, and on edge rows."""

import gzip
import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marrow.llm import chat, decontaminate, graph, hosts, langid, linededup, nearcopies, quality, sentencepieces, simhash, toxicity, warc
from marrow.llm.queries import PIECE_MODEL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, score string, label string"
LONG = ("a long text, that goes on. " * 40_000)[:1_000_000]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names that operators use."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "some text here"), (4, "word"), (5, LONG), (6, "same text as before"), (6, "same text as before"), (7, "same text as before"), (8, "<|x|> ▁ \u3000 \x00 é 漢字 🎉"), (9, "x" * 3000)]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None, None, "clash", 1, "s", "l") for i, t in rows], SCHEMA)


def both(spark, df):
    """The table and an empty one of its schema."""
    return [df, df.limit(0)]


# --- toxicity ------------------------------------------------------------------------


def _toxic_sample(n=120):
    r = random.Random(5)
    words = ["".join(r.choice("aeiourstlnm") for _ in range(r.randint(3, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(60)]
        if i % 3 == 0:
            for k in (7, 30):
                w[k] = r.choice(["horridous", "vilegrub", "badmoth"])
        rows.append((int(i % 3 == 0), " ".join(w)))
    return rows


def test_toxicity(spark, edge):
    m = toxicity.train(_toxic_sample())
    assert b"vilegrub" in m.toxic and b"vilegrub" not in m.ordinary
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(_toxic_sample())], "doc_id long, text string")
    s = {r["id"]: r["score"] for r in toxicity.score(d, m).collect()}
    hit = sum((s[i] >= 0.7) == (i % 3 == 0) for i in s)
    assert hit / len(s) > 0.95
    for x in both(spark, edge):
        got = toxicity.score(x, m).collect()
        assert len(got) == x.count() and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in toxicity.score(edge.where("doc_id in (1, 2, 3)"), m).collect()}
    assert len(empty) == 1
    assert toxicity.train([(0, "a")]) is None
    assert {r["score"] for r in toxicity.score(edge, None).collect()} == {0.0}


def test_toxicity_distance_brute_force():
    """Savings are differences of whole frames, compressed with zstandard from scratch for each window."""
    import zstandard

    m = toxicity.train(_toxic_sample())
    text = _toxic_sample()[0][1].encode()
    lengths = []
    for content in (m.ordinary, m.toxic):
        d = zstandard.ZstdCompressionDict(content + toxicity.ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words = text.lower().split()
        frames = []
        for i in range(0, len(words), toxicity.WINDOW_WORDS):
            c = toxicity._compressor(content)
            x = toxicity.ANCHOR + b" " + b" ".join(words[i : i + toxicity.WINDOW_WORDS]) + b" "
            frames.append(c.compress(x))
            assert zstandard.ZstdDecompressor(dict_data=d).decompress(frames[-1], max_output_size=1 << 16) == x
        lengths.append([len(x) for x in frames])
    saved = sorted((a - b for a, b in zip(*lengths)), reverse=True)
    got = toxicity._features(text, toxicity._compressor(m.toxic), toxicity._compressor(m.ordinary))
    assert got[:4] == [max(0, x) for x in saved[:4]] and got[4] == pytest.approx(math.log1p(sum(x >= 1 for x in saved))) and math.exp(got[-1]) == pytest.approx(len(saved))


def test_toxicity_threshold_is_calibrated():
    """Of ordinary rows that no dictionary has seen about FALSE_ALARMS are above 0.7."""
    m = toxicity.train(_toxic_sample(900))
    fresh = [t.encode() for x, t in _toxic_sample(1800)[900:]]
    labels = [x for x, _ in _toxic_sample(1800)[900:]]
    z = toxicity._table(fresh, m.toxic, m.ordinary) @ m.weights[1:] + m.weights[0]
    hit = [v >= math.log(0.7 / 0.3) for v in z]
    assert sum(h for h, x in zip(hit, labels) if x == 0) / labels.count(0) <= 0.03
    assert sum(h for h, x in zip(hit, labels) if x == 1) / labels.count(1) >= 0.95


def test_toxicity_windows_cover_long_words():
    ws = toxicity._windows(b"a b c d " + b"x" * 3000)
    assert sum(w.count(b"x") for w in ws) == 3000 and max(map(len, ws)) < 300


# --- SimHash -------------------------------------------------------------------------


def brute_fp(text, k=3):
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_near(texts, k=3, d=3):
    """Smallest id of each id's class."""
    ids = sorted(texts)
    fp = {i: brute_fp(texts[i], k) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fp[a] ^ fp[b]).bit_count() <= d:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def copies():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = {}
    for g in range(12):
        base = [r.choice(words) for _ in range(150)]
        for c in range(r.choice([1, 2, 9])):
            w = list(base)
            for _ in range(c % 4):
                w[r.randrange(150)] = r.choice(words)
            texts[len(texts) * 3 + g % 2] = " ".join(w)
    return texts


@pytest.mark.parametrize("bucket", [30, 512])
@pytest.mark.parametrize("distance", [0, 3])
def test_simhash_brute_force(spark, copies, bucket, distance):
    d = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    got = {r["id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(d, distance=distance, bucket=bucket).collect()}
    want = brute_near(copies, 3, distance)
    assert got == {i: (brute_fp(t), want[i]) for i, t in copies.items()}


def test_simhash_dense_group(spark):
    """All fingerprints within a few bits of each other: no bucket holds them, no link is lost."""
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    d = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    e = simhash.links(d, 3, bucket=200)
    assert graph.components(e).groupBy("root").count().collect()[0]["count"] == len(fps)
    assert e.count() < 40 * len(fps)


def test_simhash_edges(spark, edge):
    got = {(r["id"], r["component_id"]) for r in simhash.near_duplicates(edge).collect()}
    assert {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)} <= got
    assert simhash.near_duplicates(edge).count() == edge.count()
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near copies ---------------------------------------------------------------------


@pytest.mark.parametrize("block", [4096, 8])
def test_near_copies_brute_force(spark, edge, block):
    """Texts of a shingle similarity near 0.8 link, whatever their fingerprints, and others don't."""
    r = random.Random(8)
    texts, n = {}, 0
    for _ in range(30):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randint(6, 300))]
        for _ in range(r.choice([1, 3, 9])):
            t = list(base)
            for _ in range(r.randint(0, 1 + len(t) // 40)):
                t[r.randrange(len(t))] = f"x{r.randrange(4000)}"
            texts[n] = " ".join(t)
            n += 1
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in texts.items())}
    near = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    fps = {i: simhash.fingerprint_of(t.encode(), 5) for i, t in texts.items()}
    assert sum((fps[i] ^ fps[j]).bit_count() > 3 for i, j in near) > 10
    root = {i: i for i in texts}
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x["id"]: x["component_id"] for x in nearcopies.near_copies(d, block=block).collect()} == root
    assert {x["id"]: x["component_id"] for x in nearcopies.near_copies(d, block=block, hashes=500).collect()} == root
    kept = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, d.selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars"), "").collect()}
    assert not [1 for i, j in near if i in kept and j in kept]
    print_root = brute_near(texts, 5, 3)
    assert kept == {i for i in texts if root[i] == i and print_root[i] == i}
    assert nearcopies.near_copies(edge).count() == edge.count() and nearcopies.near_copies(edge.limit(0)).count() == 0


# --- SentencePiece -------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return sentencepieces.Encoder(sentencepieces.load_vocabulary(PIECE_MODEL))


def _best(e, v, chars):
    scores = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds) if k == "n"}
    best = [0.0] + [-math.inf] * len(chars)
    for i in range(len(chars)):
        for j in range(i + 1, min(len(chars), i + e.longest) + 1):
            if chars[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[chars[i:j]])
        if chars[i] not in scores:
            best[i + 1] = max(best[i + 1], best[i] + e.byte_score * len(chars[i].encode()))
    return best[-1]


def test_pieces_are_the_best_path(encoder):
    v = sentencepieces.load_vocabulary(PIECE_MODEL)
    r = random.Random(1)
    for _ in range(400):
        t = "".join(r.choice("abcdetth  eionr\n\té漢🎉ing the") for _ in range(r.randint(0, 60)))
        ids = encoder.encode(t).tolist()
        assert encoder.decode(ids) == t.encode()
        if t:
            got = sum(encoder.byte_score if v.kinds[i] == "b" else v.scores[i] for i in ids)
            assert got == pytest.approx(_best(encoder, v, (" " + t).replace(" ", "▁")))


def test_lockstep_and_stream_agree(encoder):
    r = random.Random(4)
    spans = ["▁" + "".join(r.choice("thering漢é.,") for _ in range(r.randint(1, 30))) for _ in range(500)]
    assert encoder.lockstep(spans) == [encoder.span(x) for x in spans]


def test_stream_window_is_bounded(encoder):
    window = [0]
    ids = [i for path in encoder.stream("abcdefgthe" * 20_000, window) for i in path]
    assert window[0] <= 6 * encoder.longest and ids[-1][0] < 200_000


def test_sentencepiece_edges(spark, edge):
    v = sentencepieces.load_vocabulary(PIECE_MODEL)
    rows = sentencepieces.round_trip(edge, v, keep_text=True).collect()
    assert sorted((r["id"] or 0, r["decoded"] or "") for r in rows) == sorted((r["doc_id"] or 0, r["text"] or "") for r in edge.collect())
    assert all(r["exact"] for r in rows) and {r["ids"] is None for r in rows if r["id"] == 1} == {True}
    assert sentencepieces.round_trip(edge.limit(0), v).count() == 0


# --- language ID ---------------------------------------------------------------------


def test_ppm_code_lengths(monkeypatch):
    monkeypatch.setattr(langid, "CHUNK_BYTES", 300)
    r = random.Random(3)
    sample = [(lang, "".join(r.choice(al) for _ in range(200))) for lang, al in (("aa", "abc d"), ("bb", "bcée f")) for _ in range(5)]
    m = langid.train(sample)
    texts = [sample[0][1].encode(), ("".join(t for _, t in sample)).encode(), b"", b"zz\xff", "é".encode()]
    bits = m.bits(texts)
    for j, lang in enumerate(m.langs):
        counts = defaultdict(lambda: defaultdict(int))
        for x, t in sample:
            b = t.encode()
            for i in range(len(b)) if x == lang else ():
                for k in range(min(langid.ORDER, i) + 1):
                    counts[b[i - k : i]][b[i]] += 1
        for n, t in enumerate(texts):
            want = 0.0
            for i in range(len(t)):
                for k in range(min(langid.ORDER, i), -1, -1):
                    c = counts.get(t[i - k : i])
                    if c:
                        total = sum(c.values())
                        if t[i] in c:
                            want -= math.log2(c[t[i]] / (total + len(c)))
                            break
                        want -= math.log2(len(c) / (total + len(c)))
                else:
                    want += 8
            assert bits[n, j] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_langid_edges(spark, edge):
    m = langid.train([("en", "some text in english, that goes on and on"), ("xx", "qqq zzz kkk")])
    for x in both(spark, edge):
        assert langid.identify(x, m).count() == x.count()
    got = {r["id"]: r for r in langid.identify(edge, m, keep=("id", "score")).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 5)] == ["und", "und", "und", "en"] and got[5]["keep_id"] == "clash"
    assert {r["lang_pred"] for r in langid.identify(edge, langid.train([])).collect()} == {"und"}
    assert [langid.has_letter(t.encode()) for t in ("½", "²①", "12_", "é", "漢", "x")] == [False, False, False, True, True, True]


def test_labelled_sample_is_fixed(spark):
    """Rows that can't be used don't take a place, an id with two labels or texts has one of each, and the order of rows doesn't matter."""
    from marrow.llm import common

    rows = [(i, f"text {i}" if i % 3 else None, "a" if i % 2 else "b") for i in range(400)] + [(1000, "x" * (common.SAMPLE_CHARS + 1), "a"), (None, "t", "a"), (2001, "t", None)]
    rows += [(3000, "second", "b"), (3000, "first", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = common.labelled_sample(d, 50)
    assert sorted(x for x, _ in got) == ["a"] * 50 + ["b"] * 50 and all(t and len(t) < 100 for _, t in got)
    assert common.labelled_sample(d.orderBy(F.desc("doc_id")).repartition(7), 50) == got
    every = common.labelled_sample(d, 1000)
    assert len(every) == 266 + 1 and ("a", "first") in every
    labels = d.select(F.col("doc_id").alias("id"), "label")
    assert common.labelled_sample(d.select("doc_id", "text"), 50, labels) == got
    assert common.labelled_sample(d.limit(0), 50) == []


# --- URL filters ---------------------------------------------------------------------


def test_host_and_path(spark):
    rows = [("http://A.Example.com/En/x?q#f", "a.example.com", "/En/x"), ("x://h", "h", ""), ("no scheme", "", ""), (None, "", ""), ("a://b://c/d", "b:", "//c/d"), ("http://É.com#x", "É.com", "")]
    d = spark.createDataFrame([(u,) for u, _, _ in rows], "url string")
    assert [tuple(r) for r in d.select(hosts.host_of(F.col("url")), hosts.path_of(F.col("url"))).collect()] == [(h, p) for _, h, p in rows]


def test_pagerank_brute_force(spark):
    r = random.Random(7)
    edges = sorted({(f"h{r.randrange(12)}", f"h{r.randrange(12)}") for _ in range(40)} - {(f"h{i}", f"h{i}") for i in range(12)})
    weights = {e: r.randint(1, 4) for e in edges}
    seeds = {"h0": 3, "h5": 1, "lonely": 2}
    got = {x["host"]: x["rank"] for x in hosts.rank(spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src string, dst string, w long"), spark.createDataFrame(list(seeds.items()), "host string, seed long"), iterations=50, tolerance=1e-9).collect()}
    out = defaultdict(int)
    for (a, _), w in weights.items():
        out[a] += w
    rank = start = {h: n / 6 for h, n in seeds.items()}
    for _ in range(50):
        new = {h: 0.15 * s for h, s in start.items()}
        for (a, b), w in weights.items():
            new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * w / out[a]
        rank = new
    for h in set(rank) | set(got):
        assert got.get(h, 0) / hosts.SCALE == pytest.approx(rank.get(h, 0), abs=1e-6)


def test_url_verdicts(spark):
    pages = [
        (1, "http://good.com/a", '<a href="http://linked.org/x">'),
        (2, "http://bad.net/es/", None),
        (3, "http://linked.org/y", ""),
        (4, "http://shady.org/", "<a HREF='//Bad.net:80/q'> <a href=/rel> <img src=http://u@bad.net/i>"),
        (5, "http://alone.org", ""),
        (6, None, None),
        (7, "http://www.example.com/en/1", ""),
        (8, "http://example.com/en/1", ""),
        (8, "http://example.com/en/1", ""),
        (None, "http://x.com/z", ""),
        (9, "http://x.com", ""),
    ]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    rules = hosts.rule_table(spark, [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")])
    got = [(r["id"], r["rule"], r["verdict"]) for r in hosts.judge(d, rules).collect()]
    assert sorted(got, key=str) == sorted([(1, "com/", "allow"), (2, "net/es/", "block"), (3, None, "allow"), (4, None, "block"), (5, None, "allow"), (6, None, "allow"), (7, "www.example.com/en/", "allow"), (8, "example.com/en/", "block"), (8, "example.com/en/", "block"), (None, "com/", "allow"), (9, None, "allow")], key=str)
    assert hosts.judge(d.limit(0), rules).count() == 0
    # many rules are joined by host instead of one expression
    many = rules.unionByName(hosts.rule_table(spark, [("block", f"no{i}.example/") for i in range(hosts.EXPRESSION_RULES)]))
    assert sorted([(r["id"], r["rule"], r["verdict"]) for r in hosts.judge(d, many).collect()], key=str) == sorted(got, key=str)


def test_hosts_with_ports(spark):
    """A page on a port seeds and is linked by its host; the host column keeps the port."""
    pages = [(1, "http://bad.net:8080/es/", ""), (2, "http://linker.org:99/", "<a href='http://u@bad.net:8080/es/'>"), (3, "http://linker.org/z", ""), (4, "http://other.org", "")]
    rules = hosts.rule_table(spark, [("block", "bad.net:8080/es/")])
    got = {r["id"]: (r["host"], r["verdict"]) for r in hosts.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: ("bad.net:8080", "block"), 2: ("linker.org:99", "block"), 3: ("linker.org", "block"), 4: ("other.org", "allow")}


def test_distant_hosts_are_reached(spark):
    """A chain of 40 links to a blocked host, closed to a circle: distrust goes all the way."""
    n = 40
    pages = [(i, f"http://h{i}.org/", f"<a href='http://h{(i + 1) % n}.org/'>") for i in range(n)]
    got = hosts.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), hosts.rule_table(spark, [("block", "h0.org/")]))
    assert {r["verdict"] for r in got.collect()} == {"block"}


# --- quality -------------------------------------------------------------------------


def test_measures():
    assert quality.measures_of(None) == quality.measures_of(b"") == (0, 0, 0, 0, 0, 0)
    assert quality.measures_of(b"a b c a b c x") == (7, 7, 0, 1, 0, 6)
    assert quality.measures_of("é# é\n\n é# é\né# é".encode()) == (6, 9, 3, 3, 1, 6)
    assert quality.measures_of(b"a a a a") == (4, 4, 0, 1, 0, 4)


def test_sketch_buckets(spark):
    d = spark.range(0, 3_000_000, 997).withColumn("b", quality.bucket_of(F.col("id"))).withColumn("top", quality.bucket_top(F.col("b")))
    assert d.where("top < id or top > id * (1 + 1 / 32D)").count() == 0
    assert d.selectExpr("id", "b", "lag(b) over (order by id) as p").where("p > b").count() == 0


def _quality_rows():
    """Prose with hardly a symbol, tables where every tenth character is one, and one document of each kind in the middle."""
    r = random.Random(1)
    word = lambda tail="": "".join(r.choice("abcdefghij") for _ in range(r.randint(4, 8))) + tail
    text = lambda p: " ".join(word("#" if r.random() < p else "") for _ in range(100))
    middle = text(0.6)
    rows = [(i, text(0.01), "en", "prose") for i in range(150)] + [(200 + i, text(r.uniform(0.3, 0.8)), "en", "tables") for i in range(150)]
    rows += [(400, middle, "en", "prose"), (401, middle, "en", "tables"), (402, text(0).replace(" ", "abcdefgh "), "en", "prose"), (403, " ".join(x[:2] for x in text(0).split()), "en", "prose")]
    return rows + [(404, middle, "en", "small")]


def test_quality_fences_follow_the_group(spark, edge):
    rows = _quality_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {x["id"]: x for x in quality.judge(d).collect()}
    assert all(out[i]["kept"] for i in range(150)) and all(out[200 + i]["kept"] for i in range(150))
    # the same text is odd in one group and usual in the other; too long and too short words both go
    assert not out[400]["kept"] and out[401]["kept"] and not out[402]["kept"] and not out[403]["kept"]
    assert out[400]["n_symbols"] == out[401]["n_symbols"]
    for r in ("symbols", "word_length"):
        assert out[400][f"fence_{r}"] != out[401][f"fence_{r}"]
    # a small group goes by its language: both sources together
    assert out[400]["fence_symbols"] < out[404]["fence_symbols"] and out[404]["kept"]
    for x in both(spark, edge):
        assert quality.judge(x).count() == x.count()


def test_symbol_fences_come_from_each_group(spark):
    """Groups of clean text with a twelfth of junk: its level, not a constant, places the fence; clean documents stay, junk goes."""
    r = random.Random(6)
    word = lambda tail="": "".join(r.choice("abcdefghij") for _ in range(r.randint(4, 8))) + tail
    text = lambda tail: " ".join(word(tail) for _ in range(100))
    tails = {"a": "#", "b": "###", "c": "####&&&&"}
    rows = [(1000 * k + i, text(tail if i % 12 == 0 else ""), "en", s) for k, (s, tail) in enumerate(tails.items()) for i in range(240)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(x["kept"] == (x["id"] % 1000 % 12 > 0) for x in out)
    assert len({x["fence_symbols"] for x in out}) == 3 and "symbols" not in quality.LEAST_WIDTH


def test_quality_fences_brute_force(spark):
    rows = _quality_rows()
    out = {x["id"]: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    ratio = {"symbols": lambda m: m[2] * 10**6 // m[1], "dup_lines": lambda m: m[4] * 10**6 // max(m[3], 1), "repeats": lambda m: m[5] * 10**6 // m[0], "word_length": lambda m: m[1] * 1000 // m[0]}
    for source in ("prose", "tables", "small"):
        own = [quality.measures_of(t.encode()) for _, t, _, s in rows if s == source or source == "small"]
        for rule, (p, q, factor) in quality.FENCES.items():
            v = sorted(ratio[rule](m) for m in own)
            lo, hi = (v[-(-len(v) * k // 100) - 1] for k in (p, q))
            some = sorted(x for x in v if x)
            least = some[-(-len(some) * quality.SOME[rule][0] // 100) - 1] // quality.SOME[rule][1] if rule in quality.SOME else quality.LEAST_WIDTH[rule]
            want = hi + max(factor * (hi - lo), least)
            got = next(x[f"fence_{rule}"] for x in out.values() for r in rows if r[0] == x["id"] and r[3] == source)
            assert abs(got - want) <= (factor + 1) * (hi + lo) / 32 + 1, (source, rule)


# --- WARC ----------------------------------------------------------------------------


def _pages(spark):
    big = "<p>é" + "x" * 1200
    rows = [(1, "http://a/", big), (2, "http://b/", big), (5, "http://c/", big), (5, "http://d/", big), (3, None, None), (4, "http://e\r\nX: y", ""), (6, "http://f/", "small"), (7, "http://g/", "small"), (None, "http://h/", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def test_warc_round_trip(spark, tmp_path):
    p = _pages(spark)
    path = f"file://{tmp_path}/w"
    warc.archive(p.repartition(3), path)
    (tmp_path / "w/part-orphan.warc.gz").write_bytes(b"left by a lost attempt")
    got = warc.read_warc(spark, path).collect()
    assert sorted((r["record_id"], r["record_type"], r["refers_to"], bytes(r["payload"]).decode()) for r in got if r["record_type"] == "revisit") == [("urn:page:1", "revisit", "urn:page:5", ""), ("urn:page:2", "revisit", "urn:page:5", "")]
    full = sorted(bytes(r["payload"]).decode() for r in got if r["record_type"] == "response")
    big = "<p>é" + "x" * 1200
    assert full == sorted([big, big, big, "", "", "small", "small"])
    few = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit' and target_uri like 'http://b%'")
    assert [r["record_id"] for r in few.collect()] == ["urn:page:2"] and "Filter (" not in few._jdf.queryExecution().executedPlan().toString()
    empty = f"file://{tmp_path}/none"
    warc.archive(p.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_skips_payloads():
    import io

    rows = [{"record_id": f"urn:page:{i}", "record_type": "response", "target_uri": "u", "payload_digest": "d", "payload_length": 9, "payload": b"payload-%d" % i} for i in range(4)]
    raw = [warc.record_bytes(r, "1970-01-01T00:00:00Z") for r in rows]
    forms = {"own": b"".join(map(warc.gzip_member, raw)), "other": b"".join(map(gzip.compress, raw)), "plain": b"".join(raw)}
    assert gzip.decompress(forms["own"]) == forms["plain"]
    for data in forms.values():
        stats: dict = {}
        got = list(warc.records(io.BytesIO(data), lambda h: h["warc-record-id"].endswith("2>"), True, stats))
        assert [b for _, b in got] == [b"payload-2"] and stats == {"decoded": 1}
        assert len(list(warc.records(io.BytesIO(data), lambda h: True, False))) == 4
    # several records in one member
    data = gzip.compress(b"".join(raw[:3])) + gzip.compress(raw[3])
    for keep in (True, False):
        assert [h["warc-record-id"] for h, _ in warc.records(io.BytesIO(data), lambda h: not h["warc-record-id"].endswith("1>"), keep)] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    assert [b for _, b in warc.records(io.BytesIO(data), lambda h: True, True)] == [b"payload-%d" % i for i in range(4)]


# --- decontamination -----------------------------------------------------------------


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if t else []


@pytest.mark.parametrize(("block", "size"), [(400_000, 40_000_000), (5, 40_000_000), (400_000, 150)])
def test_decontamination_brute_force(spark, edge, block, size):
    r = random.Random(9)
    w = lambda n: " ".join(r.choice(["ab", "cd", "é", "x1", "Yz"]) for _ in range(n))
    items = [(i, t) for i, t in enumerate([w(20), w(14), "ab cd", "É", "", None, "nope nope"])]
    docs = [(i, w(40)) for i in range(60)] + [(60 + i, f"{w(10)}, {t}! {w(9)}") for i, t in items if t] + [(90, None), (91, ""), (92, "ab cd"), (92, "ab cd")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash"))
    windows = decontaminate.item_windows(spark.createDataFrame(items, "item_id long, text string"))
    got = [(x["id"], x["n_words"], x["n"], x["items"]) for x in decontaminate.find_overlap(d, windows, block_windows=block, block_bytes=size).withColumn("n", decontaminate.hit_words()).collect()]
    want = []
    for i, t in docs:
        ws, hit, own = _words(t), set(), set()
        for k, x in items:
            iw = _words(x)
            n = min(13, len(iw))
            for a in range(len(iw) - n + 1 if n else 0):
                for b in range(len(ws) - n + 1):
                    if ws[b : b + n] == iw[a : a + n]:
                        hit.update(range(b, b + n))
                        own.add(k)
        want.append((i, len(ws), len(hit), sorted(own)))
    assert sorted(got) == sorted(want)
    assert decontaminate._blocks(windows, block, size) == (1 if block + size > 40_000_000 + 5 else -(-windows.count() // 5) if block == 5 else -(-windows.agg(F.sum(F.octet_length("window"))).first()[0] // 150))
    for x in both(spark, edge):
        assert decontaminate.find_overlap(x, windows, block_windows=block).count() == x.count()
    assert decontaminate.find_overlap(d, windows.limit(0), block_windows=block).where("size(runs) > 0").count() == 0


def test_spans_are_removed(spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    d = spark.createDataFrame([(1, "Zero. ONE, two - three; four"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {r["id"]: r["text"] for r in decontaminate.without_spans(d, decontaminate.item_windows(items)).collect()}
    assert got == {1: "Zero. ; four", 2: "nothing", 3: None}
    # repeated and null ids, and an item id of another type
    again = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (1, "other"), (None, "x one two three")], "doc_id long, text string")
    short = items.select(F.col("item_id").cast("int").alias("item_id"), "text")
    assert sorted((str(r["id"]), r["text"]) for r in decontaminate.without_spans(again, decontaminate.item_windows(short), block_windows=1).collect()) == [("1", ""), ("1", ""), ("1", "other"), ("None", "x ")]
    assert decontaminate.find_overlap(again.where("text = 'other'"), decontaminate.item_windows(short)).schema["items"].dataType.elementType.simpleString() == "int"


# --- line dedup ----------------------------------------------------------------------


def brute_lines(rows, words):
    G, W = linededup.GRAM, linededup.WINDOW
    docs = []
    for i, t in rows:
        parts = re.split(rf"(?<=[{linededup.ENDS}\n]) ", (t or "").replace("\n", "\n "))
        words_of = [p.split(" ") for p in parts]
        parts = [x for w in words_of for x in ([" ".join(w)] if len(" ".join(w).encode()) <= linededup.LONGEST else [" ".join(w[k : k + linededup.PIECE]) for k in range(0, len(w), linededup.PIECE)])]
        docs.append((i, t, parts, [p.strip(linededup.HANGING) if p.endswith("\n") else p for p in parts]))
    heads, places = {}, []
    for d, (i, _, _, own) in enumerate(docs):
        md5 = [hashlib.md5(x.encode()).hexdigest() for x in own]
        chosen = set()
        for k in range(len(own) - (G + W - 1) + 1):
            low = min(md5[k : k + W])
            chosen |= {j for j in range(k, k + W) if md5[j] == low}
        for j in sorted(chosen):
            heads.setdefault(tuple(own[j : j + G]), (d, j))
            places.append((d, j))
    cut = defaultdict(set)
    for d, j in places:
        own = docs[d][3]
        e, h = heads[tuple(own[j : j + G])]
        other = docs[e][3]
        if (d, j) == (e, h):
            continue
        left = right = 0
        while left < linededup.REACH and min(j, h) > left and own[j - left - 1] == other[h - left - 1]:
            left += 1
        while right < linededup.REACH and max(j + G + right - len(own), h + G + right - len(other)) < 0 and own[j + G + right] == other[h + G + right]:
            right += 1
        if d != e or j - left > h + G - 1 + right:
            cut[d].update(range(j - left, j + G + right))
    for d, found in cut.items():  # matched lines with GAP others between them at most are a chain
        chains = []
        for k in sorted(found):
            if not chains or k - chains[-1][-1] > linededup.GAP + 1:
                chains.append([])
            chains[-1].append(k)
        cut[d] = {k for c in chains if sum(docs[d][3][k].count(" ") + 1 for k in c) >= words for k in c}
    return {i: None if t is None else " ".join(p for k, p in enumerate(parts) if k not in cut[d]).replace("\n ", "\n") for d, (i, t, parts, _) in enumerate(docs)}


@pytest.mark.parametrize("words", [4, 12])
def test_line_dedup_brute_force(spark, words):
    r = random.Random(words)
    line = lambda: " ".join(r.choice("abcr") for _ in range(r.randint(1, 6)))
    common = [line() for _ in range(8)]
    rows = []
    for i in range(80):
        t = "".join((line() if r.random() < 0.4 else ", ".join(common[k : k + 6])) + r.choice(["\n", ". ", "\n\n", "! ", "\r\n", ".  "]) for k in (r.randrange(8) for _ in range(r.randint(1, 12))))
        rows.append((i, t))
    rows += [(80, None), (81, ""), (82, "\n\n"), (83, "one \uffff " + rows[3][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = {x["id"]: x["text"] for x in linededup.dedup_lines(d, words=words).collect()}
    assert got == brute_lines(rows, words)
    assert sum(got[i] != t for i, t in rows) > 20


def test_long_runs_go_wherever_they_start(spark):
    """The guarantee: of a run of RUN_LINES lines nothing but the broken lines at its ends stays."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeionstr") for _ in range(r.randint(2, 7)))
    text = lambda n: [word() + r.choice(["", "", "", "", ",", "."]) for _ in range(n)]
    passage, rows = text(60), []
    for i in range(30):
        w = text(80)
        k = r.randrange(80)
        rows.append((i, " ".join(w[:k] + passage + w[k:])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["id"]: x["text"] for x in linededup.dedup_lines(d).collect()}
    lines = re.split(rf"(?<=[{linededup.ENDS}]) ", " ".join(passage))
    assert len(lines) >= linededup.RUN_LINES + 2 and got[0] == rows[0][1]
    for i, t in rows[1:]:
        assert not any(x in got[i] for x in lines[1:-1] if len(x) > 12)
        assert 80 <= len(got[i].split()) <= 80 + len(lines[0].split()) + len(lines[-1].split())


def test_passage_in_a_paragraph(spark):
    passage = "This passage has many words in it, and it goes on for a while. It then says a few more things that nobody would say twice by chance! And so it ends, after more than fifty words in all, which is what the rule asks of a passage that is to go from later texts, is it? Yes."
    rows = [(1, f"First text starts. {passage} And goes on"), (2, f"Another one without a stop {passage} The end"), (3, "A clean text. With two sentences.")]
    got = {r["id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert "few more things" not in got[2] and got[2].startswith("Another one without a stop") and got[2].endswith("The end")


def test_runs_of_short_lines_and_of_mixed_origin(spark):
    """A passage of one-word lines, and one whose every three lines also stand, apart, in earlier texts."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeionst") for _ in range(r.randint(3, 7)))
    shout = " ".join(word().upper() + "!!" for _ in range(60))
    rows = [(1, f"{word()} begins here. {shout} ends"), (2, f"{word()} goes on. {shout} and so forth")]
    lines = [" ".join(word() for _ in range(4)) + "." for _ in range(40)]
    rows += [(10 + k, " ".join(f"{word()} {word()}." for _ in range(8)) + " " + " ".join(lines[k : k + 3]) + " " + " ".join(f"{word()} {word()}." for _ in range(8))) for k in range(38)]
    rows += [(50, f"{word()} then " + "same " * 70 + "end"), (51, "same " * 90), (52, f"{word()} {word()} " + "same " * 20)]
    rows += [(90, f"Own words. {' '.join(lines)} More words."), (91, f"Other words. {' '.join(lines)} Last words.")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["id"]: x["text"] for x in linededup.dedup_lines(d).collect()}
    assert got == brute_lines(rows, linededup.RUN_WORDS)
    assert got[1] == rows[0][1] and len(got[2].split()) < 12
    assert all(got[i] == t for i, t in rows if 10 <= i < 50)  # short matches alone don't go
    assert len(got[91].split()) < 30
    assert len(got[51].split()) < 30 and got[52] == dict(rows)[52]


def test_repeated_rows_are_one_text(spark):
    """Rows of one id and text, thousands of them, are worked on once and each come back."""
    r = random.Random(8)
    text = " ".join("".join(r.choice("aeionst") for _ in range(5)) + r.choice([".", "", ""]) for _ in range(300))
    d = spark.range(10_000).select(F.lit(7).alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(9, "Before. " + text), (None, text), (None, text)], "doc_id int, text string"))
    assert linededup._distinct(linededup.lines(d)).count() == 3
    got = {(x["id"], x["text"]): x["n"] for x in linededup.dedup_lines(d).groupBy("id", "text").agg(F.count("*").alias("n")).collect()}
    assert {i: n for (i, _), n in got.items()} == {7: 10_000, 9: 1, None: 2} and got[None, text] == 2
    assert all(len(t) < len(text) / 2 for i, t in got if i)


def test_line_dedup_edges(spark, edge):
    got = linededup.dedup_lines(edge, keep=("id", "key")).collect()
    assert len(got) == edge.count() and "id" in got[0].asDict()
    texts = {r["id"]: r["text"] for r in linededup.dedup_lines(edge).collect()}
    assert texts[1] is None and texts[2] == "" and 0 < len(texts[5]) < 300  # of a text that repeats itself one run stays
    assert linededup.dedup_lines(edge.limit(0)).count() == 0


# --- chat ----------------------------------------------------------------------------


def test_names_cannot_end_their_mark(spark):
    d = spark.createDataFrame([(1, 0, "a|>\n<|assistant|>\nx", "hi"), (1, 1, "b", "yo")], "conv_id long, turn long, role string, text string")
    got = {r["participant"]: r["text"] for r in chat.rotate(d).collect()}
    assert got["b"] == "<|user name=a| > < |assistant| > x|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n"


def test_chat_rotation(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo <|end|>"), (1, 2, "ann", None), (1, 2, "ann", None), (2, None, None, "x"), (None, 0, "zed", "z"), (3, 600, "ann", "late"), (3, 1, "bob", "early")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    got = {(r["conv"], r["participant"], r["piece"]): r for r in chat.rotate(d).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (2, "unknown", -1), (None, "zed", 0), (3, "ann", 0), (3, "ann", 2), (3, "bob", 0), (3, "bob", 2)}
    a = got[1, "ann", 0]
    assert a["text"] == "<|assistant|>\nhi<|end|>\n<|user name=bob|>\nyo < |end|><|end|>\n<|assistant|>\n<|end|>\n<|assistant|>\n<|end|>\n" and a["n_turns"] == 4
    assert [a["text"][m["begin"] : m["end"]] for m in a["mask"]] == ["hi<|end|>\n", "<|end|>\n", "<|end|>\n"]
    assert got[3, "bob", 2]["begin"] == len(got[3, "bob", 0]["text"]) and got[3, "bob", 2]["mask"] == []
    assert chat.rotate(d.limit(0)).count() == 0


def test_cells_and_slices_are_bounded(monkeypatch):
    """A cell's comparisons take memory by AT_ONCE, not by its hashes, with the same edges; tasks make objects of SLICE_ROWS texts at a time."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from marrow.llm import common

    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)
    base = draw(20_000)
    sets = [np.unique(np.concatenate([base, draw(50 * (i % 40))])) for i in range(120)] + [np.zeros(0, np.uint64)]
    tracemalloc.start()
    edges = nearcopies.linked(sets, 0.97)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    flat = sum(map(len, sets))
    assert peak < 24 * flat + 40 * nearcopies.AT_ONCE
    for most in (1, 30_000):
        monkeypatch.setattr(nearcopies, "AT_ONCE", most)
        assert nearcopies.linked(sets, 0.97) == edges and edges
    batch = pa.RecordBatch.from_arrays([pa.array(range(1201))], ["id"])
    parts = list(common.slices([batch, batch.slice(0, 0)]))
    assert [x.num_rows for x in common.slices([batch], sentencepieces.TEXTS)] == [250] * 4 + [201]
    assert [x.num_rows for x in parts] == [500, 500, 201] and pa.Table.from_batches(parts).column(0).to_pylist() == list(range(1201))


def test_langid_training_is_bounded():
    """Training takes memory by parts of the sample, not ten numbers and more for each byte of a language."""
    import tracemalloc

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(1000)]
    tracemalloc.start()
    model = langid.train([("en", t) for t in texts])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(map(len, texts))
    whole = langid.CHUNK_BYTES
    try:
        langid.CHUNK_BYTES = 1 << 40
        once = langid.train([("en", t) for t in texts])
    finally:
        langid.CHUNK_BYTES = whole
    assert (model.cost == once.cost).all() and (model.escape == once.escape).all() and (model.root == once.root).all()


def test_components_plan_each_round_once(spark, monkeypatch):
    """A round's edges come from one plan; a union of it with itself made the driver plan and run each part twice."""
    plans, kept = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    got = graph.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"))
    assert got.count() == 10 and len(plans) > 2 and not any("Union" in p for p in plans)
