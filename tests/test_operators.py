"""Golden values, properties and edge rows."""

import json

import pytest
from pyspark.sql import functions as F

from marrow.functions import canonical_label, clean_text, content_key, cut_tokens, n_tokens
from marrow.operators import curate, debias, directions, errors, parse, prompts, retrieve, runs, sample, score, select, vote

MATRICES = {
    "3B": ((801, 77, 122, 0), (95, 780, 125, 0), (273, 134, 593, 0)),
    "8B": ((885, 28, 48, 39), (139, 778, 73, 10), (326, 123, 534, 17)),
    "14B": ((855, 43, 62, 40), (95, 801, 93, 11), (272, 77, 628, 23)),
    "32B": ((808, 41, 74, 77), (89, 785, 100, 26), (224, 83, 655, 38)),
}
STRICT = {"3B": (0.7247, 0.7222), "8B": (0.7323, 0.7350), "14B": (0.7613, 0.7693), "32B": (0.7493, 0.7669)}
VALID = {"3B": (0.7247, 0.7222), "8B": (0.7488, 0.7429), "14B": (0.7806, 0.7787), "32B": (0.7863, 0.7853)}
CLASSES = ("bug", "feature", "question", "invalid")


@pytest.fixture(scope="module")
def matrix(spark):
    cells = [(run, CLASSES[t], CLASSES[p], n) for run, m in MATRICES.items() for t, row in enumerate(m) for p, n in enumerate(row) if n]
    return spark.createDataFrame(cells, "run string, ground_truth string, predicted_label string, n int").withColumn("i", F.explode(F.sequence(F.lit(1), "n")))


def test_golden_scores(matrix):
    for f, want in ((score.evaluate_strict, STRICT), (score.evaluate_valid, VALID)):
        got = {r["run"]: (r["accuracy"], r["f1_macro"]) for r in f(matrix, ["run"]).collect()}
        assert got == want
    c = {(r["run"], r["truth"]): r for r in score.confusion(matrix, ["run"]).collect()}
    assert [c["8B", "bug"][f"n_{x}"] for x in CLASSES] == [885, 28, 48, 39]


def test_scores_of_absent_class(spark):
    d = spark.createDataFrame([("a", "bug", "bug"), ("a", "bug", "nonsense")], "run string, ground_truth string, predicted_label string")
    r = score.evaluate_strict(d, ["run"]).first()
    assert (r["accuracy"], r["f1_question"], r["invalid_count"]) == (0.5, 0.0, 0)
    assert score.evaluate_strict(d.limit(0), ["run"]).count() == 0


@pytest.mark.parametrize(
    ("raw", "label", "via"),
    [
        ("<label>bug</label>", "bug", "xml"),
        ("<label>bug", "invalid", "failed"),
        ("<label>\nquestion\n</label>", "question", "regex"),
        ("<think>maybe <label>bug</label></think><label>question</label>", "question", "xml"),
        ("<think>unfinished bug", "invalid", "failed"),
        ("bug, feature, or question: question", "question", "regex"),
        ("bug, feature, question", "invalid", "failed"),
        ("<label>Bug.</label>", "bug", "xml"),
        ("Feature-Request!", "feature", "regex"),
        ("f-e-a-t", "feature", "regex"),
        ("", "invalid", "failed"),
        (None, "invalid", "failed"),
        ("ERROR: <label>bug</label>", "invalid", "failed"),
    ],
)
def test_parse(spark, raw, label, via):
    r = parse.parse_outputs(spark.createDataFrame([(raw,)], "raw_output string")).first()
    assert (r["predicted_label"], r["parsed_via"]) == (label, via)


def test_clean_and_cut(spark):
    d = spark.createDataFrame([("  a \t b\n c ",), (None,), ("one two, three",)], "t string")
    assert [r[0] for r in d.select(clean_text("t")).collect()] == ["a b c", "", "one two, three"]
    assert [r[0] for r in d.select(cut_tokens("t", F.lit(2))).collect()][2] == "one two..."
    assert [r[0] for r in d.select(n_tokens("t")).collect()] == [4, 0, 4]


def test_conform_items(spark):
    d = spark.createDataFrame([(1, None, "b", " Bug "), (2, "t", None, None)], "item_id long, title string, body string, label string")
    assert [tuple(r) for r in curate.conform_items(d).collect()] == [(1, "", "b", "bug")]
    assert curate.null_labels(d).first()[0] == 1
    with pytest.raises(ValueError, match="body"):
        curate.conform_items(d.drop("body"))


def test_split_partitions_and_no_shared_key(spark):
    d = spark.createDataFrame([(i, f"t{i % 17}", "", "abc"[i % 3]) for i in range(100)], "item_id long, title string, body string, labels string")
    s = sample.head_split(d, fraction=0.3)
    assert s.count() == 100 and {r["labels"]: r["count"] for r in s.where("split = 'test'").groupBy("labels").count().collect()} == {"a": 10, "b": 9, "c": 9}
    train = curate.drop_leaks(s.where("split = 'train'"), s.where("split = 'test'"))
    assert train.join(s.where("split = 'test'").select("title"), "title", "left_semi").count() == 0
    assert [r[0] for r in sample.with_test_idx(s.where("split = 'test'")).orderBy("item_id").select("test_idx").collect()] == list(range(28))
    with pytest.raises(ValueError):
        sample.head_split(d, fraction=1.5)


def test_random_neighbors(spark):
    q, p = (spark.range(n).select(F.col("id").alias("item_id")) for n in (7, 20))
    r = sample.random_neighbors(q, p, 6, [1, 2]).groupBy("seed", "test_id").agg(F.count_distinct("neighbor_id").alias("n")).collect()
    assert len(r) == 14 and {x["n"] for x in r} == {6}
    with pytest.raises(ValueError):
        sample.random_neighbors(q, p, 21, [1])
    with pytest.raises(ValueError):
        sample.random_neighbors(q, p, 0, [1])
    assert sample.random_neighbors(q.limit(0), p, 6, [1]).count() == 0
    whole = sample.random_neighbors(q, p, 20, [3]).groupBy("test_id").agg(F.count_distinct("neighbor_id").alias("n")).collect()
    assert {x["n"] for x in whole} == {20}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 23, 64, 97, 1009, 10_007])
def test_keyed_permutation(spark, n):
    """Every place is met once, for sizes that do and don't fill a rectangle."""
    a, b = sample.permutation_sides(n)
    assert n <= a * b and a * b - n < max(a, 4)
    r = spark.range(n).select(sample.permuted(F.col("id"), n, F.lit(4), F.lit("q")).alias("p")).agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(r) == (n, 0, n - 1)


def test_random_neighbors_are_independent(spark):
    """Chi-square of single draws, of pairs of one query, and of neighbouring queries' draws, over 4,000 queries and a pool of 11."""
    q, p = (spark.range(n).select(F.col("id").alias("item_id")) for n in (4000, 11))
    rows = sample.random_neighbors(q, p, 2, [5]).groupBy("test_id").agg(F.max(F.when(F.col("neighbor_rank") == 0, F.col("neighbor_id"))).alias("a"), F.max(F.when(F.col("neighbor_rank") == 1, F.col("neighbor_id"))).alias("b")).orderBy("test_id").collect()

    def chi(values, cells):
        count = {c: 0 for c in cells}
        for v in values:
            count[v] += 1
        want = len(values) / len(cells)
        return sum((x - want) ** 2 / want for x in count.values())

    ids = range(11)
    a, b = [r["a"] for r in rows], [r["b"] for r in rows]
    # bounds: the 0.999 quantiles for 10, 109 and 120 degrees of freedom
    assert chi(a, ids) < 29.6 and chi(b, ids) < 29.6
    assert chi(list(zip(a, b)), [(x, y) for x in ids for y in ids if x != y]) < 159
    assert chi(list(zip(a, a[1:])), [(x, y) for x in ids for y in ids]) < 173


def _vectors(spark, n, dim=8, seed=3):
    import numpy as np

    v = np.random.default_rng(seed).standard_normal((n, dim))
    v[n // 2] = 0
    v[1] = v[0]
    return spark.createDataFrame([(i, x.tolist(), ("bug", "feature", "question")[i % 3]) for i, x in enumerate(v)], "item_id long, vector array<double>, labels string"), v


def test_knn_blocks_and_ties(spark):
    import numpy as np

    d, v = _vectors(spark, 40)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    want = {i: [j for _, j in sorted((-round(float(u[i] @ u[j]), 12), j) for j in range(40))[:5]] for i in range(40)}
    for block in (100, 7):
        got = {}
        for r in sorted(retrieve.knn_join(d, d.repartition(3), 5, query_block=block).collect(), key=lambda r: r["neighbor_rank"]):
            got.setdefault(r["test_id"], []).append(r["neighbor_id"])
        assert got == want
    assert retrieve.knn_join(d, d.limit(3), 5).groupBy("test_id").count().agg(F.max("count")).first()[0] == 3
    assert retrieve.knn_join(d.limit(0), d, 5).count() == 0


def test_knn_blocks_by_pool(spark):
    """More queries than a block, with pools by size: the same rows as in one block."""
    d, _ = _vectors(spark, 40)
    pools = d.withColumn("pool_size", F.lit(10)).where("item_id < 10").unionByName(d.withColumn("pool_size", F.lit(40)))
    one, many = (sorted(map(tuple, retrieve.knn_sweep(d, pools, 3).collect() if b is None else retrieve.knn_join(d, pools, 3, query_block=b, by="pool_size").collect())) for b in (None, 9))
    assert one == many and len(one) == 240
    assert "BatchEvalPython" not in retrieve.knn_join(d, d, 3, query_block=9)._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [None, 9])
def test_knn_waves(spark, block):
    """A pool in waves gives the same rows, and each later wave gives few candidates, however many tasks it has."""
    d, _ = _vectors(spark, 40)
    pools = _vectors(spark, 1500, seed=5)[0].repartition(30)
    one, many = (sorted(map(tuple, retrieve.knn_join(d, pools, 3, query_block=block, first_wave=w).collect())) for w in (1 << 18, 20))
    assert one == many and len(one) == 120
    waves = retrieve._waves(pools, 1500, 20)
    sizes = [w.count() for w in waves]
    assert sum(sizes) == 1500 and len(sizes) == 4 and sizes[0] < 20 and waves[0].rdd.getNumPartitions() == retrieve.FIRST_TASKS
    both = pools.withColumn("pool_size", F.lit(1500)).unionByName(pools.where("item_id < 300").withColumn("pool_size", F.lit(300)))
    one, many = (sorted(map(tuple, retrieve.knn_join(d, both, 3, query_block=block, by="pool_size", first_wave=w).collect())) for w in (1 << 18, 20))
    assert one == many and len(one) == 240


def test_wave_candidates_are_bounded(spark):
    import numpy as np

    d, v = _vectors(spark, 40)
    pools = _vectors(spark, 4000, seed=5)[0].repartition(50)
    first, *_, last = retrieve._waves(pools, 4000, 100)
    held = retrieve.knn_join(d, first, 3)
    least = {r["test_id"]: r["similarity"] for r in held.where("neighbor_rank = 2").collect()}
    qid = np.arange(40)
    near = retrieve._against_matrix(qid, retrieve._unit(v), retrieve._side(last), 3, None, {None: np.array([least[i] for i in qid])})
    free = retrieve._against_matrix(qid, retrieve._unit(v), retrieve._side(last), 3, None, {})
    n = near.where("test_id <> 20").count()  # all are as near to the zero vector
    assert free.count() > 40 * 3 * 40 and n < 39 * 3 * 4 * 4000 / first.count()


def test_knn_memory_is_that_of_a_tile():
    """What one pool batch takes doesn't grow with the queries, beyond the best held of each; ties, zeros and ids out of order give the same rows."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    p = retrieve._unit(rng.integers(-2, 3, (512, 8)).astype(float))
    ids = rng.permutation(512)
    peaks = []
    for n in (4096, 32768):
        q = retrieve._unit(rng.integers(-2, 3, (n, 8)).astype(float))
        held = retrieve._none(n, 5)
        tracemalloc.start()
        for lo in range(0, 512, 128):
            retrieve._keep(held, q, p[lo : lo + 128], ids[lo : lo + 128])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        s = np.round(q[:300] @ p.T, retrieve.DIGITS)
        want = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :5]
        assert (held[1][:300] == ids[want]).all() and (held[0][:300] == np.take_along_axis(s, want, 1)).all()
    assert peaks[1] < 1.5 * peaks[0] and peaks[1] < 20 * 8 * retrieve.TILE


def test_knn_pools_in_turn(spark):
    """Pools that lie mixed in one task are gone through one after the other: each gives the best of a query once a task."""
    import numpy as np

    d, v = _vectors(spark, 40)
    mixed = d.repartition(1).withColumn("pool", F.col("item_id") % 4)
    near = retrieve._against_matrix(np.arange(40), retrieve._unit(v), retrieve._side(mixed, "pool"), 3, "pool", {})
    assert near.count() == 40 * 3 * 4
    by_one = [tuple(r) for r in retrieve.knn_join(d, mixed.where("pool = 2"), 3).collect()]
    both = retrieve.knn_join(d, mixed, 3, by="pool").where("pool = 2").select("test_id", "neighbor_rank", "neighbor_id", "similarity")
    assert sorted(by_one) == sorted(map(tuple, both.collect()))


def test_too_many_pools(spark):
    d, _ = _vectors(spark, 4)
    pools = spark.range(retrieve.POOLS + 1).select("id", F.array(F.lit(1.0)).alias("vector"), F.col("id").alias("pool_size")).withColumnRenamed("id", "item_id")
    with pytest.raises(ValueError, match="pools"):
        retrieve.knn_join(d, pools, 1, by="pool_size")


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_knn_cells_recall(spark, sf):
    """The registered settings on the given vectors, which have no groups: recall, k rows a query, exact similarities, few pairs scored."""
    e = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    q, p = e.where("item_id % 2 = 0"), e.where("item_id % 2 = 1")
    exact = {(r["test_id"], r["neighbor_id"]): r["similarity"] for r in retrieve.knn_join(q, p, 10).collect()}
    rows = retrieve.knn_cells(q, p, 10, scored=True).collect()
    near = {(r["test_id"], r["neighbor_id"]): r["similarity"] for r in rows}
    assert len(near) == len(exact) and len(exact.keys() & near.keys()) / len(exact) >= 0.9
    assert all(abs(near[k] - exact[k]) < 1e-9 for k in exact.keys() & near.keys())
    assert sum({r["test_id"]: r["n_scored"] for r in rows}.values()) <= q.count() * p.count() / 4


def test_cells_follow_the_vectors(spark):
    """Vectors in groups need few probes and few scored pairs; cells grow with the pool; codes come back near to the vectors."""
    import numpy as np

    r = np.random.default_rng(4)
    middle = r.standard_normal((40, 16))
    v = middle[r.integers(0, 40, 4000)] + r.normal(0, 0.15, (4000, 16))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vector array<double>")
    q, p = d.where("item_id < 300"), d.where("item_id >= 300")
    c = retrieve.fit_cells(q, p, 5)
    assert len(c.centres) == 60 and len(retrieve.fit_cells(q, p.where("item_id < 1300"), 5).centres) == 31
    assert c.probes <= 15 and c.share < 0.05
    u = retrieve._unit(v)
    assert (retrieve.Cells(c.centres, c.books, c.edge, 1, 1.0).thresholds(u) == -np.inf).all() and (c.thresholds(u) > -1).all()
    codes = c.encode(u)
    assert codes.dtype == np.uint8 and codes.shape == (4000, 4) and ((c.decode(codes) - u) ** 2).sum(1).mean() < 0.05
    exact = {(x["test_id"], x["neighbor_id"]) for x in retrieve.knn_join(q, p, 5).collect()}
    rows = retrieve.knn_cells(q, p, 5, scored=True, block=50).collect()
    assert len(rows) == 1500 and len(exact & {(x["test_id"], x["neighbor_id"]) for x in rows}) >= 0.9 * 1500
    assert sum({x["test_id"]: x["n_scored"] for x in rows}.values()) < 0.06 * 300 * 3700


def test_knn_cells_fills_short_lists(spark):
    """One probe into a small cell doesn't give k rows; the exact join gives the rest, also in several blocks of a cell."""
    import numpy as np

    v = np.r_[np.random.default_rng(1).normal(0, 0.01, (60, 4)) + [1, 0, 0, 0], np.random.default_rng(2).normal(0, 0.01, (3, 4)) + [0, 1, 0, 0]]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vector array<double>")
    for block in (7, 1000):
        got = retrieve.knn_cells(d, d, 5, cells=2, probes=1, share=1.0, block=block).groupBy("test_id").agg(F.count("*").alias("n"), F.max("neighbor_rank").alias("r")).collect()
        assert len(got) == 63 and {(r["n"], r["r"]) for r in got} == {(5, 4)}
    assert retrieve.knn_cells(d, d.limit(3), 5).groupBy("test_id").count().where("count <> 3").count() == 0
    assert retrieve.knn_cells(d.limit(0), d, 5).count() == 0 and retrieve.knn_cells(d, d.limit(0), 5).count() == 0


def test_vote_invariants(spark):
    d, _ = _vectors(spark, 60)
    s = sample.head_split(d, fraction=0.5)
    test, train = s.where("split = 'test'"), s.where("split = 'train'")
    n = retrieve.enrich_neighbors(retrieve.knn_join(test, train, 4), test, train, ("labels",))
    v = {(r["scheme"], r["k"], r["test_id"]): r["predicted_label"] for r in vote.vote_sweep(n, [1, 2, 4, 9]).collect()}
    assert {k for _, k, _ in v} == {1, 2, 4}  # 9 is more than there are
    ids = {i for _, _, i in v}
    for i in ids:
        assert len({v[s, 1, i] for s in vote.SCHEMES}) == 1
        assert v["majority", 2, i] == v["majority", 1, i]


def test_debias_keeps_order_and_may_empty(spark):
    rows = [(1, r, x) for r, x in enumerate(["bug", "question", "bug", "feature"])] + [(2, 0, "bug"), (2, 1, "bug")]
    d = spark.createDataFrame(rows, "test_id long, neighbor_rank int, neighbor_label string")
    got = [(r["test_id"], r["neighbor_rank"]) for r in debias.debias(d, 4, 3).orderBy("test_id", "neighbor_rank").collect()]
    assert got == [(1, 1), (1, 3)]
    assert debias.debias_report(d, debias.debias(d, 4, 3), 4).first().asDict() == {"n_items": 2, "n_debiased": 2, "n_zero_shot": 1}
    with pytest.raises(ValueError):
        debias.debias(d, 4, mode="none")


def test_truncation_of_a_short_budget(spark):
    d = spark.createDataFrame([(1, "q title", "w " * 300, r, "n title", "x " * 200, "other") for r in range(2)], "test_id long, test_title string, test_body string, neighbor_rank int, neighbor_title string, neighbor_body string, neighbor_label string")
    r = prompts.truncate_examples(d, 100).first()
    assert r["truncated"] and r["neighbors_truncated"] and r["query_truncated"]
    assert [x["label"] for x in r["near"]] == ["bug", "bug"]
    # 70 tokens for neighbours less 4 of titles, in equal parts
    assert [x["n"] for x in r["near"]] == [35, 35]
    m = json.loads(prompts.truncate_examples(d, 5000).select(prompts.to_messages(prompts.build_prompt())).first()[0])
    assert [x["role"] for x in m] == ["system", "user"] and m[1]["content"].startswith("Here are some examples") and "--- Example 2 ---" in m[1]["content"]


def test_prompt_stats_are_linear(spark):
    d = spark.createDataFrame([(x,) for x in (1, 2, 3, 10)], "n_prompt_tokens long").withColumn("k", F.lit(1))
    assert prompts.prompt_stats(d, ["k"]).first()["p90"] == 7


def test_percentiles_by_digits(spark):
    """Against the built-in, over small and wide ranges, negative values, null keys, one-row groups and several digits."""
    import random

    r = random.Random(2)
    rows = [(g, r.choice([r.randrange(10), r.randrange(-5000, 90_000), r.randrange(1 << 40)])) for g in ("a", "a", "b", None) for _ in range(400)]
    rows += [("one", 7), ("none", None), ("same", 3), ("same", 3), ("low", -(1 << 62)), ("high", 1 << 62)]
    d = spark.createDataFrame(rows, "g string, v long")
    shares = [0.0, 0.33, 0.5, 0.9, 0.99, 1.0]
    for part in (d, d.where("v between 0 and 9"), d.where("g = 'one'")):
        want = {x["g"]: tuple(x)[1:] for x in part.where("v is not null").groupBy("g").agg(*(F.percentile("v", F.lit(x)) for x in shares)).collect()}
        got = {x["g"]: tuple(x)[1:] for x in select.percentiles(part, ["g"], "v", shares).collect()}
        assert got == want
    assert select.percentiles(d.limit(0), ["g"], "v", shares).count() == 0
    assert select.percentiles(spark.range(101), [], "id", [0.25]).first()["p0"] == 25
    plan = select.percentiles(d, ["g"], "v", [0.5])._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_vote_fold_brute_force(spark, seed):
    """All ks and schemes of one pass against votes counted one by one, with ties, negative similarities, synonyms and null labels."""
    import random

    r = random.Random(seed)
    labels = ["bug", "Feature ", "enhancement", "question", "other", None]
    rows = [(q, "bug", k, r.choice([0.5, 0.25, -0.25, 0.125, 0.0]), r.choice(labels)) for q in range(30) for k in range(r.choice([6, 9]))]
    d = spark.createDataFrame(rows, "test_id long, test_label string, neighbor_rank int, similarity double, neighbor_label string")
    named = dict(zip(labels, [x[0] for x in spark.createDataFrame([(x,) for x in labels], "x string").select(canonical_label("x")).collect()]))
    got = {(x["scheme"], x["k"], x["test_id"]): x["predicted_label"] for x in vote.vote_sweep(d, [1, 2, 3, 6, 8], vote.SCHEMES).collect()}
    assert {k for _, k, _ in got} == {1, 2, 3, 6} and len(got) == 3 * 4 * 30
    for (scheme, k, q), label in got.items():
        scores = {}
        for _, _, rank, s, x in sorted((x for x in rows if x[0] == q), key=lambda x: x[2])[:k]:
            scores.setdefault(named[x], 0.0)
            if named[x] is not None:
                scores[named[x]] += {"similarity": s, "shepard": s * s, "majority": 1.0}[scheme]
        assert label == max(scores, key=lambda x: scores[x])
    plan = vote.vote_sweep(d, [1, 2, 3, 6, 8])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2


def test_leak_filter(spark):
    """Same rows as the plain anti join; what the filter clears isn't shuffled; filters merge."""
    d = spark.range(3000).select(F.col("id").alias("item_id"), F.concat(F.lit("t"), F.col("id") % 2000).alias("title"), F.when(F.col("id") % 5 > 0, "b").alias("body"), F.lit("bug").alias("labels"))
    test, train = d.where("item_id < 40"), d.where("item_id >= 40")
    want = {r["item_id"] for r in train.collect()} - {i for i in range(40, 3000) if i % 2000 < 40}
    got = curate.drop_leaks(train, test)
    assert {r["item_id"] for r in got.collect()} == want and got.columns == train.columns
    keys = test.select(content_key("title", "body").alias("key"))
    probed = curate._probed(train.withColumn("key", content_key("title", "body")), keys)
    assert 40 <= probed.where("may_leak").count() < 80
    assert curate.leak_report(d, test).first()["n_leaked"] == 40
    two = [curate.key_filter(keys.where(F.crc32("key") % 2 == k), 16) for k in (0, 1)]
    merged = two[0].unionByName(two[1]).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, curate.key_filter(keys, 16).collect()))
    assert curate.drop_leaks(train, test.limit(0)).count() == train.count() and curate.leak_report(d, test.limit(0)).count() == 0


def test_no_filter_beyond_its_size(spark, monkeypatch):
    monkeypatch.setattr(curate, "FILTER_WORDS", 0)
    d = spark.createDataFrame([(1, "t", "b", "bug"), (2, "t", "b", "bug"), (3, "u", "b", "bug")], "item_id long, title string, body string, labels string")
    assert [r["item_id"] for r in curate.drop_leaks(d.where("item_id > 1"), d.where("item_id = 1")).collect()] == [3]
    assert curate.leak_report(d, d.where("item_id = 1")).first()["n_leaked"] == 1


def test_means_from_partial_sums(spark):
    """A mean by task sums equals the mean by position; one row a task and group goes on; ragged, null and empty vectors."""
    import numpy as np

    v = np.random.default_rng(6).standard_normal((500, 7))
    d = spark.createDataFrame([(i % 3, "ab"[i % 2], x.tolist()) for i, x in enumerate(v)], "layer int, labels string, vector array<double>").repartition(5)
    sums = directions._sums(d, ["layer", "labels"])
    assert sums.count() <= 30 and sums.agg(F.sum("rows")).first()[0] == 500
    for r in directions._means(d, ["layer", "labels"]).collect():
        own = [x for i, x in enumerate(v) if i % 3 == r["layer"] and "ab"[i % 2] == r["labels"]]
        assert np.allclose(r["vector"], np.mean(own, 0), atol=1e-11)
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0]), (1, None), (1, []), (None, [5.0])], "layer int, vector array<double>")
    assert {r["layer"]: r["vector"] for r in directions._means(odd, ["layer"]).collect()} == {1: [2.0, 2.0], None: [5.0]}
    assert directions._means(odd.limit(0), ["layer"]).count() == 0


def test_crossover(spark):
    few = dict(zip((1500, 3000, 9000, 15000, 27000), (0.698, 0.699, 0.705, 0.714, 0.722)))
    tuned = dict(zip(few, (0.714, 0.679, 0.767, 0.790, 0.790)))
    rows = [("3B", k, a, x) for a, t in (("few_shot", few), ("fine_tune", tuned)) for k, x in t.items()]
    assert runs.crossover(spark.createDataFrame(rows, "model string, pool_size int, approach string, f1_macro double")).first()["crossover_size"] == 9000


def test_histogram_has_empty_bins(spark):
    p = spark.createDataFrame([(1, "bug", "feature"), (2, "bug", "bug")], "item_id long, ground_truth string, predicted_label string")
    m = spark.createDataFrame([(1, 2, 0, 1), (2, 3, 0, 0)], "item_id long, c_bug long, c_feature long, c_question long")
    assert [(r["n_same"], r["n_errors"]) for r in errors.neighbor_histogram(p, m, 3).orderBy("n_same").collect()] == [(0, 0), (1, 0), (2, 1), (3, 0)]


def test_removed_direction_is_orthogonal(spark):
    d, _ = _vectors(spark, 30)
    d = d.withColumn("layer", F.lit(0))
    r = directions.mean_difference(d, "bug", "question")
    v = r.first()["vector"]
    for row in directions.remove_direction(d, r).collect():
        assert abs(sum(a * b for a, b in zip(row["vector"], v))) < 1e-9
    assert directions.shift_vectors(d, r, 2.0, [5]).where("layer = 0").count() == 30


def test_samples_do_not_gather_labels(spark):
    """Cut-offs give the same rows as ranks, and whole rows never move by label."""
    from pyspark.sql import Window

    d = spark.range(0, 200_000, 7).select(F.col("id").alias("item_id"), F.concat(F.lit("t"), "id").alias("title"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 3 > 0, "b").otherwise("c").alias("labels"))
    rn = F.row_number().over(Window.partitionBy("labels").orderBy(sample.shuffled(3, "item_id"), "item_id"))
    want = {(r["item_id"]) for r in d.withColumn("rn", rn).where("rn <= 3000").collect()}
    got = sample.per_label_sample(d, 9000, 3)
    assert {r["item_id"] for r in got.collect()} == want
    rn = F.row_number().over(Window.partitionBy("labels").orderBy("item_id"))
    want = {r["item_id"] for r in d.withColumn("rn", rn).withColumn("n", F.count("*").over(Window.partitionBy("labels"))).where("rn <= floor(n * 0.3)").collect()}
    split = sample.head_split(d, fraction=0.3)
    assert {r["item_id"] for r in split.where("split = 'test'").collect()} == want and split.count() == d.count()
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert not any("title" in line for line in plan.splitlines() if "Window" in line or "Sort " in line)
    assert sample.head_split(d.limit(0), fraction=0.5).count() == 0


def test_plans(spark):
    """The limit of a window reaches below the shuffle, and scans read what is needed."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("item_id"), F.col("text").alias("title"), F.lit("").alias("body"))
    plan = curate.dedup_first(d)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
