"""Exact top-k cosine joins of vector tables (item_id, vector), and an approximate one."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions import dot, l2_normalize
from marrow.sources import stored

#: Bytes of queries that are broadcast as one matrix, with what is held of each, and of a block where there are more.
BLOCK_BYTES = 32 << 20
#: Pool rows taken at a time, similarities held at a time, and queries in a batch of results.
POOL_ROWS, TILE, OUT_QUERIES = 512, 1 << 19, 4096
#: More than rounding to DIGITS moves a similarity.
SLACK = 1e-11
#: Digits of a similarity that decide the order; below, the smaller id wins.
DIGITS = 12
#: Pool rows of the first wave, how much each later wave is larger, and tasks of the first.
FIRST_WAVE, GROWTH, FIRST_TASKS = 1 << 18, 8, 4
#: Most pools of a sweep.
POOLS = 1000


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n > 0, n, 1.0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def _none(queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each query, not filled yet: similarities and ids."""
    return np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64)


def _keep(held: tuple[np.ndarray, np.ndarray], queries: np.ndarray, part: np.ndarray, cand: np.ndarray, least: np.ndarray | None = None) -> None:
    """Put pool rows ``part`` with ids ``cand`` among the k best held of each query, in place; ties go to smaller ids.

    Similarities are worked out TILE at a time, so their memory depends on neither side.  Of
    a tile only what can be among the best (and reaches ``least`` of its query) is ranked.
    """
    k = held[0].shape[1]
    step = max(1, TILE // max(1, len(cand)))
    for lo in range(0, len(queries), step):
        tile = queries[lo : lo + step] @ part.T
        sim, ids = (x[lo : lo + step] for x in held)
        top, last = sim[:, -1].copy(), ids[:, -1].copy()
        wanted = np.full(len(tile), -np.inf) if least is None else least[lo : lo + step]
        floor = np.maximum(top, wanted)
        if tile.shape[1] > k and not np.isfinite(floor).all():
            floor = np.fmax(floor, -np.partition(-tile, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(tile >= (floor - SLACK)[:, None])
        s, c = np.round(tile[i, j], DIGITS), cand[j]
        fits = np.flatnonzero((s >= wanted[i]) & ((s > top[i]) | ((s == top[i]) & (c < last[i]))))
        i, s, c = i[fits], s[fits], c[fits]
        rows = np.unique(i)
        i, s, c = np.r_[np.repeat(rows, k), i], np.r_[sim[rows].ravel(), s], np.r_[ids[rows].ravel(), c]
        order = np.lexsort((c, -s, i))
        begin = np.searchsorted(i[order], rows)
        best = order[begin[:, None] + np.arange(k)]
        sim[rows], ids[rows] = s[best], c[best]


def _rows(qid: np.ndarray, held: tuple, more: list[tuple[str, object, pa.DataType]]) -> pa.Table:
    """What is held of each query, without places that no candidate filled, and the constants ``more``."""
    sim, cand = held
    full = np.isfinite(sim).ravel()
    arrays = [np.repeat(qid, sim.shape[1])[full], np.ascontiguousarray(cand).ravel()[full], np.ascontiguousarray(sim).ravel()[full]]
    n = int(full.sum())
    return pa.table([*map(pa.array, arrays), *(pa.array([v] * n, t) for _, v, t in more)], names=["test_id", "neighbor_id", "similarity"] + [c for c, _, _ in more])


def _ranked(near: DataFrame, k: int, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by, "test_id").orderBy(F.desc("similarity"), "neighbor_id")
    ranked = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return ranked.select(*by, "test_id", (F.col("rn") - 1).alias("neighbor_rank"), "neighbor_id", "similarity")


def _side(df: DataFrame, *more: str) -> DataFrame:
    return df.where("vector is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("vector").cast("array<double>").alias("vector"), *more)


def _multiplied(q: DataFrame, p: DataFrame, keys: list[str], k: int, by: list[str]) -> DataFrame:
    """Candidates of every pair of a query block and a pool block that agree in ``keys``; a task holds one pair of blocks.

    A query's column least, if it isn't null, is a similarity below which it wants none.
    """
    kinds = [(c, p.schema[c].dataType.simpleString()) for c in by]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held, qid = _none(0, k), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            qid, held = left["item_id"].to_numpy(), _none(left.num_rows, k)
            dim = len(left["vector"][0])
            m = _unit(_matrix(left["vector"].combine_chunks(), dim))
            least = left["least"].to_numpy() if "least" in left.column_names else None
            least = None if least is None else np.where(np.isnan(least), -np.inf, least)
            for lo in range(0, right.num_rows, POOL_ROWS):
                part = right.slice(lo, POOL_ROWS)
                _keep(held, m, _unit(_matrix(part["vector"].combine_chunks(), dim)), part["item_id"].to_numpy(), least)
        return _rows(qid, held, [(c, right[c][0].as_py() if right.num_rows else None, right.schema.field(c).type) for c, _ in kinds])

    schema = "test_id long, neighbor_id long, similarity double" + "".join(f", {c} {t}" for c, t in kinds)
    return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(run, schema)


def _number(c: str, blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")


def _upto(blocks: Column | int) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.lit(blocks) if isinstance(blocks, int) else blocks) - 1))


def _waves(pool: DataFrame, rows: int, first: int) -> list[DataFrame]:
    """The pool in parts by a hash of the id: the first of some ``first`` rows, each later GROWTH times as large."""
    cuts = []
    while rows > first:
        cuts.append(rows)
        rows //= GROWTH
    if not cuts:
        return [pool]
    place = F.pmod(F.xxhash64(F.lit("wave"), F.col("item_id")), F.lit(1 << 40))
    edges = [0, *(((1 << 40) * (n // GROWTH)) // cuts[0] for n in reversed(cuts)), 1 << 40]
    parts = [pool.where((place >= lo) & (place < hi)) for lo, hi in zip(edges, edges[1:])]
    return [parts[0].repartition(FIRST_TASKS), *parts[1:]]


def _against_matrix(qid: np.ndarray, qm: np.ndarray, pool: DataFrame, k: int, by: str | None, least: dict) -> DataFrame:
    """Candidates of a broadcast matrix of queries, k of each query from each task at most, none below ``least`` of its pool."""
    kind = f", {by} {pool.schema[by].dataType.simpleString()}" if by else ""
    held = pool.sparkSession.sparkContext.broadcast((qid, qm, least))
    dim = qm.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qm, least = held.value
        now, best = None, None

        def found() -> Iterator[pa.RecordBatch]:
            key, field = now
            for lo in range(0, len(qid), OUT_QUERIES):
                yield from _rows(qid[lo : lo + OUT_QUERIES], tuple(x[lo : lo + OUT_QUERIES] for x in best), [(by, key, field)] if by else []).to_batches()

        for batch in batches:
            keys = np.array(batch.column(2).to_pylist() if by else [None] * batch.num_rows, object)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
            for at, end in zip(edges, edges[1:]):
                if end > at and (now is None or now[0] != keys[at]):
                    if now is not None:
                        yield from found()
                    now, best = (keys[at], batch.schema.field(2).type if by else None), _none(len(qid), k)
                for lo in range(at, end, POOL_ROWS):
                    part = batch.slice(lo, min(POOL_ROWS, end - lo))
                    _keep(best, qm, _unit(_matrix(part.column(1), dim)), part.column(0).to_numpy(), least.get(now[0]))
        if now is not None:
            yield from found()

    pool = pool.sortWithinPartitions(by) if by else pool  # a task holds the best of one pool at a time
    return pool.mapInArrow(run, "test_id long, neighbor_id long, similarity double" + kind)


def knn_join(queries: DataFrame, pool: DataFrame, k: int, query_block: int | None = None, by: str | None = None, first_wave: int = FIRST_WAVE) -> DataFrame:
    """(test_id, neighbor_rank 0-based, neighbor_id, similarity): the k nearest pool rows of every query.

    Order: similarity (12 digits) descending, then neighbour id.  Queries are written once.
    Up to ``query_block`` of them (default: what fits in BLOCK_BYTES) are broadcast as one
    matrix, and the pool, of any size, isn't shuffled.  More queries never come to the
    driver: both sides are dealt into numbered blocks of that size, and the pairs of blocks
    meet by their numbers, one pair in a task at a time.

    A pool of over ``first_wave`` rows is gone through in waves by a hash of the id, each
    GROWTH times the one before.  The k-th best similarity of a query so far is the least
    that the next wave may give, and of a wave GROWTH times as large only about GROWTH * k
    candidates a query reach it, however many tasks there are.  So each merge gets a small
    multiple of queries times k rows.

    A zero vector has similarity 0 to all; null vectors are left out; with ``by`` (a column
    of pool, of at most POOLS values) the join is made for each of its values.
    """
    spark = pool.sparkSession
    own = [by] if by else []
    q, p = stored(_side(queries)), _side(pool, *own)
    head = q.select(F.size("vector")).first()
    if head is None:
        return _ranked(spark.createDataFrame([], "test_id long, neighbor_id long, similarity double" + (f", {by} {p.schema[by].dataType.simpleString()}" if by else "")), k, own)
    block = query_block or max(1, BLOCK_BYTES // (8 * max(1, head[0]) + 24 * k))
    counts = p.groupBy(*own).agg(F.count("*").alias("n")).limit(POOLS + 1).collect()
    if len(counts) > POOLS:
        raise ValueError(f"more than {POOLS} pools in column {by}")
    largest, whole = max((r["n"] for r in counts), default=0), q.count() <= block
    if whole:
        rows = q.toArrow()
        qid, qm = rows["item_id"].to_numpy(), _unit(_matrix(rows["vector"].combine_chunks(), head[0]))
    else:
        n_q, n_p = -(-q.count() // block), max(1, -(-largest // block))
        q = q.withColumn("qb", _number("item_id", n_q)).withColumn("pb", _upto(n_p))
        p = p.withColumn("pb", _number("item_id", n_p)).withColumn("qb", _upto(n_q))
        if by:
            q = q.withColumn(by, F.explode(F.array(*(F.lit(r[by]) for r in counts)).cast(f"array<{p.schema[by].dataType.simpleString()}>")))
    held = None
    for last in (waves := _waves(p, largest, first_wave)):
        edge = None if held is None else held.where(F.col("neighbor_rank") == k - 1).select("test_id", F.col("similarity").alias("least"), *own)
        if whole:
            least: dict = {}
            for r in edge.collect() if edge is not None else []:  # one number a query and pool
                least.setdefault(r[by] if by else None, {})[r["test_id"]] = r["least"]
            near = _against_matrix(qid, qm, last, k, by, {key: np.array([v.get(i, -np.inf) for i in qid.tolist()]) for key, v in least.items()})
        else:
            left = q if edge is None else q.join(edge.withColumnRenamed("test_id", "item_id"), ["item_id", *own], "left")
            near = _multiplied(left, last, ["qb", "pb", *own], k, own)
        near = near if held is None else near.unionByName(held.select("test_id", "neighbor_id", "similarity", *own))
        if last is waves[-1]:
            return _ranked(near, k, own)
        held = stored(_ranked(near, k, own))


#: Pool rows that a cell search is fitted on, as bytes of vectors; queries that it is tuned with; rows that place a query's threshold.
SAMPLE_BYTES, TUNING_QUERIES, EDGE_ROWS = 32 << 20, 256, 4096
#: Coordinates coded together, and codes for them.
CODED, CODES = 4, 256
#: Tuning aims at a recall higher by this.
MARGIN = 0.03
#: Largest share of pairs that tuning lets score exactly.
MOST_SCORED = 0.25


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of k-means, from rows at equal distances."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[lo : lo + 4096] @ c.T - (c * c).sum(1) / 2).argmax(1) for lo in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.where(size > 0, np.bincount(near, weights=x[:, j], minlength=k) / np.maximum(size, 1), c[:, j])
    return c


@dataclass
class Cells:
    """An inverted file: cell centres, codebooks of groups of coordinates, coded rows that place thresholds, and what is probed and scored."""

    centres: np.ndarray
    books: list[np.ndarray]
    edge: np.ndarray
    probes: int
    share: float

    def near(self, unit: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")[:, :n]

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """One byte for CODED coordinates: the nearest entry of their codebook."""
        parts = [unit[:, j * CODED : (j + 1) * CODED] for j in range(len(self.books))]
        return np.stack([(x @ b.T - (b * b).sum(1) / 2).argmax(1) for x, b in zip(parts, self.books)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.hstack([b[codes[:, j]] for j, b in enumerate(self.books)]).astype(np.float32)

    def thresholds(self, unit: np.ndarray) -> np.ndarray:
        """For each query the coded similarity that the wanted share of the pool exceeds (a share of 1: any)."""
        if self.share >= 1:
            return np.full(len(unit), -np.inf)
        at = min(len(self.edge) - 1, max(0, math.ceil(self.share * len(self.edge)) - 1))
        parts = [-(unit[lo : lo + 1024].astype(np.float32) @ self.edge.T) for lo in range(0, len(unit), 1024)]
        return -np.concatenate([np.partition(x, at, axis=1)[:, at] for x in parts]) - 1e-6


def _sampled(df: DataFrame, rows: int) -> np.ndarray:
    """Unit vectors of the rows that come first by md5 of their id."""
    t = df.orderBy(F.md5(F.col("item_id").cast("string")), "item_id").limit(rows).select("vector").toArrow()
    return _unit(_matrix(t["vector"].combine_chunks(), len(t["vector"][0]))) if t.num_rows else np.zeros((0, 1))


def fit_cells(queries: DataFrame, pool: DataFrame, k: int, recall: float = 0.9, cells: int | None = None, probes: int | None = None, share: float | None = None) -> Cells | None:
    """Fit an inverted file on bounded samples, and tune it: None for an empty side.

    There are about as many cells as the root of the pool, as far as the sample (SAMPLE_BYTES
    of vectors) has 16 rows for each.  On TUNING_QUERIES sampled queries, whose nearest
    sample rows are known, those probes and that share of the pool to score exactly are
    taken which reach ``recall`` and MARGIN moving the fewest bytes of codes and vectors, scoring
    MOST_SCORED of the pairs at most if that can be.  Vectors without groups need many
    probes (codes, a sixteenth to a thirty-second of the bytes of vectors), others few.
    """
    q, p = _side(queries), _side(pool)
    n = p.count()
    head = p.select(F.size("vector")).first()
    if not n or q.isEmpty():
        return None
    dim = head[0]
    m, asked = _sampled(p, max(256, SAMPLE_BYTES // (8 * max(1, dim)))), _sampled(q, TUNING_QUERIES)
    centres = _unit(_means(m, max(1, min(cells or math.isqrt(n), max(1, len(m) // (1 if cells else 16))))))
    some = m[np.linspace(0, len(m) - 1, min(len(m), 8192)).astype(int)]
    books = [_means(some[:, j : j + CODED], max(1, min(CODES, len(some) // 8))) for j in range(0, dim, CODED)]
    c = Cells(centres, books, np.zeros((0, 1)), probes or len(centres), share or 1.0)
    coded = c.decode(c.encode(m))
    c.edge = coded[np.linspace(0, len(m) - 1, min(len(m), EDGE_ROWS)).astype(int)]
    if probes and share:
        c.probes = min(probes, len(centres))
        return c
    wanted = max(1, min(len(m), math.ceil(k * len(m) / n)))
    true = np.argsort(-(asked @ m.T), axis=1, kind="stable")[:, :wanted]
    rough = asked.astype(np.float32) @ coded.T
    own = np.take_along_axis(rough, true, 1)
    place = np.stack([(rough > own[:, [j]]).mean(1) for j in range(wanted)], 1)  # share of the pool that looks better
    cell = (m @ centres.T).argmax(1)
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    turn = np.take_along_axis(order, cell[true], 1)
    size = np.bincount(cell, minlength=len(centres)) / len(m)
    options = []
    for n_probes in sorted({probes} if probes else {max(1, round(len(centres) * x / 32)) for x in range(1, 33)}):
        inside = np.sort(place[turn < n_probes])
        need = math.ceil(min(1.0, recall + MARGIN) * true.size)
        if len(inside) >= need or n_probes >= len(centres):
            part = max(float(inside[min(need, len(inside)) - 1]) * 1.1, 1.5 * k / n) if share is None else share
            scanned = float((size * (order < n_probes)).sum(1).mean())
            options.append((part > MOST_SCORED, scanned * len(books) + part * 8 * dim, n_probes, min(1.0, part)))
    _, _, c.probes, c.share = min(options) if options else (0, 0, min(probes or len(centres), len(centres)), share or MOST_SCORED)
    return c


def _candidates(index: Cells, q: DataFrame, p: DataFrame, block: int) -> DataFrame:
    """(test_id, neighbor_id) of the pairs to score: of the probed cells, what codes put above the query's threshold."""
    held = q.sparkSession.sparkContext.broadcast(index)

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            if batch.num_rows:
                u = _unit(_matrix(batch.column(1), c.centres.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c.thresholds(u).astype(float)), pa.array(list(c.near(u, c.probes).astype(np.int32)), pa.list_(pa.int32()))], ["item_id", "vector", "edge", "near"])

    def place_pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            if batch.num_rows:
                u = _unit(_matrix(batch.column(1), c.centres.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in c.encode(u)], pa.binary()), pa.array(c.near(u, 1)[:, 0].astype(np.int32))], ["item_id", "codes", "cell"])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        c, found = held.value, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if left.num_rows and right.num_rows:
            qid, pid = left["item_id"].to_numpy(), right["item_id"].to_numpy()
            m, edge = _unit(_matrix(left["vector"].combine_chunks(), c.centres.shape[1])).astype(np.float32), left["edge"].to_numpy()
            codes = np.frombuffer(b"".join(right["codes"].to_pylist()), np.uint8).reshape(len(pid), -1)
            for lo in range(0, len(pid), 4096):
                rows = c.decode(codes[lo : lo + 4096])
                for at in range(0, len(qid), 1024):
                    i, j = np.nonzero(m[at : at + 1024] @ rows.T >= edge[at : at + 1024, None])
                    found.append((qid[at + i], pid[lo + j]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], names=["test_id", "neighbor_id"])

    qc = q.mapInArrow(place_queries, "item_id long, vector array<double>, edge double, near array<int>").select("item_id", "vector", "edge", F.explode("near").alias("cell"))
    pc = p.mapInArrow(place_pool, "item_id long, codes binary, cell int")
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(name))
    sizes = stored(blocks(qc, "nq").join(blocks(pc, "np"), "cell"))  # one row a cell
    qc = qc.join(F.broadcast(sizes), "cell").withColumn("qb", _number("item_id", F.col("nq"))).withColumn("pb", _upto(F.col("np")))
    pc = pc.join(F.broadcast(sizes), "cell").withColumn("pb", _number("item_id", F.col("np"))).withColumn("qb", _upto(F.col("nq")))
    keys = ["cell", "qb", "pb"]
    return qc.drop("nq", "np").groupBy(*keys).cogroup(pc.drop("nq", "np").groupBy(*keys)).applyInArrow(scan, "test_id long, neighbor_id long")


def knn_cells(queries: DataFrame, pool: DataFrame, k: int, recall: float = 0.9, cells: int | None = None, probes: int | None = None, share: float | None = None, block: int | None = None, scored: bool = False) -> DataFrame:
    """Approximate knn_join for two large sides, by an inverted file of product-quantised codes and exact re-ranking.

    Of each pool row a cell number and a code of a byte for four coordinates are shuffled,
    once; every query goes to its nearest cells, where codes alone choose the pairs to
    score: those above the similarity that ``share`` of the pool exceeds for that query.
    Chosen pairs meet the vectors by id, and exact similarities rank them.  Numbers of
    cells, probes and the share are tuned for ``recall`` unless given (see fit_cells).  A
    cell of over ``block`` rows, or probed by as many queries, is dealt into numbered blocks,
    so no task gathers a cell.  Queries that find fewer than k rows go through the exact
    join, so each gets k rows, or the whole pool.  With ``scored`` each row has n_scored,
    how many pairs of its query were scored exactly.
    """
    index = fit_cells(queries, pool, k, recall, cells, probes, share)
    if index is None:
        exact = knn_join(queries, pool, k, block)
        return exact.withColumn("n_scored", F.lit(0).cast("long")) if scored else exact
    q, p = _side(queries), _side(pool)
    n_pool = p.count()
    unit = lambda df, i, u: df.select(F.col("item_id").alias(i), l2_normalize("vector").alias(u))
    pairs = _candidates(index, q, p, block or max(1, BLOCK_BYTES // (8 * index.centres.shape[1])))
    near = pairs.join(unit(p, "neighbor_id", "b"), "neighbor_id").join(unit(q, "test_id", "a"), "test_id").select("test_id", "neighbor_id", F.round(dot("a", "b"), DIGITS).alias("similarity"))
    near = near.withColumn("n_scored", F.count("*").over(Window.partitionBy("test_id"))) if scored else near
    found = stored(_ranked(near, k, ["n_scored"] if scored else []))
    full = found.groupBy("test_id").count().where(F.col("count") >= min(k, n_pool)).select("test_id")
    short = queries.join(full, F.col("item_id") == F.col("test_id"), "left_anti")
    rest = knn_join(short, pool, k, block)
    rest = rest.withColumn("n_scored", F.lit(n_pool).cast("long")) if scored else rest
    return found.join(full, "test_id", "left_semi").unionByName(rest)


def explode_k(neighbors: DataFrame, ks: list[int]) -> DataFrame:
    """One retrieval for several k: rows of rank below each k, in long form."""
    return neighbors.withColumn("k", F.explode(F.array(*(F.lit(int(k)) for k in ks)))).where("neighbor_rank < k")


def knn_sweep(queries: DataFrame, pools: DataFrame, k: int) -> DataFrame:
    """knn_join per pool_size of a long pool table; the queries' matrix is made once."""
    return knn_join(queries, pools, k, by="pool_size")


def enrich_neighbors(neighbors: DataFrame, test: DataFrame, train: DataFrame, cols: tuple[str, ...] = ("title", "body", "labels")) -> DataFrame:
    """Adds test_* and neighbor_* columns by two equi joins on ids."""
    short = {"labels": "label"}
    t = test.select(F.col("item_id").alias("test_id"), *(F.col(c).alias(f"test_{short.get(c, c)}") for c in cols))
    p = train.select(F.col("item_id").alias("neighbor_id"), *(F.col(c).alias(f"neighbor_{short.get(c, c)}") for c in cols))
    return neighbors.join(t, "test_id").join(p, "neighbor_id")


def match_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a_id, b_id, similarity): the nearest row of class b for every row of class a."""
    r = knn_join(df.where(F.col("labels") == a), df.where(F.col("labels") == b), 1)
    return r.select(F.col("test_id").alias("a_id"), F.col("neighbor_id").alias("b_id"), "similarity")
