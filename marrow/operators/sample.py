"""Splits and samples; all follow the ordinal item_id or an md5 order, so they repeat exactly."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(seed: int, *ids: str) -> Column:
    """An order without pattern that a seed fixes."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in ids)))


#: Hex digits of an md5 order that make a block; blocks are what a cut-off is looked up in.
_PREFIX = 4
#: Item ids in a block of the item_id order.
_IDS = 65536


def _sizes(df: DataFrame) -> DataFrame:
    """One row per label, by design a handful: cnt rows, its place li, and n_labels."""
    everywhere = Window.partitionBy(F.lit(0))
    sizes = df.groupBy("labels").agg(F.count("*").alias("cnt"))
    return sizes.withColumn("li", F.row_number().over(everywhere.orderBy("labels")) - 1).withColumn("n_labels", F.count("*").over(everywhere))


def _heads(df: DataFrame, quotas: DataFrame, seed: int | None = None) -> DataFrame:
    """df with the columns of ``quotas`` (labels, quota, ..), one row for each, and head: is the row among the label's first?

    The order is by item_id, or with a seed its md5 order; ids are distinct.  No task sees
    the rows of a label: counts of (label, block of the order) tell in which block a quota
    ends, only that block's keys are ranked, and every row is then compared with its label's
    last one.
    """
    order = F.col("item_id") if seed is None else shuffled(seed, "item_id")
    block = F.floor(F.col("item_id") / _IDS) if seed is None else F.substring(order, 1, _PREFIX)
    own = [c for c in quotas.columns if c not in ("labels", "quota")]
    keys = df.select(F.col("labels"), block.alias("block"), order.alias("place"), "item_id")
    counts = keys.groupBy("labels", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("labels").orderBy("block")) - F.col("n")
    edge = counts.withColumn("before", before).join(F.broadcast(quotas), "labels").where("before < quota and quota <= before + n")
    edge = edge.select("labels", "block", *own, (F.col("quota") - F.col("before")).alias("rest"))
    w = Window.partitionBy("labels", *own).orderBy("place", "item_id")
    last = keys.join(F.broadcast(edge), ["labels", "block"]).withColumn("rn", F.row_number().over(w)).where("rn = rest")
    cuts = quotas.join(last.select("labels", *own, F.col("place").alias("cut_place"), F.col("item_id").alias("cut_id")), ["labels", *own], "left")
    out = df.join(F.broadcast(cuts.drop("quota")), "labels")
    head = F.coalesce(F.struct(order.alias("p"), F.col("item_id").alias("i")) <= F.struct(F.col("cut_place").alias("p"), F.col("cut_id").alias("i")), F.lit(False))
    return out.withColumn("head", head & F.col("cut_id").isNotNull()).drop("cut_place", "cut_id")


def head_split(df: DataFrame, fraction: float | None = None, total: int | None = None) -> DataFrame:
    """Adds split (test or train): of each label the first rows by item_id are test.

    A fraction takes floor(n * fraction) of a label; a total takes total // labels, at most
    the label's rows, and leaves a remainder out.
    """
    if (fraction is None) == (total is None):
        raise ValueError("give a fraction or a total")
    if fraction is not None and not 0 < fraction < 1:
        raise ValueError("a fraction lies between 0 and 1")
    quota = F.floor(F.col("cnt") * F.lit(fraction)) if fraction is not None else F.least(F.floor(F.lit(total) / F.col("n_labels")), F.col("cnt"))
    r = _heads(df, _sizes(df).select("labels", quota.alias("quota")))
    return r.withColumn("split", F.when(F.col("head"), "test").otherwise("train")).drop("head")


def with_test_idx(test: DataFrame) -> DataFrame:
    """0-based position of each row by item_id, over all labels: two passes, no task sees all rows.

    Rows are dealt into blocks of item ids; block sizes are summed first, ranks are local.
    The sum is one task over one row for 65,536 ids: 150,000 rows for 10 thousand million.
    """
    block = F.floor(F.col("item_id") / 65536)
    sizes = test.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = sizes.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    local = test.withColumn("block", block).withColumn("rn", F.row_number().over(Window.partitionBy("block").orderBy("item_id")))
    return local.join(before, "block").withColumn("test_idx", F.col("before") + F.col("rn") - 1).drop("block", "rn", "before")


def stratified_subsample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n // L rows of each label, one more for the first n % L labels by name, capped, in md5 order."""
    return subsample_sweep(df, [n], seed).drop("pool_size")


def subsample_sweep(df: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """Nested subsamples of several sizes in long form (pool_size)."""
    each = _sizes(df).withColumn("pool_size", F.explode(F.array(*(F.lit(int(s)) for s in sizes))))
    quota = F.floor(F.col("pool_size") / F.col("n_labels")) + F.when(F.col("li") < F.col("pool_size") % F.col("n_labels"), 1).otherwise(0)
    r = _heads(df, each.select("labels", "pool_size", F.least(quota, F.col("cnt")).alias("quota")), seed)
    return r.where("head").drop("head")


def quota_check(df: DataFrame, n: int) -> DataFrame:
    """Labels whose quota is larger than the label."""
    quota = F.floor(F.lit(n) / F.col("n_labels")) + F.when(F.col("li") < F.lit(n) % F.col("n_labels"), 1).otherwise(0)
    return _sizes(df).select("labels", F.col("cnt").alias("available"), quota.cast("long").alias("quota")).where("quota > available")


def per_label_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n // L rows of each label in md5 order, no remainder."""
    quota = F.least(F.floor(F.lit(n) / F.col("n_labels")), F.col("cnt"))
    return _heads(df, _sizes(df).select("labels", quota.alias("quota")), seed).where("head").drop("head")


def random_subset(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows in md5 order (a top-n, taken in each task first)."""
    return df.orderBy(shuffled(seed, "item_id"), "item_id").limit(n)


#: Rounds of the keyed permutation; each takes 12 hex digits of an md5.
ROUNDS = 8


def permutation_sides(n: int) -> tuple[int, int]:
    """Sides (a, b) of the smallest rectangle near a square that holds n places: a * b >= n by as little as can be."""
    root = max(2, math.isqrt(n))
    a = min(range(max(2, root - root // 4), root + 1), key=lambda a: (-n % a, -a))
    return a, max(2, -(-n // a))


def permuted(place: Column, n: int, *key: Column) -> Column:
    """Where a permutation of 0..n-1, one for each key, puts ``place``.

    A Feistel network over the cells (l, r) of a rectangle: each round adds an md5 of key,
    round and one side to the other side.  A cell beyond n goes through again until it is
    within; a walk is at most as long as the rectangle has cells beyond n.
    """
    a, b = permutation_sides(n)

    def mixed(i: Column, side: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in key), i.cast("string"), side.cast("string"))), 1, 12), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        one = F.struct(F.pmod(s["l"] + mixed(i, s["r"]), F.lit(a)).alias("l"), s["r"].alias("r"))
        other = F.struct(s["l"].alias("l"), F.pmod(s["r"] + mixed(i, s["l"]), F.lit(b)).alias("r"))
        return F.when(i % 2 == 0, one).otherwise(other)

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])

    out = once(place.cast("long"))
    if a * b == n:
        return out
    return F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), out, lambda x, _: F.when(x < n, x).otherwise(once(x)))


def numbered(df: DataFrame) -> DataFrame:
    """(item_id, place): rows numbered from 0 in md5 order of their distinct ids; ranks within md5 prefixes, and sums of prefix sizes before them."""
    keyed = df.select("item_id", F.md5(F.col("item_id").cast("string")).alias("h")).withColumn("block", F.substring("h", 1, _PREFIX))
    sizes = keyed.groupBy("block").agg(F.count("*").alias("n"))
    before = sizes.select("block", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("block")) - F.col("n")).alias("before"))  # 16^_PREFIX rows at most
    rank = F.row_number().over(Window.partitionBy("block").orderBy("h", "item_id"))
    return keyed.withColumn("rn", rank).join(before, "block").select("item_id", (F.col("before") + F.col("rn") - 1).alias("place"))


def random_neighbors(test: DataFrame, train: DataFrame, k: int, seeds: list[int]) -> DataFrame:
    """k distinct train rows per query and seed (seed, test_id, neighbor_rank, neighbor_id, similarity 0.0), drawn apart for each.

    The pool is numbered; each (seed, query) has a permutation of the numbers of its own and
    takes what it gives 0..k-1.  That is an equi join on numbers: neither side is crossed
    with the other, and no query's draw depends on another's.  An error if the pool is
    smaller than k; an empty test table gives no rows.
    """
    size = train.count()
    if k > size:
        raise ValueError(f"{k} neighbours wanted, the pool has {size} rows")
    if k < 1:
        raise ValueError(f"k must be 1 or more, not {k}")
    by_seed = F.explode(F.array(*(F.lit(int(s)) for s in seeds))).alias("seed")
    q = test.select(F.col("item_id").alias("test_id"), by_seed).withColumn("neighbor_rank", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    q = q.withColumn("place", permuted(F.col("neighbor_rank"), size, F.col("seed"), F.col("test_id")))
    return q.join(numbered(train), "place").select("seed", "test_id", "neighbor_rank", F.col("item_id").alias("neighbor_id"), F.lit(0.0).alias("similarity"))
