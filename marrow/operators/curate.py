"""Cleaning, exact dedup and leakage control of item tables (item_id, title, body, labels)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions import clean_text, content_key, fold_label


def conform_items(df: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Columns item_id, title, body, labels (from ``labels`` or ``label``) and created_at if there is one.

    Null titles and bodies become empty, labels are folded; rows with a null label are
    left out (count them with ``null_labels``).  Missing columns are an error.
    """
    label = "labels" if "labels" in df.columns else "label"
    missing = [c for c in (id_col, "title", "body", label) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    more = [F.col("created_at")] if "created_at" in df.columns else []
    return df.where(F.col(label).isNotNull()).select(F.col(id_col).alias("item_id"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "body")), fold_label(label).alias("labels"), *more)


def null_labels(df: DataFrame) -> DataFrame:
    """One row: how many rows conform_items() leaves out."""
    label = "labels" if "labels" in df.columns else "label"
    return df.agg(F.count(F.when(F.col(label).isNull(), 1)).alias("n_null_labels"))


def item_text(clean: bool = True) -> Column:
    """Text that retrieval embeds: title and body, cleaned or raw."""
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    return clean_text(both) if clean else both


def dedup_first(df: DataFrame) -> DataFrame:
    """Of items with equal content the one with the least item_id; the limit of one is applied before the shuffle."""
    w = Window.partitionBy(content_key("title", "body")).orderBy("item_id")
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def dedup_report(df: DataFrame) -> DataFrame:
    n = df.agg(F.count("*").alias("n_before"), F.count_distinct(content_key("title", "body")).alias("n_after"))
    return n.withColumn("n_removed", F.col("n_before") - F.col("n_after"))


#: Keys that share a word of a key filter, on average, and bits a key sets in it.
_KEYS_A_WORD, _BITS = 4, 4
#: Most words of a filter that is broadcast; for more keys than it serves there is none.
FILTER_WORDS = 1 << 20


def _word(key: Column, words: int) -> tuple[Column, Column]:
    """The word of a key and the bits it sets there."""
    h = F.xxhash64(F.lit("bits"), key)
    out = F.lit(0).cast("long")
    for j in range(_BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(F.xxhash64(F.lit("word"), key), F.lit(words)), out


def key_filter(keys: DataFrame, words: int) -> DataFrame:
    """A Bloom filter of the column key in ``words`` words of 64 bits: (word, bits).

    Built by a bitwise or that tasks take first; filters of as many words merge by the same.
    """
    word, bits = _word(F.col("key"), words)
    return keys.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _probed(df: DataFrame, keys: DataFrame) -> DataFrame | None:
    """df (with a column key) and may_leak: false where no key of ``keys`` can be equal; None for more keys than a filter serves."""
    words = -(-max(1, keys.count()) // _KEYS_A_WORD)
    if words > FILTER_WORDS:
        return None
    word, bits = _word(F.col("key"), words)
    held = F.broadcast(key_filter(keys, words).withColumnRenamed("bits", "filter"))  # FILTER_WORDS rows at most
    probed = df.withColumn("word", word).join(held, "word", "left")
    return probed.withColumn("may_leak", F.coalesce(F.col("filter").bitwiseAND(bits) == bits, F.lit(False))).drop("word", "filter")


def drop_leaks(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train rows whose content isn't in test.

    A filter of the test keys tells for nearly all train rows that they aren't there; they
    never move.  Only rows that may be there are shuffled to the exact anti join.
    """
    keys = test.select(content_key("title", "body").alias("key"))
    keyed = train.withColumn("key", content_key("title", "body"))
    probed = _probed(keyed, keys)
    if probed is None:
        return keyed.join(keys, "key", "left_anti").drop("key")
    clear = probed.where("not may_leak").drop("may_leak", "key")
    unsure = probed.where("may_leak").drop("may_leak").join(keys, "key", "left_anti").drop("key")
    return clear.unionByName(unsure).select(*train.columns)


def leak_report(raw: DataFrame, test: DataFrame) -> DataFrame:
    """Per label, rows of raw that aren't test rows but hold the content of one; rows that the filter clears aren't shuffled."""
    keys = test.select(content_key("title", "body").alias("key"))
    keyed = raw.select("item_id", "labels", content_key("title", "body").alias("key"))
    probed = _probed(keyed, keys)
    unsure = keyed if probed is None else probed.where("may_leak").drop("may_leak")
    rest = unsure.join(test.select("item_id"), "item_id", "left_anti")
    return rest.join(keys, "key", "left_semi").groupBy("labels").agg(F.count("*").alias("n_leaked"))


def label_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    return df.groupBy("labels").agg(*(F.count(F.when(F.col(split_col) == s, 1)).alias(f"n_{s}") for s in ("train", "test")))


def dedup_rows(df: DataFrame) -> DataFrame:
    """Distinct rows over all columns."""
    return df.dropDuplicates()


def dedup_rows_report(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_before"), F.count("*").alias("n_after"))


def config_conflicts(runs: DataFrame) -> DataFrame:
    """(context_window, model, top_k) with more than one row."""
    return runs.groupBy("context_window", "model", "top_k").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def config_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("context_window").agg(F.count_distinct("model").alias("n_models"), F.count_distinct("top_k").alias("n_ks"))
