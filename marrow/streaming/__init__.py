"""Streaming triage: items that arrive one at a time are retrieved and voted on as micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marrow import sources
from marrow.operators.retrieve import knn_join
from marrow.operators.vote import vote_sweep


def classify(items: DataFrame, pool: DataFrame, k: int, scheme: str = "similarity") -> DataFrame:
    """(test_id, predicted_label) of items (item_id, vector) by their neighbours in a pool (item_id, vector, labels)."""
    near = knn_join(items, pool, k)
    labels = pool.select(F.col("item_id").alias("neighbor_id"), F.col("labels").alias("neighbor_label"))
    near = near.join(labels, "neighbor_id").withColumn("test_label", F.lit(None).cast("string"))
    return vote_sweep(near, [k], (scheme,)).select("test_id", "predicted_label")


def triage(stream: DataFrame, pool: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, scheme: str = "similarity"):
    """Start a query that classifies every micro-batch against a static pool.

    A top-k has no end on an unbounded stream, so it is taken in foreachBatch; ``sink``
    gets the batch's labels and its number, by which it can skip a batch it has seen.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(classify(df, pool, k, scheme), n)).start()


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for triage() that gives each batch a folder of its own, batch=<number>, written whole or not at all.

    After a restart the engine runs the last batch again, with the same number and rows.  If its
    folder is complete it is left; if the job died before that, it is written anew.  So rows are neither
    lost nor doubled, wherever the job died.  Read ``path`` as one table partitioned by batch.
    """
    return lambda df, n: sources.write(df, f"{path}/batch={n}", mode="ignore") and None


_POST = "item_id long, vector array<double>"


def followed_posts(stream: DataFrame, key_col: str, time_col: str, delay: str, quiet: str) -> DataFrame:
    """(key, item_id, vector, n_seen, closed): the first post of each key at once, and its count when the key has been quiet.

    ``stream`` has item_id, vector, a text key (as content_key() makes it) and an event time.
    The state of a key is its first item's id, how often it was seen, and the latest time; it ends, and a row
    with closed = true says how often the key was seen, when the watermark (``delay`` behind
    the latest event) is ``quiet`` past that time.  So state holds only the keys of that
    span.  A key that comes back later counts as new.  Of posts of one batch the earliest, then the least
    id, is first.  Null keys are a key; rows without a time, or behind the watermark, are left out.
    """
    span = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name = None if key[0] == "" else key[0][1:]
        if state.hasTimedOut:
            item, n, _ = state.get
            state.remove()
            yield pd.DataFrame({"key": [name], "item_id": [item], "vector": [None], "n_seen": [n], "closed": [True]})
            return
        rows = pd.concat(list(batches)).sort_values(["ms", "item_id"])
        item, n, last = state.get if state.exists else (int(rows["item_id"].iloc[0]), 0, 0)
        if not state.exists:
            yield pd.DataFrame({"key": [name], "item_id": [item], "vector": [rows["vector"].iloc[0]], "n_seen": [1], "closed": [False]})
        last = max(last, int(rows["ms"].iloc[-1]))
        state.update((item, n + len(rows), last))
        state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1))

    keyed = F.coalesce(F.concat(F.lit("k"), F.col(key_col)), F.lit("")).alias("group")  # "" is the null key
    src = stream.where(F.col(time_col).isNotNull()).withWatermark(time_col, delay)
    src = src.select(keyed, F.col("item_id").cast("long").alias("item_id"), F.col("vector").cast("array<double>").alias("vector"), F.unix_millis(time_col).alias("ms"), F.col(time_col))
    return src.groupBy("group").applyInPandasWithState(follow, f"key string, {_POST}, n_seen long, closed boolean", "item_id long, n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def distinct_posts(stream: DataFrame, key_cols: list[str], time_col: str, delay: str) -> DataFrame:
    """Repeated posts within the watermark are dropped; state is bounded by the delay."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(key_cols)
