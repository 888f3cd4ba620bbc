"""Round trips of files, and a micro-batch query."""

import os

import pytest
from pyspark.sql import functions as F

from marrow import sources, streaming


def test_csv_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "quoted", title', "line\nbreak", "Bug"), (2, "NA", None, "question")], "item_id long, title string, body string, labels string")
    sources.write(d, str(tmp_path / "items"), "csv")
    got = [tuple(r) for r in sources.read_items(spark, str(tmp_path / "items")).orderBy("item_id").collect()]
    assert got == [(1, 'a "quoted", title', "line\nbreak", "bug"), (2, "NA", "", "question")]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "t", "b", "bug", "train"), (2, "t", "b", "bug", "test")], "item_id long, title string, body string, labels string, split string")
    sources.write_splits(d, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/test_split")).count() == 1
    assert spark.read.parquet(str(tmp_path / "s/train_split_info")).columns == ["item_id", "title", "labels"]
    sources.write_splits(d.limit(0), str(tmp_path / "s"), mode="ignore")
    assert spark.read.parquet(str(tmp_path / "s/test_split")).count() == 1
    n = spark.createDataFrame([(1, 0, 0.5, "bug", 1), (1, 0, 0.5, "bug", 3), (1, 1, 0.4, "bug", 3)], "test_id long, neighbor_rank int, similarity double, neighbor_label string, k int")
    sources.write_neighbors(n, str(tmp_path / "n"))
    back = spark.read.parquet(str(tmp_path / "n"))
    assert back.where("k = 3").count() == 2
    assert sources.load_neighbors(back, 2).first()["neighbors"][1]["similarity"] == 0.4  # k 2 is absent: the largest is read
    with pytest.raises(ValueError, match="similarity"):
        sources.load_neighbors(n.drop("similarity"), 1)
    p = spark.createDataFrame([(1, "x" * 900, "bug", "bug")], "item_id long, raw_output string, predicted_label string, ground_truth string")
    sources.write_predictions(p, str(tmp_path / "p"))
    sources.write_log(p, str(tmp_path / "log"))
    assert len(spark.read.json(str(tmp_path / "log")).first()["raw_output"]) == 500


def _broken(spark):
    """Rows of which the last fails, after other tasks have written theirs."""
    return spark.range(0, 4000, numPartitions=4).select(F.when(F.col("id") < 3990, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("long").alias("id"))


def test_write_is_whole_or_not_there(spark, tmp_path):
    path, good = str(tmp_path / "t"), spark.range(10)
    with pytest.raises(Exception, match="lost"):
        sources.write(_broken(spark), path, mode="ignore")
    assert not os.path.exists(path) and not sources.complete(spark, path)
    assert sources.write(good, path, mode="ignore") and sources.complete(spark, path)
    assert not sources.write(spark.range(99), path, mode="ignore") and spark.read.parquet(path).count() == 10
    with pytest.raises(Exception, match="lost"):  # the old table stays until the new one is there
        sources.write(_broken(spark), path, mode="overwrite")
    assert sources.complete(spark, path) and spark.read.parquet(path).count() == 10
    with pytest.raises(ValueError, match="exists"):
        sources.write(good, path)
    assert sources.write(spark.range(5), path, mode="append") and spark.read.parquet(path).count() == 15 and sources.complete(spark, path)
    assert sources.write(spark.range(3), path, mode="overwrite") and spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError, match="mode"):
        sources.write(good, str(tmp_path / "u"), mode="never")


@pytest.mark.parametrize("how", ["no mark", "lost file", "short file", "cut manifest"])
def test_incomplete_tables_are_written_again(spark, tmp_path, how):
    """What a job that died in the middle leaves isn't taken for the table; it is set aside, not deleted."""
    path = str(tmp_path / "t")
    if how == "no mark":
        with pytest.raises(Exception, match="lost"):
            _broken(spark).write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).parquet(path)
        os.makedirs(path, exist_ok=True)
    else:
        sources.write(spark.range(50), path)
        part = next(f for f in os.listdir(path) if f.startswith("part-"))
        if how == "lost file":
            os.remove(f"{path}/{part}")
        else:
            with open(f"{path}/{part if how == 'short file' else sources.MANIFEST}", "r+b") as f:
                f.truncate(5)
    assert not sources.complete(spark, path)
    assert sources.write(spark.range(7), path, mode="ignore") and sources.complete(spark, path)
    assert spark.read.parquet(path).count() == 7
    assert [f for f in os.listdir(tmp_path) if ".incomplete-" in f] and not [f for f in os.listdir(tmp_path) if ".staging-" in f]


def test_partitioned_write_is_complete(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.write(spark.range(9).withColumn("k", F.col("id") % 3), path, by=("k",))
    assert sources.complete(spark, path) and len(sources.manifest(spark, path)["files"]) >= 3
    os.remove(next(str(f) for f in (tmp_path / "t").glob("k=1/part-*")))
    assert not sources.complete(spark, path)
    spark.range(2).write.parquet(str(tmp_path / "foreign"))  # Spark's own mark will do
    assert sources.complete(spark, str(tmp_path / "foreign"))


def test_bucketed_neighbours_are_not_shuffled(spark, tmp_path):
    from marrow.operators import debias, vote

    rows = [(q, r, 1 - r / 9, ("bug", "question")[r % 2], "bug") for q in range(40) for r in range(5)]
    d = spark.createDataFrame(rows, "test_id long, neighbor_rank int, similarity double, neighbor_label string, test_label string")
    t = sources.store_neighbors(d, "neighbours_in_buckets", str(tmp_path / "n"), 4)
    for f in (lambda x: vote.vote(x, 3), lambda x: debias.debias(x, 4, 3), lambda x: sources.load_neighbors(x, 3)):
        plan = f(t)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "hashpartitioning" in f(d)._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, f(t).collect())) == sorted(map(str, f(d).collect()))
    spark.sql("DROP TABLE neighbours_in_buckets")


def test_triage(spark, tmp_path):
    pool = spark.createDataFrame([(1, [1.0, 0.0], "bug"), (2, [0.0, 1.0], "question")], "item_id long, vector array<double>, labels string")
    items = spark.createDataFrame([(10, [0.9, 0.1]), (11, [0.1, 0.9])], "item_id long, vector array<double>")
    items.write.parquet(str(tmp_path / "in"))
    got = {}
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    q = streaming.triage(stream, pool, 1, lambda df, n: got.update({r["test_id"]: r["predicted_label"] for r in df.collect()}), str(tmp_path / "ckpt"))
    q.processAllAvailable()
    q.stop()
    assert got == {10: "bug", 11: "question"}


@pytest.mark.parametrize("when", ["before", "after"])
def test_restart_neither_loses_nor_doubles(spark, tmp_path, when):
    """The job dies before or after a batch's output is there; the batch runs again under its number."""
    pool = spark.createDataFrame([(1, [1.0, 0.0], "bug"), (2, [0.0, 1.0], "question")], "item_id long, vector array<double>, labels string")
    schema = "item_id long, vector array<double>"
    ids = [[10, 11], [12], [13, 14]]
    for k, own in enumerate(ids):
        spark.createDataFrame([(i, [0.9, 0.1] if i % 2 else [0.1, 0.9]) for i in own], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, died = str(tmp_path / "out"), []
    write = streaming.batch_folders(out)

    def sink(df, n):
        if n == 1 and not died and when == "before":
            died.append(n)
            raise RuntimeError("died")
        write(df, n)
        if n == 1 and not died:
            died.append(n)
            raise RuntimeError("died")

    for attempt in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = streaming.triage(stream, pool, 1, sink, str(tmp_path / "ckpt"))
        try:
            q.processAllAvailable()
            assert attempt == 1
        except Exception as e:  # noqa: BLE001
            assert "died" in str(e) and attempt == 0
        q.stop()
    back = spark.read.parquet(out)
    assert sorted((r["test_id"], r["predicted_label"]) for r in back.collect()) == [(i, "bug" if i % 2 else "question") for i in range(10, 15)]
    assert back.select("batch").distinct().count() == 3


def test_followed_posts(spark, tmp_path):
    """State lives through a restart, ends after a quiet span, and a key that comes back is new."""
    schema = "item_id long, key string, vector array<double>, ts timestamp"

    def add(*rows):
        d = spark.createDataFrame([(i, k, [float(i)], t) for i, k, t in rows], "item_id long, key string, vector array<double>, ts string")
        d.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    seen = []

    def run():
        s = streaming.followed_posts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "key", "ts", "10 minutes", "1 hour")
        q = s.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).start()
        q.processAllAvailable()
        q.stop()
        got, seen[:] = sorted(((k, i, n, c) for k, i, _, n, c in seen), key=repr), []
        return got

    add((1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:01:00"), (3, "b", "2024-01-01 00:02:00"), (4, None, "2024-01-01 00:03:00"), (5, "a", None))
    assert run() == [("a", 1, 1, False), ("b", 3, 1, False), (None, 4, 1, False)]
    add((6, "a", "2024-01-01 00:30:00"), (7, "c", "2024-01-01 01:20:00"))
    assert run() == [("b", 3, 1, True), ("c", 7, 1, False), (None, 4, 1, True)]  # a was seen at half past
    add((8, "d", "2024-01-01 03:00:00"))
    assert run() == [("a", 1, 3, True), ("c", 7, 1, True), ("d", 8, 1, False)]
    add((9, "a", "2024-01-01 03:01:00"))
    assert run() == [("a", 9, 1, False)]


def test_distinct_posts(spark, tmp_path):
    d = spark.createDataFrame([(1, "k"), (2, "k"), (3, "m")], "item_id long, key string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    d.write.parquet(str(tmp_path / "in"))
    s = streaming.distinct_posts(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), ["key"], "ts", "10 minutes")
    q = s.writeStream.format("memory").queryName("posts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("posts").count() == 2
