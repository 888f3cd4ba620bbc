"""Item, neighbour and prediction tables as files: readers that check columns, writers that can skip."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.operators.curate import conform_items

NEIGHBOR_COLUMNS = ("test_id", "neighbor_rank", "similarity", "neighbor_label")
PREDICTION_COLUMNS = ("ground_truth", "predicted_label")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share.

    Where that isn't set, a local master gets a temporary folder (tests); a cluster gets an
    error, since its executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return f"{named}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: what follows doesn't repeat the work before it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def check_columns(df: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header, quoted fields and line breaks in them; with no schema every column is text."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    return (r.schema(schema) if schema else r).csv(path)


def read_items(spark: SparkSession, path: str, id_col: str = "item_id") -> DataFrame:
    """Items from CSV with a column that gives their order."""
    return conform_items(read_csv(spark, path).withColumn(id_col, F.col(id_col).cast("long")), id_col)


def load_neighbors(df: DataFrame, k: int) -> DataFrame:
    """One row per query with its neighbours below rank k as an array in rank order.

    With a column k (one list per k in the same table) the wanted k is read, or the
    largest there is when it is absent.
    """
    check_columns(df, NEIGHBOR_COLUMNS)
    if "k" in df.columns:
        have = df.agg(F.max("k").alias("largest"), F.max(F.when(F.col("k") == k, F.col("k"))).alias("wanted"))
        df = df.join(F.broadcast(have), F.col("k") == F.coalesce("wanted", "largest")).drop("largest", "wanted")
    near = F.struct(F.col("neighbor_rank"), F.col("similarity"), F.col("neighbor_label"))
    return df.where(F.col("neighbor_rank") < k).groupBy("test_id").agg(F.array_sort(F.collect_list(near)).alias("neighbors"))


#: Written last into a folder, hidden from readers: the name and length of each file.
MANIFEST = "_manifest.json"


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, which reaches whatever store Spark writes to, and a maker of its paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    """Length of every data file below a folder, by its name within."""
    fs, at = _fs(spark, path)
    top = fs.getFileStatus(at(path)).getPath().toString()
    found, each = {}, fs.listFiles(at(path), True)
    while each.hasNext():
        f = each.next()
        name = f.getPath().toString()[len(top) + 1 :]
        if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
            found[name] = f.getLen()
    return found


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What a finished write left: format and files; None where it didn't finish."""
    fs, at = _fs(spark, path)
    file = at(f"{path}/{MANIFEST}")
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    except ValueError:  # cut off while it was written
        return None
    except Py4JJavaError as e:  # the same, where the store has checksums
        if "ChecksumException" not in e.java_exception.getClass().getName():
            raise
        return None
    finally:
        stream.close()


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds all that a finished write put there (or, without our manifest, Spark's own mark of success)."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return False
    found = manifest(spark, path)
    if found is None:
        return fs.exists(at(f"{path}/_SUCCESS")) and not fs.exists(at(f"{path}/{MANIFEST}"))
    have = _files(spark, path)
    return all(have.get(name) == size for name, size in found["files"].items())


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", by: tuple[str, ...] = ()) -> bool:
    """Write a table so that its folder is whole or not there; whether it was written.

    Rows go to a staging folder beside it, which takes the name at the end; a manifest of
    its files then says that all is there.  Mode "ignore" skips a complete table.  One
    that a failed or interrupted job left incomplete isn't skipped: it is set aside under
    another name (``.incomplete-``), and the table is written.  Mode "error" raises where the folder exists,
    "overwrite" replaces it, "append" adds to it without staging.
    """
    spark = df.sparkSession
    fs, at = _fs(spark, path)
    exists = fs.exists(at(path))
    if mode == "ignore" and exists and complete(spark, path):
        return False
    if mode == "error" and exists:
        raise ValueError(f"{path} exists")
    if mode not in ("error", "ignore", "overwrite", "append"):
        raise ValueError(f"unknown mode {mode}")
    w = df.write.format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"').option("quote", '"')
    w = w.partitionBy(*by) if by else w
    if mode == "append":
        w.mode("append").save(path)
    else:
        staging = f"{path}.staging-{uuid.uuid4().hex}"
        w.save(staging)
        if exists:
            fs.rename(at(path), at(f"{path}.{'incomplete' if mode == 'ignore' else 'replaced'}-{uuid.uuid4().hex}"))
        if not fs.rename(at(staging), at(path)):
            raise OSError(f"{staging} can't be renamed")
    _commit(spark, path, fmt)
    return True


def _commit(spark: SparkSession, path: str, fmt: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at(f"{path}/{MANIFEST}"), True)
    try:
        out.write(bytearray(json.dumps({"format": fmt, "files": _files(spark, path)}).encode()))
    finally:
        out.close()


def store_neighbors(neighbors: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """A neighbour table in ``buckets`` by test_id, in rank order within them, as a catalog table at ``path``.

    Votes, debiasing and prompts, which group or window by test_id, then read it without a
    shuffle.  The number of buckets should be that of the tasks that are to read it.
    """
    w = check_columns(neighbors, NEIGHBOR_COLUMNS).repartition(buckets, "test_id").write.format("parquet")
    w.bucketBy(buckets, "test_id").sortBy("test_id", "neighbor_rank").option("path", path).mode("error").saveAsTable(table)
    return neighbors.sparkSession.table(table)


def write_splits(split: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Train and test tables, and their titles and labels apart; each folder is complete or not there."""
    for s in ("train", "test"):
        own = split.where(F.col("split") == s).drop("split")
        write(own, f"{path}/{s}_split", fmt, mode)
        write(own.select("item_id", "title", "labels"), f"{path}/{s}_split_info", fmt, mode)


def write_neighbors(neighbors: DataFrame, path: str, mode: str = "error") -> None:
    """One table with a folder per k."""
    write(check_columns(neighbors, (*NEIGHBOR_COLUMNS, "k")), path, "parquet", mode, ("k",))


def write_predictions(preds: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    write(check_columns(preds, PREDICTION_COLUMNS), path, fmt, mode)


def log_rows(preds: DataFrame, id_col: str = "item_id", chars: int = 500) -> DataFrame:
    return preds.select(id_col, F.substring("raw_output", 1, chars).alias("raw_output"), F.col("predicted_label").alias("parsed_label"), "ground_truth")


def write_log(preds: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines with outputs cut to 500 characters."""
    write(log_rows(preds), path, "json", mode)
