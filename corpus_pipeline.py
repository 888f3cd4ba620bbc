"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them to
documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.llm import decontaminate, langid, linededup, nearcopies, sentencepieces, simhash
from marrow.llm.common import checkpointed, read_table, shared_dir, small_side
from marrow.llm.queries import PIECE_MODEL, train_langid

#: A document whose best language scores less is rejected, as is one without a letter.
LEAST_LANG_SCORE = 0.5
#: Words in a shingle of the near-dedup stage, and bits in which linked fingerprints may differ.
SHINGLE, DISTANCE = 5, 3
#: Documents of this similarity of shingle sets are near copies as well.
SIMILARITY = 0.8
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id isn't among ``ids`` (column id); a null id stays."""
    gone = small_side(checkpointed(ids.where("id is not null").distinct().withColumnRenamed("id", "gone")))
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that no learned language fits clearly."""
    r = langid.identify(docs, train_langid(docs), keep=COLUMNS)
    return r.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANG_SCORE)).select(*(F.col(f"keep_{c}").alias(c) for c in COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete repeated runs; a document of which no word is left goes."""
    r = linededup.dedup_lines(docs, keep=("lang", "source"))
    r = r.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return r.select(F.col("id").alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, by fingerprint and by shingle set, the smallest doc_id stays."""
    prints = simhash.near_duplicates(docs, shingle=SHINGLE, distance=DISTANCE)
    sets = nearcopies.near_copies(docs, shingle=SHINGLE, similarity=SIMILARITY)
    return _without(docs, prints.select("id", "component_id").unionByName(sets).where("id <> component_id").select("id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth of the words or more lies in benchmark windows."""
    windows = decontaminate.item_windows(read_table(spark, sf_dir, "benchmark"))
    r = decontaminate.find_overlap(docs, windows)
    return _without(docs, r.where(decontaminate.is_contaminated(decontaminate.hit_words(), F.col("n_words"))).select("id"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, decoded text, n_ids, exact and ids of every document."""
    r = sentencepieces.round_trip(docs, sentencepieces.load_vocabulary(PIECE_MODEL), keep_text=True)
    return r.select(F.col("id").alias("doc_id"), F.col("decoded").alias("text"), "n_ids", "exact", "ids")


STAGES = [("language ID", language), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminated), ("SentencePiece", tokens)]

#: No SQL: the language model and the search for pieces can't be written in it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = os.path.join(folder, str(k))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
