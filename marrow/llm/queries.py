"""The registered queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.llm import alignment, chat, decontaminate, hosts, langid, linededup, passages, quality, sentencepieces, simhash, spellings, toxicity, warc
from marrow.llm.common import crc_mod, labelled_sample, read_table, shared_dir
from marrow.llm.oracles import ORACLES

#: Folder of public tokenizer files; never copied here.
TOKENIZERS = os.environ.get("MARROW_TOKENIZERS", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTE_MODEL = f"{TOKENIZERS}/byte_bpe_50k.json"


def _held_out(n: int, rest: int):
    return F.coalesce(crc_mod("id", n) == rest, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    ids = labels.where(F.col("toxic").isin(0, 1) & (crc_mod("doc_id", 3) != 1)).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    model = toxicity.train(labelled_sample(docs, toxicity.SAMPLE_PER_LABEL, ids, salt="toxicity"))
    s = toxicity.score(docs, model)
    return s.select(F.col("id").alias("doc_id"), _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "top_saving", "n_windows")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return r.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sentencepieces.round_trip(read_table(spark, sf_dir, "documents"), sentencepieces.load_vocabulary(PIECE_MODEL))
    return r.select(F.col("id").alias("doc_id"), "n_ids", "exact", "ids")


def train_langid(docs: DataFrame, held_out: int | None = None) -> langid.PpmModel | None:
    """A model of at most SAMPLE_PER_LANG documents of each language (remainder ``held_out`` of 4 left out)."""
    own = docs if held_out is None else docs.where(crc_mod("doc_id", 4) != held_out)
    return langid.train(labelled_sample(own, langid.SAMPLE_PER_LANG, label_col="lang", salt="langid"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    r = langid.identify(docs, train_langid(docs, 2))
    return r.select(F.col("id").alias("doc_id"), _held_out(4, 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = quality.judge(read_table(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = decontaminate.item_windows(read_table(spark, sf_dir, "benchmark"))
    r = decontaminate.find_overlap(read_table(spark, sf_dir, "documents"), windows)
    hit = decontaminate.hit_words()
    return r.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(hit, F.col("n_words")).alias("contaminated"),
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = chat.rotate(read_table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda x: F.concat(x["begin"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return r.select(F.col("conv").alias("conv_id"), "participant", "piece", "begin", "n_turns", "text", mask.alias("mask"))


#: (verdict, host and path) of the URL rules.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hosts.judge(read_table(spark, sf_dir, "pages"), hosts.rule_table(spark, URL_RULES))
    return r.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "trust", "distrust")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive(read_table(spark, sf_dir, "pages"), path)
    stored = warc.read_warc(spark, path).where("record_type = 'response'")
    again = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    full = stored.select(warc.page_of("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    short = again.select(warc.page_of("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))
    return full.select(cols).unionByName(short.select(cols))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = linededup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "text", "n_removed")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    ids = labels.where(F.col("quality").isin(0, 1) & (crc_mod("doc_id", 3) != 1)).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = passages.train(labelled_sample(docs, passages.SAMPLE_PER_LABEL, ids, salt="quality"))
    r = passages.score(docs, model)
    return r.select(F.col("id").alias("doc_id"), _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "attention")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = alignment.align(read_table(spark, sf_dir, "documents"), alignment.load_pair(BYTE_MODEL, PIECE_MODEL), groups="sha256")
    return r.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


#: One occurrence in so many (by its hash) loses a code point.
SPELLING_NOISE = 199


def op13_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spellings.group_spellings(read_table(spark, sf_dir, "documents"), noise=SPELLING_NOISE)
    return r.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_chat": op4_chat,
    "op5_langid": op5_langid,
    "op6_urls": op6_urls,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_linededup": op10_linededup,
    "op11_quality": op11_quality,
    "op12_alignment": op12_alignment,
    "op13_spellings": op13_spellings,
}

__all__ = ["ORACLES", "QUERIES"]
