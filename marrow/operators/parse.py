"""Labels from model output, as column logic without UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.functions import LABELS, SYNONYMS, strip

#: The guard patterns for an output that only lists the classes.
LISTS = (r"bug[,\s]+feature[,\s]+(or\s+)?question", r"feature[,\s]+bug[,\s]+(or\s+)?question", r"bug[,\s]+question[,\s]+(or\s+)?feature")
AFTER_LIST = r"(?is)bug[,\s]+feature[,\s]+(?:or\s+)?question[.\s]*\n*(.*)"
TAG = r"(?is)<label>\s*(.*?)\s*</label>"
TAG_ONE_LINE = r"(?i)<label>\s*(.*?)\s*</label>"
WORD = r"[A-Za-z_\-]+"
#: Text that a failed batch leaves in place of an output, and that of a missing marker.
ERROR, MARKER, NO_MARKER = "ERROR:", "### Response:", "NO_RESPONSE_MARKER"


def _in(values: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in values.items() for v in kv)), c)


_OWN = {v: v for v in LABELS}
_KNOWN = _OWN | SYNONYMS
_SQUASHED = {k.replace("-", "").replace("_", ""): v for k, v in SYNONYMS.items()}


def _squash(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z]", "")


def _first(c: Column) -> Column:
    """Null for an empty match."""
    return F.nullif(c, F.lit(""))


def last_tag(raw: Column) -> Column:
    """Content of the last closed label tag, folded; null without one."""
    return F.lower(strip(F.try_element_at(F.regexp_extract_all(raw, F.lit(TAG), F.lit(1)), F.lit(-1))))


def without_thinking(raw: Column) -> Column:
    closed = F.regexp_replace(raw, r"(?is)<think>.*?</think>", "")
    return strip(F.regexp_replace(closed, r"(?is)<think>.*$", ""))


def parse_label(raw: Column) -> Column:
    """The class of an output, or ``invalid``.

    In this order: the last closed tag (class, synonym, or class once squashed to
    letters); then, without thinking blocks, a list of all classes counts only for what
    follows it; else the first word decides.
    """
    has_tag = F.size(F.regexp_extract_all(raw, F.lit(TAG), F.lit(1))) > 0
    tag = F.when(has_tag, last_tag(raw))
    by_tag = F.coalesce(_in(_KNOWN, tag), _in(_OWN, _squash(tag)))
    s = without_thinking(raw)
    start = F.lower(F.substring(s, 1, 80))
    listed = F.lit(False)
    for pattern in LISTS:
        listed = listed | start.rlike(pattern)
    rest = strip(F.regexp_extract(s, AFTER_LIST, 1))
    in_rest = _in(_OWN, F.lower(_first(strip(F.regexp_extract(rest, TAG_ONE_LINE, 1)))))
    word = lambda x: F.btrim(F.lower(x), F.lit("-_ "))
    words = F.transform(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)), lambda x: _in(_KNOWN, word(x)))
    any_word = F.try_element_at(F.filter(words, lambda x: x.isNotNull()), F.lit(1))
    first = word(_first(F.regexp_extract(s, WORD, 0)))
    by_word = F.coalesce(_in(_KNOWN, first), _in(_OWN, _squash(first)), _in(_SQUASHED, _squash(first)))
    late = F.when(listed, F.coalesce(in_rest, any_word)).otherwise(by_word)
    return F.when(strip(raw) == "", "invalid").otherwise(F.coalesce(by_tag, late, F.lit("invalid")))


def parse_outputs(df: DataFrame, raw_col: str = "raw_output", keep_chars: int = 300) -> DataFrame:
    """Adds predicted_label and parsed_via (xml, regex, failed); cuts the output to ``keep_chars``.

    Failed batches (text starting with ERROR:) and null outputs are invalid.  A tag over
    several lines parses, but counts as regex.
    """
    raw = F.coalesce(F.col(raw_col), F.lit(""))
    failed = F.startswith(raw, F.lit(ERROR))
    out = df.withColumn("predicted_label", F.when(failed, "invalid").otherwise(parse_label(raw)))
    xml = raw.rlike(r"(?i)<label>.*?</label>")
    via = F.when(F.col("predicted_label") == "invalid", "failed").when(xml, "xml").otherwise("regex")
    return out.withColumn("parsed_via", via).withColumn(raw_col, F.substring(raw, 1, keep_chars))


def parse_keyword(raw: Column) -> Column:
    """The first class that stands as a word of its own, or ``invalid``."""
    return F.coalesce(F.lower(_first(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?iU)\b(bug|feature|question)\b", 1))), F.lit("invalid"))


def after_marker(df: DataFrame, raw_col: str = "raw_output") -> DataFrame:
    """Keeps what follows the last response marker and parses it by keyword; no marker: invalid."""
    raw = F.coalesce(F.col(raw_col), F.lit(""))
    has = F.contains(raw, F.lit(MARKER))
    text = strip(F.substring_index(raw, MARKER, -1))
    label = F.when(has, parse_keyword(text)).otherwise("invalid")
    return df.withColumn("predicted_label", label).withColumn("parsed_via", F.when(label == "invalid", "failed").otherwise("regex")).withColumn(raw_col, F.when(has, text).otherwise(NO_MARKER))


def error_rows(parsed: DataFrame, by: list[str], raw_col: str = "raw_output") -> DataFrame:
    return parsed.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.startswith(F.col(raw_col), F.lit(ERROR)), 1)).alias("n_errors")).withColumn("error_rate", F.round(F.col("n_errors") / F.col("n"), 6))


def parse_report(parsed: DataFrame, by: list[str]) -> DataFrame:
    g = parsed.groupBy(*by).agg(F.count("*").alias("n"), *(F.count(F.when(F.col("parsed_via") == v, 1)).alias(f"n_{v}") for v in ("xml", "regex", "failed")))
    for v in ("xml", "regex", "failed"):
        g = g.withColumn(f"pct_{v}", F.round(F.col(f"n_{v}") * 100.0 / F.col("n"), 4))
    return g
