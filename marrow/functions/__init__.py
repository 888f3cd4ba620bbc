"""Column functions: text cleaning, labels, tokens and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three classes, and words that stand for one of them.
LABELS = ("bug", "feature", "question")
SYNONYMS = {
    "enhancement": "feature",
    "feature-request": "feature",
    "feature_request": "feature",
    "feat": "feature",
    "request": "feature",
    "bugfix": "bug",
    "defect": "bug",
    "issue": "bug",
    "fix": "bug",
    "support": "question",
    "howto": "question",
    "help": "question",
}
#: A token of the default counter: a word or a sign, with the white space in front of it.
TOKEN = r"\s*[A-Za-z0-9_]+|\s*[^A-Za-z0-9_\s]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)^\s+|\s+$", "")


def clean_text(c: Column | str) -> Column:
    """White space runs become one blank, ends are stripped; null becomes empty."""
    return strip(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)\s+", " "))


def fold_label(c: Column | str) -> Column:
    return F.lower(strip(c))


def canonical_label(c: Column | str) -> Column:
    """A folded label with its synonym resolved; unknown labels pass through."""
    x = fold_label(c)
    known = F.create_map(*(F.lit(v) for kv in SYNONYMS.items() for v in kv))
    return F.coalesce(F.try_element_at(known, x), x)


def is_valid(c: Column | str) -> Column:
    return _col(c).isin(*LABELS)


def content_key(title: Column | str, body: Column | str) -> Column:
    """md5 of the folded title and body; labels aren't part of it."""
    return F.md5(F.concat(F.lower(strip(title)), F.lit("||"), F.lower(strip(body))))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(TOKEN), F.lit(0))


def n_tokens(c: Column | str) -> Column:
    """Default token count; any Column -> Column function can stand in its place."""
    return F.size(tokens(c)).cast("long")


def cut_tokens(c: Column | str, most: Column, mark: str = "...") -> Column:
    """The first ``most`` tokens, right-stripped, with ``mark``; as it is when short enough.  The text is tokenised once."""
    text = F.coalesce(_col(c), F.lit(""))

    def cut(t: Column) -> Column:
        head = F.array_join(F.slice(t, F.lit(1), F.greatest(most, F.lit(0)).cast("int")), "")
        return F.when(F.size(t) > most, F.concat(F.regexp_replace(head, r"\s+$", ""), F.lit(mark))).otherwise(text)

    return F.transform(F.array(tokens(c)), cut)[0]


def norm(v: Column | str) -> Column:
    """L2 norm, summed in order in double precision."""
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector in double precision; a zero vector stays as it is.  The norm is bound once."""
    scaled = lambda n: F.transform(_col(v), lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))
    return F.transform(F.array(norm(v)), scaled)[0]


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision, 0 where b is 0."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
