"""Line dedup by winnowing over line hashes, with DataFrame and SQL functions only.

A line ends at a line break, and at each blank behind a mark of a clause or one common
letter (ENDS), so that a passage falls into the same lines wherever it stands in a
paragraph.  Lines have some four or five words; they are compared without the line break.

1. Winnow: a gram is GRAM lines in a row.  Of every WINDOW neighbouring grams the one whose
   first line has the least hash is a fingerprint.  Two texts that share RUN_LINES =
   GRAM + WINDOW - 1 lines in a row share all grams of a window, and so its fingerprint:
   that is the guarantee.
2. Join positions: of each fingerprint that occurs more than once, the place with the least
   (id, position) is its head; all other places are joined to it.
3. Extend both ways: from a joined pair of places, lines are compared up to REACH lines to
   the left and right.  This reaches past every neighbouring fingerprint, so pairs
   of one run cover all of it.
4. Delete: the matches of a text, whatever heads they have, form a chain as long as at most GAP lines
   lie between them (matches that overlap their head's own in the same text don't count).  The
   matched lines of a chain go if they have RUN_WORDS words or more.  So runs of short lines
   and runs whose parts first occur in different texts go as well.

All of a text's lines are worked out inside its row; only fingerprints are shuffled, and
of those that are joined the REACH lines on either side.  Heads are one row for each
fingerprint, written before they are joined, so that Spark may split a hot one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.llm.common import small_side, stored

#: Lines in a gram, and grams of which the least is a fingerprint.
GRAM, WINDOW = 3, 5
#: A run of so many lines has a fingerprint for sure.
RUN_LINES = GRAM + WINDOW - 1
#: Fewest words of a chain of matches that goes.
RUN_WORDS = 24
#: Lines compared on either side of a fingerprint; at least WINDOW - 1 to cover every run.
REACH = 6
#: Most lines between two matches of a chain: fingerprints of a run are WINDOW lines apart at most.
GAP = WINDOW - GRAM
#: A blank behind one of these ends a line, as does a line break.
ENDS = ".!?,;:r"
#: A line of more bytes is cut, from its start, in lines of PIECE words: text without such ends (one word
#: over and over, for one) has lines as well.
LONGEST, PIECE = 160, 4
#: White space that may stand around a line break.
HANGING = "\n\t\r\x0b\x0c "
#: Bits of a line's number that hold its words (up to 63); the rest are a hash.
_COUNT = 63


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def parts(text: Column) -> Column:
    """The lines of a text; joined by blanks, and "\\n " made "\\n", they give the text."""
    whole = F.split(F.replace(text, F.lit("\n"), F.lit("\n ")), f"(?<=[{ENDS}\n]) ")

    cut = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(PIECE)), lambda i: F.array_join(F.slice(w, i + 1, PIECE), " "))
    long = lambda line: F.octet_length(line) > LONGEST
    pieces = lambda line: F.when(long(line), _bind(F.split(line, " "), cut)).otherwise(F.array(line))
    return _bind(whole, lambda own: F.when(F.exists(own, long), F.flatten(F.transform(own, pieces))).otherwise(own))


def _bare(line: Column) -> Column:
    return F.when(F.endswith(line, F.lit("\n")), F.btrim(line, F.lit(HANGING))).otherwise(line)


def _number(bare: Column) -> Column:
    """A hash of a line and its number of words (blanks and one)."""
    words = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "))) + 1
    return F.xxhash64(bare).bitwiseAND(F.lit(~_COUNT)).bitwiseOR(F.least(words, F.lit(_COUNT)))


def _upto(n: Column) -> Column:
    """0 .. n-1, empty if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _chosen(bare: Column) -> Column:
    """Places (line numbers) of the grams that are the least of a window."""
    n = F.size(bare)

    def places(orders: Column) -> Column:
        least = F.transform(_upto(n - RUN_LINES + 1), lambda i: F.least(*(F.get(orders, i + j) for j in range(WINDOW))))
        # a window's least is at most its own gram's order, so it is that gram's if any window has it
        return _bind(least, lambda m: F.filter(_upto(n - GRAM + 1), lambda j: F.greatest(*(F.get(m, j - d) for d in range(WINDOW))) == F.get(orders, j)))

    return F.when(n >= RUN_LINES, _bind(F.transform(bare, lambda x: F.md5(x)), places)).otherwise(F.array().cast("array<int>"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, numbers, chosen): the lines of each text that has a fingerprint, and the fingerprints' places.

    key is a hash of id and text; together with the id it names a text.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null")

    both = lambda bare: F.struct(F.transform(bare, _number).alias("numbers"), _chosen(bare).alias("chosen"))
    each = src.select("id", F.xxhash64("id", "text").alias("key"), F.explode(F.array(_bind(F.transform(parts(F.col("text")), _bare), both))).alias("x"))
    return each.where(F.size("x.chosen") > 0).select("id", "key", "x.numbers", "x.chosen")


def _distinct(texts: DataFrame) -> DataFrame:
    """One row of each (id, key); rows that come once, nearly all, don't move."""
    again = stored(texts.groupBy("key", "id").agg(F.count("*").alias("copies")).where("copies > 1").select(F.col("key").alias("akey"), F.col("id").alias("aid")))
    if again.isEmpty():
        return texts
    same = (F.col("key") == F.col("akey")) & F.col("id").eqNullSafe(F.col("aid"))
    once, more = texts.join(again, same, "left_anti"), texts.join(again, same, "left_semi")
    return stored(once.unionByName(more.dropDuplicates(["key", "id"])))


def _places(texts: DataFrame) -> DataFrame:
    """(gram, id, key, at) of every fingerprint."""
    gram = lambda j: F.xxhash64(*(F.get("numbers", j + k) for k in range(GRAM)))
    return texts.select("id", "key", F.inline(F.transform("chosen", lambda j: F.struct(gram(j).alias("gram"), j.alias("at"))))).select("gram", "id", "key", "at")


def _around(at: Column) -> list[Column]:
    """The lines in front of a gram, nearest first, and behind it, by the upper half of their numbers."""
    number = lambda i: F.shiftright(F.get("numbers", i), 32).cast("int")
    left = [number(at - k) for k in range(1, REACH + 1)]
    right = [number(at + GRAM - 1 + k) for k in range(1, REACH + 1)]
    return [F.array(*left).alias("left"), F.array(*right).alias("right")]


def _same(numbers: Column, first: Column, step: int, head: Column) -> Column:
    """How many lines from ``first`` on, going by ``step``, are those of a head."""
    out = F.lit(REACH)
    for k in range(REACH - 1, -1, -1):
        own = F.shiftright(F.get(numbers, first + step * k), 32).cast("int")
        out = F.when(F.coalesce(own == F.get(head, F.lit(k)), F.lit(False)), out).otherwise(k)
    return out


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = RUN_WORDS) -> DataFrame:
    """(id, key, ranges): for each text with a later copy of a run, the line ranges (s, e) to delete, in order."""
    texts = _distinct(stored(lines(docs, id_col, text_col)))
    places = _places(texts)
    heads = places.groupBy("gram").agg(F.count("*").alias("copies"), F.min(F.struct("id", "key", "at")).alias("head")).where("copies > 1")
    heads = stored(heads.select("gram", F.col("head.id").alias("hid"), F.col("head.key").alias("hkey"), F.col("head.at").alias("hat")))
    of_head = texts.select(F.col("id").alias("tid"), F.col("key").alias("tkey"), "numbers")
    heads = stored(heads.join(of_head, (F.col("hkey") == F.col("tkey")) & F.col("hid").eqNullSafe(F.col("tid"))).select("gram", "hid", "hkey", "hat", *_around(F.col("hat"))).dropDuplicates(["gram"]))
    later = places.join(heads.withColumnRenamed("left", "hleft").withColumnRenamed("right", "hright"), "gram").where(F.struct("id", "key", "at") > F.struct("hid", "hkey", "hat"))
    later = later.withColumn("own", (F.col("key") == F.col("hkey")) & F.col("id").eqNullSafe(F.col("hid")))
    # back to the text, for the lines around each place: its places in one row (no more than it has
    # lines), so that its lines are read once; what goes on is small
    place = F.struct("at", F.when(F.col("own"), F.col("hat")).alias("hat"), "hleft", "hright")
    later = later.groupBy("key", "id").agg(F.collect_list(place).alias("places"))
    met = later.join(of_head, (F.col("key") == F.col("tkey")) & F.col("id").eqNullSafe(F.col("tid")))
    numbers = F.col("numbers")

    def span(p: Column) -> Column:
        ends = F.struct((p["at"] - _same(numbers, p["at"] - 1, -1, p["hleft"])).alias("s"), (p["at"] + GRAM - 1 + _same(numbers, p["at"] + GRAM, 1, p["hright"])).alias("e"))
        counts = lambda x: F.transform(F.slice(numbers, x["s"] + 1, x["e"] - x["s"] + 1), lambda y: y.bitwiseAND(F.lit(_COUNT)).cast("byte"))
        return _bind(ends, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), (p["hat"] + x["e"] - p["at"]).alias("before"), counts(x).alias("counts")))

    spans = met.select("id", "key", F.inline(F.transform("places", span))).where("before is null or s > before").drop("before")
    w = Window.partitionBy("key", "id").orderBy("s", "e")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)

    def chained(df: DataFrame, apart: int) -> DataFrame:
        """Adds island: ranges with at most ``apart`` lines between them share one."""
        df = df.withColumn("reach", F.max("e").over(before))
        return df.withColumn("island", F.sum(F.when(F.col("s") <= F.col("reach") + 1 + apart, 0).otherwise(1)).over(upto))

    def add(acc: Column, x: Column) -> Column:
        new = F.slice(x["counts"], F.greatest(acc["reach"] + 1 - x["s"], F.lit(0)) + 1, F.greatest(x["e"] - F.greatest(acc["reach"], x["s"] - 1), F.lit(0)))
        return F.struct(F.greatest(acc["reach"], x["e"]).alias("reach"), F.aggregate(new, acc["words"], lambda n, c: n + c.cast("long")).alias("words"))

    start = F.struct(F.lit(-1).alias("reach"), F.lit(0).cast("long").alias("words"))
    merged = chained(spans, 0).groupBy("key", "id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_sort(F.collect_list(F.struct("s", "e", "counts"))).alias("all"))
    merged = merged.select("key", "id", "s", "e", F.aggregate("all", start, add, lambda acc: acc["words"]).alias("words"))
    total = chained(merged, GAP).withColumn("total", F.sum("words").over(Window.partitionBy("key", "id", "island")))
    return total.where(F.col("total") >= words).groupBy("key", "id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("ranges"))


def _without(text: Column, ranges: Column) -> Column:
    """The text without the line ranges; it is cut once."""
    n = F.size(ranges)

    def rest(own: Column) -> Column:
        begin = lambda i: F.when(i == 0, 0).otherwise(F.get(ranges, i - 1)["e"] + 1)
        end = lambda i: F.when(i == n, F.size(own)).otherwise(F.get(ranges, i)["s"])
        return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(own, begin(i) + 1, end(i) - begin(i))))

    return F.replace(F.array_join(_bind(parts(text), rest), " "), F.lit("\n "), F.lit("\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = RUN_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, text without later repeated runs, n_removed (lines), and the columns ``keep``.

    White space between lines goes with them.  A null text stays null, an empty or short
    one stays as it is.  Ids may repeat or be null: the order of places is by id (nulls
    first), then by a hash of id and text; rows with equal id and text are one text and
    get one result each.  Columns outside ``keep`` are not read, so names can't clash.
    """
    ranges = stored(repeated_runs(docs, id_col, text_col, words)).select(F.col("key").alias("rkey"), F.col("id").alias("rid"), "ranges")
    ranges = small_side(ranges, 64 + F.size("ranges") * 24)
    src = docs.select(F.xxhash64(docs[id_col], docs[text_col]).alias("key"), docs[id_col].alias("id"), docs[text_col].alias("text"), *(docs[c].alias(f"keep_{c}") for c in keep))
    both = src.join(ranges, (F.col("key") == F.col("rkey")) & F.col("id").eqNullSafe(F.col("rid")), "left")
    return both.select(
        "id",
        F.when(F.col("ranges").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("ranges"))).alias("text"),
        F.coalesce(F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, r: acc + r["e"] - r["s"] + 1), F.lit(0).cast("long")).alias("n_removed"),
        *(F.col(f"keep_{c}").alias(c) for c in keep),
    )
