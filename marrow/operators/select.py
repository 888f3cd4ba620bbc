"""Exact order statistics of groups of any size, by histograms of digits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.sources import stored

#: Bits of a digit; a histogram has 2 ** DIGIT places.
DIGIT = 12


#: Flips the sign, so that the order of numbers is that of their bits.
_SIGN = -(1 << 63)


def _above(u: str, bits: int) -> Column:
    """The bits of a column above the lowest ``bits``."""
    return F.shiftrightunsigned(u, bits) if bits < 64 else F.lit(0).cast("long")


def _meet(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """An inner join on columns of which some may be null; those of the right side go."""
    named = right.select(*(F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols))
    return left.join(named, on).drop(*(f"_r_{c}" for c in cols))


def percentiles(df: DataFrame, by: list[str], col: str, shares: list[float]) -> DataFrame:
    """(by.., p0, p1, ..): exact linear percentiles of a whole-number column, one column a share.

    The wanted ranks of a group are looked for digit by digit, from the highest: counts by
    (group, prefix, digit) tell in which prefix a rank lies, and only rows with such a prefix
    are counted at the next digit.  A histogram has 2 ** DIGIT rows at most, whatever the
    group has, so no task and no buffer holds a group's values.  The column is written once
    and read as often as its range has digits.  Null values are left out; a group without
    values has no row; null group keys are a group.
    """
    v = stored(df.select(*by, F.col(col).cast("long").alias("v"), F.lit(0).alias("all")).where("v is not null"))
    keys = [*by, "all"]
    low, high = v.agg(F.min("v"), F.max("v")).first()
    # bits above the highest in which any two values differ are all the same
    digits = -(-max(1, ((low or 0) ^ (high or 0)).bit_length()) // DIGIT) if (low or 0) >= 0 or (high or 0) < 0 else -(-64 // DIGIT)
    v = v.withColumn("v", F.col("v").bitwiseXOR(F.lit(_SIGN)))
    start = ((low or 0) + (1 << 63)) >> (digits * DIGIT)
    n = v.groupBy(*keys).agg(F.count("*").alias("rows"))
    place = [F.lit(float(x)) * (F.col("rows") - 1) for x in shares]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x), F.ceil(x)) for x in place))))
    at = n.select(*keys, F.explode(ranks).alias("rank")).select(*keys, "rank", F.lit(start).cast("long").alias("prefix"), F.col("rank").alias("rest"))
    for d in reversed(range(digits)):
        rows = v.withColumn("prefix", _above("v", (d + 1) * DIGIT))
        if d < digits - 1:
            rows = _meet(rows, at.select(*keys, "prefix").distinct(), [*keys, "prefix"])
        digit = _above("v", d * DIGIT).bitwiseAND(F.lit((1 << DIGIT) - 1))
        counts = rows.groupBy(*keys, "prefix", digit.alias("digit")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "prefix").orderBy("digit"))  # 2 ** DIGIT rows at most
        found = _meet(at, counts.withColumn("upto", upto), [*keys, "prefix"]).where("rest < upto and rest >= upto - n")
        at = found.select(*keys, "rank", F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit")).alias("prefix"), (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))
    value = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("prefix").bitwiseXOR(F.lit(_SIGN))))
    both = _meet(n, at.select(*keys, "rank", "prefix"), keys).groupBy(*keys, "rows").agg(*(value(f(x)).alias(f"{name}{k}") for k, x in enumerate(place) for f, name in ((F.floor, "_lo"), (F.ceil, "_hi"))))
    lines = [F.when(F.floor(x) == F.ceil(x), F.col(f"_lo{k}").cast("double")).otherwise((F.ceil(x) - x) * F.col(f"_lo{k}") + (x - F.floor(x)) * F.col(f"_hi{k}")).alias(f"p{k}") for k, x in enumerate(place)]
    return both.select(*by, *lines)
