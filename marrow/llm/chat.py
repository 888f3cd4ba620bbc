"""Chat formatting with rotating perspectives, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as
the assistant and all others as named users; the mask holds the character ranges of the
assistant's own words and end mark, the only ones to train on.

A row holds the turns of TURNS consecutive turn numbers (nearly always the whole
dialogue), so that a conversation of any length is rendered in pieces that tasks share;
``begin`` is where the piece starts in the whole rendering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers in one piece.
TURNS = 256
NOBODY = "unknown"
END = "<|end|>\n"


def _plain(c):
    """Text that can't pass for a mark."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def _name(c):
    """A name that can't end its mark: no mark of either kind, no line break."""
    return F.translate(F.replace(_plain(c), F.lit("|>"), F.lit("| >")), "\n\r", "  ")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns_in_piece: int = TURNS) -> DataFrame:
    """(conv, participant, piece, begin, n_turns, text, mask): one row per conversation, participant and piece.

    ``mask`` is an array of (begin, end) in characters of ``text``.  A null role is the
    participant "unknown", a null text is empty; turns go by number (nulls first), then by
    role and text, and repeated rows are rendered as often as they come.  A null
    conversation id is a conversation of its own.  Other columns are not read.
    """
    src = turns.select(
        turns[conv_col].alias("conv"),
        turns[turn_col].alias("turn"),
        F.when(turns[role_col].isNull(), NOBODY).otherwise(_name(turns[role_col])).alias("role"),
        _plain(turns[text_col]).alias("text"),
    ).withColumn("piece", F.coalesce(F.floor(F.col("turn") / turns_in_piece), F.lit(-1)).cast("long"))
    pieces = src.groupBy("conv", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = src.groupBy("conv").agg(F.array_sort(F.collect_set("role")).alias("speakers")).withColumnRenamed("conv", "of")
    each = pieces.join(speakers, F.col("conv").eqNullSafe(F.col("of"))).select("conv", "piece", "turns", F.explode("speakers").alias("participant"))
    head = lambda t: F.when(t["role"] == F.col("participant"), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n")))
    shown = each.withColumn("heads", F.transform("turns", head))
    shown = shown.withColumn("bodies", F.transform("turns", lambda t: F.concat(t["text"], F.lit(END))))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))

    def step(acc, i):
        start = acc["at"] + F.length(F.get("heads", i))
        end = start + F.length(F.get("bodies", i))
        own = F.get("turns", i)["role"] == F.col("participant")
        return F.struct(end.alias("at"), F.when(own, F.concat(acc["spans"], F.array(F.struct(start.alias("begin"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    shown = shown.withColumn("walk", F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), empty, step))
    whole = Window.partitionBy("conv", "participant").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return shown.select(
        "conv",
        "participant",
        "piece",
        F.coalesce(F.sum("walk.at").over(whole), F.lit(0)).cast("long").alias("begin"),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b)), "").alias("text"),
        F.col("walk.spans").alias("mask"),
    )
