"""Chat formatting: every dialogue from the view of each of its participants.

For every participant the dialogue is rendered with that speaker as the assistant,
all others as named users and system turns as they are; the mask holds the spans of
what the assistant says.  segments() gives a row for each turn and view,
rotate_perspectives() the rendered text and its mask.

A dialogue is rendered in parts of TURNS turn numbers, so one of any length is never
gathered in one task; joined in order of part, the parts are the dialogue, and their
masks count from the start of the part.  Where more than ROWS rows have turn numbers
of one part (many rows of one turn, or without a number), the part is split further
by a hash of speaker and text.

What a turn says cannot forge markers: of ``<|`` in a text the signs are parted by a
backslash (one more where there are some), which unescaped() takes out again; names
in a marker have the signs ``|<>`` and line breaks replaced by ``_``.

Defined results: a null role is a participant of its own, a user without a name; a
null text is empty; rows with a null conversation id form one dialogue; a dialogue
of system turns alone has no view; repeated rows stay repeated; rows of the same turn
follow each other by speaker and text, nulls first; extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers of a part, and rows from which a part is split by hash.
TURNS, ROWS = 64, 4096
HEAD, NAMED, TAIL = "<|{}|>\n", "<|user name={}|>\n", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _spoken(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).alias("speaker"), F.coalesce(text, F.lit("")).alias("_body"))


def _viewed(t: DataFrame, system: str) -> DataFrame:
    """t with a row for each view: perspective, chat_role, segment, and _head, the length of the marker in front."""
    told = F.coalesce(F.col("speaker") == system, F.lit(False))
    # partial aggregation leaves a few rows for each dialogue
    views = t.where(~told).select(F.col("_conv").alias("_own"), F.col("speaker").alias("perspective")).distinct()
    both = t.join(views, F.col("_conv").eqNullSafe(F.col("_own"))).drop("_own")
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    name = F.regexp_replace("speaker", r"[|<>\r\n]", "_")
    before, after = NAMED.split("{}")
    head = F.when(told, HEAD.format("system")).when(own, HEAD.format("assistant")).when(F.col("speaker").isNull(), HEAD.format("user")).otherwise(F.concat(F.lit(before), name, F.lit(after)))
    return both.select(
        *t.columns, "perspective",
        F.when(told, "system").when(own, "assistant").otherwise("user").alias("chat_role"),
        F.concat(head, escaped(F.col("_body")), F.lit(TAIL)).alias("segment"), F.length(head).alias("_head"),
    )


def segments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """(conv, turn, perspective, speaker, chat_role, segment, train): a row for each turn and view."""
    out = _viewed(_spoken(turns, conv, turn, role, text), system)
    return out.select(F.col("_conv").alias(conv), F.col("_turn").alias(turn), "perspective", "speaker", "chat_role", "segment", (F.col("chat_role") == "assistant").alias("train"))


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """(conv, perspective, part, split, n_turns, dialogue, mask): the parts of each dialogue in each view.

    mask: array<struct<first,stop>>, the characters of dialogue that the assistant
    says, end markers included; split is 0 but for parts split by hash.
    """
    t = _spoken(turns, conv, turn, role, text).withColumn("part", F.floor(F.col("_turn") / TURNS))
    crowded = t.groupBy("_conv", "part").agg(F.count("*").alias("_n")).where(F.col("_n") > ROWS)
    crowded = crowded.select(F.col("_conv").alias("_c"), F.col("part").alias("_p"), F.ceil(F.col("_n") / ROWS).alias("_splits"))
    t = t.join(crowded, F.col("_conv").eqNullSafe(F.col("_c")) & F.col("part").eqNullSafe(F.col("_p")), "left").drop("_c", "_p")
    t = t.withColumn("split", F.coalesce(F.pmod(F.xxhash64("speaker", "_body"), "_splits"), F.lit(0))).drop("_splits")
    said = F.struct("_turn", "speaker", "_body", "segment", (F.col("chat_role") == "assistant").alias("train"), "_head")
    whole = _viewed(t, system).groupBy("_conv", "perspective", "part", "split").agg(F.sort_array(F.collect_list(said)).alias("_all"))  # about ROWS rows
    spans = F.aggregate(
        "_all",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,stop:int>>").alias("mask")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["segment"])).alias("at"),
            F.when(x["train"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + x["_head"]).alias("first"), (acc["at"] + F.length(x["segment"])).alias("stop"))))).otherwise(acc["mask"]).alias("mask"),
        ),
        lambda acc: acc["mask"],
    )
    return whole.select(F.col("_conv").alias(conv), "perspective", "part", "split", F.size("_all").alias("n_turns"), F.array_join(F.col("_all.segment"), "").alias("dialogue"), spans.alias("mask"))
