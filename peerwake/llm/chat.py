"""Chat formatting by perspective rotation: every participant in turn is the assistant.

For each participant of a conversation the dialogue is rendered with that speaker's turns as the
assistant's and all others as named users; the mask holds the character spans (start, end) of the
assistant's turns, which are to be learnt.

A dialogue is returned in parts of ``PART`` turns in order, so no row grows with the conversation.
A conversation of any length is cut over tasks: rows are dealt by range of (conversation, turn,
speaker, text, row), each piece is numbered apart and shifted by the rows of the pieces before it.
A conversation's rows are its turns times its participants, which is the feature.

Built-in functions only. Defined results: turns are ordered by turn (null first), speaker and text;
a null or empty role is the speaker ``unknown``; null text is rendered as empty; repeated rows are
turns of their own; a null conv_id is a conversation. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import staged

PART = 64
ASSISTANT, USER, END = "<|assistant|>\n", "<|user:{}|>\n", "<|end|>\n"


def _spans(turns: Column, perspective: Column) -> Column:
    """Spans of the perspective's turns in the part's text, with the end mark."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        own = t["speaker"] == perspective
        head = F.when(own, F.lit(len(ASSISTANT))).otherwise(F.length(t["speaker"]) + len(USER) - 2)
        start = acc["at"] + head
        end = start + F.length(t["text"]) + len(END)
        added = F.when(own, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(empty)
        return F.struct(end.alias("at"), F.concat(acc["spans"], added).alias("spans"))

    return F.aggregate(turns, state, step, lambda acc: acc["spans"])


def rotate(conversations: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, perspective, part, n_turns, text, mask): a row for each participant and part."""
    turns = conversations.select("conv_id", "turn", F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown")).alias("speaker"),
                                 F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["turn", "speaker", "text", "row"]
    dealt = staged(turns.repartitionByRange("conv_id", *order).withColumn("shard", F.spark_partition_id()), "dealt-turns")
    counts = dealt.groupBy("conv_id", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col("conv_id").alias("c"), F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    local = dealt.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "shard").orderBy(*order)) - 1)
    ranked = local.join(shifts, F.expr("conv_id <=> c AND shard = s")).withColumn("rank", F.col("k") + F.col("shift"))
    parts = (ranked.groupBy("conv_id", F.floor(F.col("rank") / part).alias("part"))
             .agg(F.sort_array(F.collect_list(F.struct("rank", "speaker", "text"))).alias("turns")))
    speakers = dealt.select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    both = parts.join(speakers, F.expr("conv_id <=> c"))
    mark = lambda t: F.when(t["speaker"] == F.col("perspective"), F.lit(ASSISTANT)).otherwise(F.concat(F.lit("<|user:"), t["speaker"], F.lit("|>\n")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(mark(t), t["text"], F.lit(END))), "")
    return both.select("conv_id", "perspective", "part", F.size("turns").alias("n_turns"), text.alias("text"), _spans(F.col("turns"), F.col("perspective")).alias("mask"))
