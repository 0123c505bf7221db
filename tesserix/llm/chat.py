"""Perspective rotation of multi-party dialogues. DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that speaker as
the assistant and everybody else as a named user; only the assistant's words (and the end
mark) are in the loss mask. System turns are context: they are rendered as system in every
perspective and are no perspective of their own.

A dialogue is returned as its turns, one row per (conversation, perspective, turn), each with
its place in the rendered dialogue: seq, and start and end in code points. The dialogue is the
segments joined in seq order. So a conversation of any length is never gathered into one row
or task: rows are dealt by range over (conversation, perspective, turn, ..), down to a row number, so however many turns
a conversation has or however many tie, a task has its share; positions are sums inside a range after the totals of the
ranges before it.

Markup in a text or a name can't pass for markup of the rendering: "<|" becomes "< |" there, and line feeds in a name
become blanks.

Defined results: null role is the speaker "unknown"; null text is empty; null turn comes
first; turns that tie are ordered by role, then by the MD5 of the text; repeated rows are repeated turns; a
null conv_id is a conversation; a conversation of system turns only has no perspective and
no rows; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserix.llm.common import cut, salted

OPEN, CLOSE, NAME = "<|im_start|>", "<|im_end|>\n", " name="


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, seq, turn, speaker, role, segment, start, end, mask_start, mask_end."""
    said = turns.select(
        F.col("conv_id"), F.col("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text"), F.lit("")).alias("body"),
    ).withColumn("is_system", F.col("speaker").isin(*system_roles))
    people = said.filter(~F.col("is_system")).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()

    mine = ~F.col("is_system") & (F.col("speaker") == F.col("perspective"))
    lead = F.concat(
        F.lit(OPEN),
        F.when(F.col("is_system"), F.lit("system\n")).when(mine, F.lit("assistant\n"))
        .otherwise(F.concat(F.lit("user" + NAME), F.replace(_plain(F.col("speaker")), F.lit("\n"), F.lit(" ")), F.lit("\n"))),
    )
    key, order = ["conv_id", "perspective"], ["turn", "speaker", "_sum", "_tie"]
    shown = (
        said.join(people, said["conv_id"].eqNullSafe(people["_conv"]))
        .withColumn("_lead", lead)
        .withColumn("segment", F.concat("_lead", _plain(F.col("body")), F.lit(CLOSE)))
        .select(*key, "turn", "speaker", "is_system", mine.alias("mine"), "segment", F.length("segment").cast("long").alias("_len"), F.length("_lead").alias("_open"), F.md5(F.col("body").cast("binary")).alias("_sum"))
        .withColumn("_tie", F.monotonically_increasing_id())
    )
    placed = cut(shown.repartitionByRange(salted(turns), *key, *order).withColumn("_block", F.spark_partition_id()))
    sums = placed.groupBy(*key, "_block").agg(F.sum("_len").alias("_chars"), F.count("*").alias("_turns"))
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias("_" + k) for k in key], F.col("_block").alias("_b"),
        F.coalesce(F.sum("_chars").over(earlier), F.lit(0)).alias("_char0"),
        F.coalesce(F.sum("_turns").over(earlier), F.lit(0)).alias("_turn0"),
    )
    inside = Window.partitionBy(*key, "_block").orderBy(*order)
    local = placed.withColumn("_n", F.row_number().over(inside)).withColumn("_upto", F.sum("_len").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    at = local.join(starts, local["conv_id"].eqNullSafe(starts["_conv_id"]) & (local["perspective"] == starts["_perspective"]) & (local["_block"] == starts["_b"]))
    end = F.col("_char0") + F.col("_upto")
    return at.select(
        "conv_id", "perspective", (F.col("_turn0") + F.col("_n") - 1).alias("seq"), "turn", "speaker",
        F.when(F.col("is_system"), "system").when(F.col("mine"), "assistant").otherwise("user").alias("role"),
        "segment", (end - F.col("_len")).alias("start"), end.alias("end"),
        F.when(F.col("mine"), end - F.col("_len") + F.col("_open")).alias("mask_start"),
        F.when(F.col("mine"), end).alias("mask_end"),
    )
