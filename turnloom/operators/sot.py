"""Serialised transcripts: one line ``<speaker> start->end: text`` for each utterance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import LINE_BREAK, ends_with_marker, float_text
from turnloom.schemas import WORDS

LINE = r"(?s)\A<(.*?)> (.*?)->(.*?): (.*)\z"


def invalid_field(speaker: Column, start: Column, end: Column, text: Column) -> Column:
    """What keeps an utterance from being a line, or null. Stricter than newlines alone: any line break would not read back."""
    return (
        F.when(speaker.rlike(LINE_BREAK) | text.rlike(LINE_BREAK), "line break")
        .when(speaker.contains(">"), "> in speaker")
        .when((start < 0) | (end < 0), "negative time")
    )


def line(speaker: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit("<"), speaker, F.lit("> "), float_text(start), F.lit("->"), float_text(end), F.lit(": "), text)


def serialize(utterances: DataFrame, strict: bool = True) -> DataFrame:
    """(clip_id, sot): lines ordered by start, end and speaker. Invalid utterances raise, or are left out where not ``strict``."""
    u = utterances.withColumn("_bad", invalid_field(F.col("speaker_id"), F.col("start_s"), F.col("end_s"), F.col("text")))
    if strict:
        u = u.withColumn("text", F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("invalid utterance: "), "_bad"))).otherwise(F.col("text")))
    else:
        u = u.where("_bad is null")
    rows = F.array_sort(F.collect_list(F.struct("start_s", "end_s", "speaker_id", line(F.col("speaker_id"), F.col("start_s"), F.col("end_s"), F.col("text")).alias("line"))))
    return u.groupBy("clip_id").agg(F.array_join(F.transform(rows, lambda r: r.line), "\n").alias("sot"))


def invalid(utterances: DataFrame) -> DataFrame:
    """The utterances that ``serialize`` rejects, with the reason."""
    return utterances.withColumn("reason", invalid_field(F.col("speaker_id"), F.col("start_s"), F.col("end_s"), F.col("text"))).where("reason is not null")


def parse(table: DataFrame, marker: str = "-", strict: bool = True) -> DataFrame:
    """clip_id, ord, speaker_id, start_s, end_s, text, words, truncated from (clip_id, sot).

    An empty text has no utterances. Malformed lines raise, or come out with a null speaker where not ``strict``.
    """
    rows = table.where("sot <> ''").select("clip_id", F.posexplode(F.split("sot", "\n")).alias("ord", "raw"))
    part = lambda i: F.regexp_extract("raw", LINE, i)
    start, end = part(2).try_cast("double"), part(3).try_cast("double")
    good = F.col("raw").rlike(LINE) & start.isNotNull() & end.isNotNull()
    speaker = F.when(good, part(1))
    if strict:
        speaker = F.when(good, part(1)).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), "raw")))
    text = F.when(good, part(4))
    return rows.select("clip_id", "ord", speaker.alias("speaker_id"), F.when(good, start).alias("start_s"), F.when(good, end).alias("end_s"), text.alias("text"), F.array().cast(WORDS).alias("words"), ends_with_marker(text, marker).alias("truncated"))
