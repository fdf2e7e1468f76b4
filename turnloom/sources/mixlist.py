"""Mixtures described in JSON lines: each a list of utterances with speaker, file, text and start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.audio import rendered
from turnloom.schemas import MIXTURE, WORDS
from turnloom.sources.wav import decoded


def exploded(lines: DataFrame) -> DataFrame:
    """(clip_id, ord, speaker_id, wav, text, start_s) from (clip_id, value)."""
    rows = lines.where(F.trim("value") != "").select("clip_id", F.from_json("value", MIXTURE, {"mode": "FAILFAST"}).alias("m"))
    return rows.select("clip_id", F.posexplode("m.utterances").alias("ord", "u")).select("clip_id", "ord", "u.*")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Utterances and mixed audio of a mixture list; files lie relative to it. An utterance ends when its file does."""
    base = path.rsplit("/", 1)[0]
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value")).select(F.format_string("mix%06d", "n").alias("clip_id"), "value")
    rows = exploded(lines)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(base)
    audio = decoded(files.select("path", "content")).withColumn("seconds", F.col("num_samples") / F.col("sample_rate"))
    place = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    parts = rows.withColumn("file", F.concat(F.lit(f"{base.split(':')[-1]}/"), "wav")).join(audio.withColumn("file", place), "file", "left")
    missing = F.when(F.col("seconds").isNull(), F.raise_error(F.concat(F.lit("no such file: "), "wav")).cast("double")).otherwise(F.col("seconds"))
    parts = parts.withColumn("kept_s", missing)
    utterances = parts.select("clip_id", "speaker_id", "start_s", (F.col("start_s") + F.col("kept_s")).alias("end_s"), "text", F.array().cast(WORDS).alias("words"), F.lit(False).alias("truncated"), F.lit("librispeech_mix").alias("source"))
    return utterances, rendered(parts.withColumn("offset_s", F.col("start_s")))
