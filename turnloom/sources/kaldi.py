"""Corpora as four text files: wav.scp, segments, text and utt2spk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.text import SPACE, strip
from turnloom.schemas import WORDS

#: Shown to whoever reads this corpus.
AMI_CAVEAT = "The licence of this corpus has not been verified; check it before use."


def pairs(table: DataFrame, value: str) -> DataFrame:
    """(key, value) from lines: first token and the rest, empty if there is none. Blank lines go; of one key the last line counts.

    ``table`` has value and line_no.
    """
    s = strip(F.col("value"))
    rows = table.where(s != "").select(F.split(s, rf"{SPACE}+", 2).alias("p"), "line_no").select(F.get("p", F.lit(0)).alias("key"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias(value), "line_no")
    return rows.groupBy("key").agg(F.max_by(value, "line_no").alias(value))


def segments(table: DataFrame) -> DataFrame:
    """(utterance, recording, start_s, end_s, line_no); lines without exactly four fields raise."""
    f = F.split(strip(F.col("value")), rf"{SPACE}+")
    rows = table.where(strip(F.col("value")) != "").select(F.when(F.size(f) == 4, f).otherwise(F.raise_error(F.concat(F.lit("a segment needs four fields: "), "value")).cast("array<string>")).alias("f"), "line_no")
    rows = rows.select(F.col("f")[0].alias("utterance"), F.col("f")[1].alias("recording"), F.col("f")[2].cast("double").alias("start_s"), F.col("f")[3].cast("double").alias("end_s"), "line_no")
    return rows.groupBy("utterance").agg(F.max_by(F.struct("recording", "start_s", "end_s"), "line_no").alias("r"), F.min("line_no").alias("line_no")).select("utterance", "r.*", "line_no")


def joined(seg: DataFrame, text: DataFrame, speakers: DataFrame, recordings: DataFrame, strict: bool = True) -> DataFrame:
    """Utterances of the segments: text or "", and the speaker and recording they have to have; a missing one raises if ``strict``."""
    out = seg.join(text.withColumnRenamed("key", "utterance"), "utterance", "left").join(speakers.withColumnRenamed("key", "utterance"), "utterance", "left").join(recordings.withColumnRenamed("key", "recording"), "recording", "left")

    def needed(c, what, key):
        return F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"no {what} for "), key)).cast("string")).otherwise(F.col(c)) if strict else F.col(c)

    return out.select(F.col("recording").alias("clip_id"), "line_no", needed("speaker_id", "speaker", "utterance").alias("speaker_id"), "start_s", "end_s", F.coalesce("text", F.lit("")).alias("text"), F.array().cast(WORDS).alias("words"), F.lit(False).alias("truncated"), needed("wav", "recording", "recording").alias("wav"))


def missing(seg: DataFrame, speakers: DataFrame, recordings: DataFrame) -> DataFrame:
    """(kind, key): speakers and recordings that segments want and nobody has."""
    s = seg.join(speakers.withColumnRenamed("key", "utterance"), "utterance", "left_anti").select(F.lit("speaker").alias("kind"), F.col("utterance").alias("key"))
    r = seg.join(recordings.withColumnRenamed("key", "recording"), "recording", "left_anti").select(F.lit("recording").alias("kind"), F.col("recording").alias("key")).distinct()
    return s.union(r)


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """(value, line_no) of one file, its lines numbered."""
    whole = spark.read.text(f"{directory}/{name}", wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def load_corpus(spark: SparkSession, directory: str, source: str) -> DataFrame:
    """Utterances of a corpus directory with wav path and source; recordings without segments do not appear."""
    get = lambda name, value: pairs(read(spark, directory, name), value)
    return joined(segments(read(spark, directory, "segments")), get("text", "text"), get("utt2spk", "speaker_id"), get("wav.scp", "wav")).withColumn("source", F.lit(source))


def load_libricss(spark: SparkSession, directory: str) -> DataFrame:
    return load_corpus(spark, directory, "libricss")


def load_ami(spark: SparkSession, directory: str) -> DataFrame:
    import warnings

    warnings.warn(AMI_CAVEAT, stacklevel=2)
    return load_corpus(spark, directory, "ami")
