"""Utterances made of the conversations table: the driver's tables have no audio, so turns stand in for speech.

U has a row for each turn: the role speaks, for as long as the sine voice would take, and starts at three quarters of the time before it,
so that turns overlap. H is a hypothesis for U: other speaker names, a tenth of the turns missing, all a tenth of a second late, and
some first words replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.keyed import fraction
from turnloom.functions.text import squeezed
from turnloom.operators.audio import sine_duration


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, ord, speaker_id, text, start_s, dur_s, end_s."""
    c = table(spark, sf_dir, "conversations")
    u = c.select(F.format_string("clip%06d", "conv_id").alias("clip_id"), F.col("turn").cast("int").alias("ord"), F.col("role").alias("speaker_id"), squeezed(F.col("text")).alias("text")).withColumn("dur_s", sine_duration(F.col("text")))
    before = F.coalesce(F.sum("dur_s").over(Window.partitionBy("clip_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return u.withColumn("start_s", F.round(F.lit(0.75) * before, 6)).withColumn("end_s", F.col("start_s") + F.col("dur_s"))


def hypothesis(u: DataFrame) -> DataFrame:
    key = F.concat_ws(":", "clip_id", "ord")
    name = F.when(F.col("speaker_id") == "user", "X").when(F.col("speaker_id") == "assistant", "Y").otherwise("Z")
    text = F.when(fraction(F.concat(key, F.lit(":w"))) < 0.3, F.regexp_replace("text", r"^[^ ]+", "zzz")).otherwise(F.col("text"))
    return u.where(fraction(key) >= 0.1).select("clip_id", "ord", name.alias("speaker_id"), text.alias("text"), "dur_s", (F.col("start_s") + 0.1).alias("start_s"), (F.col("end_s") + 0.1).alias("end_s"))


def sql_fraction(text: str) -> str:
    return f"(concat('0x', substr(sha256({text}), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE)"


U_SQL = r"""u0 AS (
  SELECT 'clip' || lpad(conv_id::VARCHAR, 6, '0') AS clip_id, turn::INT AS ord, role AS speaker_id,
         trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\x0B\f]+', ' ', 'g')) AS text FROM conversations
), u1 AS (
  SELECT *, round_even(greatest(0.3::DOUBLE, 0.06::DOUBLE * length(text)) * 16000, 0) / 16000 AS dur_s FROM u0
), u2 AS (
  SELECT *, round(0.75::DOUBLE * coalesce(sum(dur_s) OVER (PARTITION BY clip_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start_s FROM u1
), u AS (
  SELECT clip_id, ord, speaker_id, text, start_s, dur_s, start_s + dur_s AS end_s FROM u2
)"""

H_SQL = (
    U_SQL
    + f""", h AS (
  SELECT clip_id, ord, CASE speaker_id WHEN 'user' THEN 'X' WHEN 'assistant' THEN 'Y' ELSE 'Z' END AS speaker_id,
         CASE WHEN {sql_fraction("clip_id || ':' || ord || ':w'")} < 0.3 THEN regexp_replace(text, '^[^ ]+', 'zzz') ELSE text END AS text,
         dur_s, start_s + 0.1::DOUBLE AS start_s, end_s + 0.1::DOUBLE AS end_s
  FROM u WHERE {sql_fraction("clip_id || ':' || ord")} >= 0.1
)"""
)
