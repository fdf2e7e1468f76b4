"""The dataset on disk: a manifest in JSON lines by split, audio beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.split import assign_split
from turnloom.schemas import MANIFEST


def manifest_rows(clips: DataFrame) -> DataFrame:
    """Manifest rows from (clip_id, transcript, duration_s, total, max_simultaneous, metadata)."""
    split = assign_split(F.col("clip_id"))
    return clips.select("clip_id", split.alias("split"), F.concat(split, F.lit("/audio/"), "clip_id", F.lit(".wav")).alias("audio_path"), "transcript", "duration_s", F.col("total").cast("int").alias("speaker_count_total"), F.col("max_simultaneous").cast("int").alias("speaker_count_max_simultaneous"), "metadata")


def write_manifest(rows: DataFrame, root: str, mode: str = "overwrite") -> None:
    """JSON lines under ``root/manifest``, a folder for each split; writing again replaces what was there."""
    rows.write.mode(mode).partitionBy("split").json(f"{root}/manifest")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows; those of one split are read from its folder alone. A missing manifest is an empty one."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{root}/manifest").select(*[c.split()[0] for c in MANIFEST.split(", ")])


def export_jsonl(rows: DataFrame, path: str) -> None:
    """One file for readers that want one: everything goes through a single task."""
    rows.orderBy("clip_id").coalesce(1).write.mode("overwrite").json(path)
