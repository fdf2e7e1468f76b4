"""Leak-free train, val and test splits by a hash of the clip's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.config import SplitRatios
from turnloom.functions.keyed import fraction


def assign_split(clip_id: Column, ratios: SplitRatios | None = None) -> Column:
    """The split of an id, the same on every machine and in every order."""
    r = ratios or SplitRatios()
    x = fraction(clip_id)
    return F.when(x < r.train, "train").when(x < r.train + r.val, "val").otherwise("test")


def split_counts(clips: DataFrame, ratios: SplitRatios | None = None) -> DataFrame:
    return clips.select(assign_split(F.col("clip_id"), ratios).alias("split")).groupBy("split").agg(F.count("*").alias("clips"))


def split_report(clips: DataFrame, ratios: SplitRatios | None = None) -> DataFrame:
    """Extension: clips by split and speakers, with subtotals."""
    return clips.withColumn("split", assign_split(F.col("clip_id"), ratios)).rollup("split", "total").agg(F.count("*").alias("clips"))


def training_rows(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows; where the table is partitioned by split, no other part is read."""
    return manifest.where("split = 'train'"), manifest.where("split = 'val'")


def held_out(real_clips: DataFrame, ratios: SplitRatios | None = None) -> DataFrame:
    """Real clips with part: test is held out, train and val are trained on."""
    return real_clips.withColumn("part", F.when(assign_split(F.col("clip_id"), ratios) == "test", "held_out").otherwise("train"))
