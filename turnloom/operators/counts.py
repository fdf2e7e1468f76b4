"""Speaker counts: distinct speakers of a clip, and the most intervals at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def peak_overlap(intervals: DataFrame, key: str = "clip_id", start: str = "start_s", end: str = "end_s") -> DataFrame:
    """(key, peak): a sweep over starts and ends; at one instant ends come first, so touching intervals do not overlap.

    Intervals count, not speakers. One exchange by the key; a clip's events are sorted by Spark and may spill.
    """
    events = intervals.select(key, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e")).select(key, "e.t", "e.d")
    active = F.sum("d").over(Window.partitionBy(key).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("active", active).groupBy(key).agg(F.greatest(F.lit(0), F.max("active")).cast("int").alias("peak"))


def speaker_counts(utterances: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """(clip_id, total, max_simultaneous); with ``clips`` (clip_id), those without utterances count (0, 0)."""
    total = utterances.groupBy("clip_id").agg(F.count_distinct("speaker_id").cast("int").alias("total"))
    out = total.join(peak_overlap(utterances).withColumnRenamed("peak", "max_simultaneous"), "clip_id")
    if clips is None:
        return out
    return clips.select("clip_id").distinct().join(out, "clip_id", "left").na.fill(0, ["total", "max_simultaneous"])
