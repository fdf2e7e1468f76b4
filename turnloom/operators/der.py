"""Diarization error by clip: exact intervals, no frames and no collar."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.assignment import best_mapping
from turnloom.operators.sot import parse


def proper(utterances: DataFrame) -> DataFrame:
    return utterances.select("clip_id", "speaker_id", "start_s", "end_s").where("end_s > start_s")


def overlap_matrix(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """(clip_id, ref_speaker, hyp_speaker, overlap_s): seconds that each two speakers share, every pair of utterances counting."""
    r = proper(reference).withColumnsRenamed({"speaker_id": "ref_speaker", "start_s": "rs", "end_s": "re"})
    h = proper(hypothesis).withColumnsRenamed({"speaker_id": "hyp_speaker", "start_s": "hs", "end_s": "he"})
    both = r.join(h, (r["clip_id"] == h["clip_id"]) & (F.col("rs") < F.col("he")) & (F.col("hs") < F.col("re"))).drop(h["clip_id"])
    return both.groupBy("clip_id", "ref_speaker", "hyp_speaker").agg(F.sum(F.least("re", "he") - F.greatest("rs", "hs")).alias("overlap_s"))


def speaker_mapping(overlaps: DataFrame) -> DataFrame:
    """(clip_id, hyp_speaker, ref_speaker): the one-to-one mapping with the most overlap. A clip's matrix is bounded by its speakers."""
    cells = overlaps.groupBy("clip_id").agg(F.collect_list(F.struct("ref_speaker", "hyp_speaker", "overlap_s")).alias("cells"))

    def run(batches):
        for b in batches:
            out: list[tuple[str, str, str]] = []
            for clip, x in zip(b.column("clip_id").to_pylist(), b.column("cells").to_pylist(), strict=True):
                out += [(clip, h, r) for h, r in best_mapping({(c["ref_speaker"], c["hyp_speaker"]): c["overlap_s"] for c in x}).items()]
            clips, hyps, refs = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (clips, hyps, refs)], names=["clip_id", "hyp_speaker", "ref_speaker"])

    return cells.mapInArrow(run, "clip_id string, hyp_speaker string, ref_speaker string")


def elementary_intervals(*tables: DataFrame) -> DataFrame:
    """(clip_id, t0, t1): the timeline cut at every start and end of the tables' utterances."""
    points = None
    for t in tables:
        p = proper(t).select("clip_id", F.explode(F.array("start_s", "end_s")).alias("t0"))
        points = p if points is None else points.union(p)
    after = F.lead("t0").over(Window.partitionBy("clip_id").orderBy("t0"))
    return points.distinct().withColumn("t1", after).where("t1 is not null")


def _active(intervals: DataFrame, utterances: DataFrame, name: str) -> DataFrame:
    u = utterances.select(F.col("clip_id").alias("c"), F.col("start_s").alias("s"), F.col("end_s").alias("e"), F.col("label"))
    keep = [c for c in intervals.columns if c not in ("clip_id", "t0", "t1")]
    joined = intervals.join(u, (F.col("clip_id") == F.col("c")) & (F.col("s") <= F.col("t0")) & (F.col("e") >= F.col("t1")), "left")
    return joined.groupBy("clip_id", "t0", "t1", *keep).agg(F.collect_set("label").alias(name))


def components(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """(clip_id, miss_s, false_alarm_s, confusion_s, total_ref_s) of every clip that either side knows."""
    ref, hyp = proper(reference), proper(hypothesis)
    mapping = speaker_mapping(overlap_matrix(ref, hyp)).withColumnRenamed("hyp_speaker", "speaker_id")
    mapped = hyp.join(mapping, ["clip_id", "speaker_id"], "left")
    line = elementary_intervals(ref, hyp)
    line = _active(line, ref.withColumn("label", F.col("speaker_id")), "r")
    line = _active(line, mapped.withColumn("label", F.struct("speaker_id", "ref_speaker")), "h")
    dt = F.col("t1") - F.col("t0")
    nr, nh = F.size("r"), F.size("h")
    right = F.size(F.array_intersect("r", F.transform("h", lambda x: x["ref_speaker"])))
    sums = line.groupBy("clip_id").agg(
        F.sum(F.greatest(F.lit(0), nr - nh) * dt).alias("miss_s"),
        F.sum(F.greatest(F.lit(0), nh - nr) * dt).alias("false_alarm_s"),
        F.sum((F.least(nr, nh) - right) * dt).alias("confusion_s"),
    )
    total = ref.groupBy("clip_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("total_ref_s"))
    clips = reference.select("clip_id").union(hypothesis.select("clip_id")).distinct()
    return clips.join(sums, "clip_id", "left").join(total, "clip_id", "left").na.fill(0.0, ["miss_s", "false_alarm_s", "confusion_s", "total_ref_s"])


def diarization_error_rate(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """``components`` and rate: errors by reference seconds; 0 if there are neither, infinite if there are only errors."""
    errors = F.col("miss_s") + F.col("false_alarm_s") + F.col("confusion_s")
    rate = F.when(F.col("total_ref_s") > 0, errors / F.when(F.col("total_ref_s") > 0, F.col("total_ref_s")).otherwise(1.0)).when(errors > 0, F.lit(float("inf"))).otherwise(0.0)
    return components(reference, hypothesis).withColumn("rate", rate)


def der_from_sot(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """The same from two tables (clip_id, sot)."""
    return diarization_error_rate(parse(reference), parse(hypothesis))
