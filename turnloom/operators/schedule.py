"""When each clip of a mixture starts, and where an interruption cuts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.config import MixingConfig
from turnloom.functions.bind import let, let_all
from turnloom.functions.keyed import uniform

SLOT = "struct<offset_s:double,duration_s:double,cut_at_s:double>"
DRAWS = ("overlap", "start", "uncut", "cut")


def active_at(slots: Column, t: Column) -> Column:
    """Slots that run at an instant: begun, and not ended."""
    return F.size(F.filter(slots, lambda s: (s["offset_s"] <= t) & (t < s["offset_s"] + F.coalesce(s["cut_at_s"], s["duration_s"]))))


def _slot(offset: Column, duration: Column, cut: Column) -> Column:
    return F.struct(offset.alias("offset_s"), duration.alias("duration_s"), cut.cast("double").alias("cut_at_s"))


def fold(clips: Column, peak: Column, config: MixingConfig) -> Column:
    """Slots of the clips (duration_s and the four draws), in order.

    A clip may fall into the latest one, which it then cuts or not; else it follows all others. Starts never go back, so at a start no
    later clip runs yet, and the cap holds at all times if it holds there.
    """

    end_of = lambda s: s["offset_s"] + F.coalesce(s["cut_at_s"], s["duration_s"])

    def put(done: Column, c: Column) -> Column:
        starts = F.transform(done, lambda s: s["offset_s"])
        at = let(starts, lambda x: F.array_position(x, F.array_max(x)).cast("int") - 1)
        after = F.coalesce(F.array_max(F.transform(done, end_of)), F.lit(0.0))
        return let_all(lambda v: met(done, c, v), at=at, victim=F.get(done, at), after=after)

    def met(done: Column, c: Column, v: Column) -> Column:
        start = v["victim"]["offset_s"] + c["start"] * (end_of(v["victim"]) - v["victim"]["offset_s"])
        return let(start, lambda s: decided(done, c, v, s))

    def decided(done: Column, c: Column, v: Column, start: Column) -> Column:
        victim = v["victim"]
        falls = (F.size(done) > 0) & (peak > 1) & (c["overlap"] < config.overlap_probability) & (active_at(done, start) < peak)
        cut = F.least(victim["duration_s"], (start - victim["offset_s"]) + config.min_truncation_s + c["cut"] * (config.max_truncation_s - config.min_truncation_s))
        cuts = falls & (c["uncut"] >= config.uncut_probability) & (victim["cut_at_s"].isNull() | (cut < victim["cut_at_s"]))
        return let_all(lambda d: placed(done, c, v, start, d), falls=F.coalesce(falls, F.lit(False)), cut=cut, cuts=F.coalesce(cuts, F.lit(False)))

    def placed(done: Column, c: Column, v: Column, start: Column, d: Column) -> Column:
        changed = F.transform(done, lambda s, i: F.when(d["cuts"] & (i == v["at"]), _slot(s["offset_s"], s["duration_s"], d["cut"])).otherwise(s))
        new = _slot(F.when(d["falls"], start).otherwise(v["after"]), c["duration_s"], F.lit(None))
        return F.concat(changed, F.array(new)).cast(f"array<{SLOT}>")

    return F.aggregate(clips, F.array().cast(f"array<{SLOT}>"), put)


def schedule(clips: DataFrame, peaks: DataFrame, config: MixingConfig | None = None, seed: int = 0) -> DataFrame:
    """clip_id, ord, offset_s, duration_s, cut_at_s from (clip_id, ord, duration_s) and (clip_id, peak).

    Durations are all it needs, so audio never moves. One exchange by clip; a clip's slots are bounded by its speakers' turns.
    """
    c = config or MixingConfig()
    draws = [uniform(seed, F.col("clip_id"), F.col("ord"), F.lit(k)).alias(k) for k in DRAWS]
    rows = clips.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("ord", "duration_s", *draws))).alias("clips"))
    placed = rows.join(peaks.select("clip_id", "peak"), "clip_id").select("clip_id", F.arrays_zip(F.transform("clips", lambda x: x["ord"]).alias("ord"), fold(F.col("clips"), F.col("peak"), c).alias("slot")).alias("z"))
    return placed.select("clip_id", F.explode("z").alias("z")).select("clip_id", "z.ord", "z.slot.*")
