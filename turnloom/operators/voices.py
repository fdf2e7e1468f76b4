"""Voices of a bank: which speakers a clip gets, and which of a speaker's clips is the reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.keyed import uniform


def preset_ids(n: Column) -> Column:
    """S1 to Sn."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("S"), i.cast("string")))


def sample_speakers(clips: DataFrame, bank: DataFrame, seed: int = 0) -> DataFrame:
    """(clip_id, ord, speaker_id): ``total`` distinct speakers of the bank (speaker) for each clip, in an order keyed by clip and speaker.

    Each place draws among the speakers its clip has not taken yet, so every ordered choice is equally likely, whatever the bank's size.
    A draw is a rank among those left: stepping over the ranks already taken gives the speaker, and the bank is not multiplied with the
    clips. A clip that needs more speakers than there are raises.
    """
    numbered = bank.select("speaker").distinct().withColumn("k", (F.row_number().over(Window.orderBy("speaker")) - 1).cast("long"))
    n = numbered.count()
    need = F.when(F.col("total") > n, F.raise_error("a clip needs more speakers than the bank has").cast("int")).otherwise(F.col("total"))

    def taken(have: Column, _: Column) -> Column:
        left = F.lit(n) - F.size(have)
        rank = F.least(F.floor(uniform(seed, F.col("clip_id"), F.lit("speaker"), F.size(have)) * left), left - 1).cast("long")
        return F.concat(have, F.array(F.aggregate(F.array_sort(have), rank, lambda r, k: r + (r >= k).cast("long"))))

    drawn = F.aggregate(F.array_repeat(F.lit(0), need), F.array().cast("array<long>"), taken)
    return clips.select("clip_id", F.posexplode(drawn).alias("ord", "k")).join(numbered, "k").select("clip_id", "ord", F.col("speaker").alias("speaker_id"))


def pick(seed: int, key: Column, options: Column) -> Column:
    """One of an array's values, keyed; an empty array raises."""
    n = F.size(options)
    return F.when(n > 0, F.get(options, F.floor(uniform(seed, key) * n).cast("int"))).otherwise(F.raise_error("nothing to pick from"))


def references(speakers: DataFrame, bank: DataFrame, supports_cloning: bool, presets: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(speaker_id, reference_path, preset): a clip of the speaker for cloning engines, else a preset. An unknown speaker raises."""
    if not supports_cloning:
        if not presets:
            raise ValueError("no presets to choose from")
        return speakers.select("speaker_id", F.lit(None).cast("string").alias("reference_path"), pick(seed, F.col("speaker_id"), F.array(*map(F.lit, presets))).alias("preset"))
    clips = bank.groupBy(F.col("speaker").alias("speaker_id")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    found = speakers.join(clips, "speaker_id", "left")
    path = F.when(F.col("paths").isNull(), F.raise_error(F.concat(F.lit("no reference clips for "), "speaker_id"))).otherwise(pick(seed, F.col("speaker_id"), F.col("paths")))
    return found.select("speaker_id", path.alias("reference_path"), F.lit(None).cast("string").alias("preset"))
