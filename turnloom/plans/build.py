"""Stages of a run: building a dataset from text, and the stages that need a model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.config import AugmentSpec, BalancingConfig, EvaluateConfig, PipelineConfig, TrainingConfig
from turnloom.functions.keyed import positive
from turnloom.functions.text import strip
from turnloom.operators import audio, counts, sot, truncate
from turnloom.operators.balance import plan_clip_counts, run_balance
from turnloom.operators.budget import assign_engines
from turnloom.operators.cpwer import cpwer, tcpwer
from turnloom.operators.der import diarization_error_rate
from turnloom.operators.schedule import schedule
from turnloom.operators.split import assign_split
from turnloom.operators.voices import preset_ids, references, sample_speakers
from turnloom.plans import aligners, engines, training  # noqa: F401
from turnloom.plans.models import Trainable, trainable, with_audio
from turnloom.plans.registry import ALIGNERS, ENGINES, TEXT_SOURCES
from turnloom.sources import texts
from turnloom.sources.manifest import manifest_rows, read_manifest, write_manifest
from turnloom.sources.wav import decoded, voice_bank, write_wavs


class PipelineError(RuntimeError):
    """A stage that cannot run."""


@dataclass(frozen=True)
class Built:
    """A dataset's tables: manifest rows, utterances, and audio by clip."""

    manifest: DataFrame
    utterances: DataFrame
    audio: DataFrame


def plan(spark: SparkSession, config: PipelineConfig, capacity: int | None = None) -> DataFrame:
    """(clip_id, total, max_simultaneous) of the run's clips."""
    base = BalancingConfig(simultaneous_weights=config.mixing.simultaneous_weights)
    return plan_clip_counts(spark, config.dataset.num_examples, run_balance(base, config.mixing.max_simultaneous_speakers, capacity), config.seed)


def turns_before(clips: DataFrame) -> DataFrame:
    """(clip_id, before): the turns of all clips before a clip of (clip_id, total), in order of their numbers.

    Totals are summed in parts of 4,096 clips and the parts' sums in turn, so no window holds all clips.
    """
    numbered = clips.select("clip_id", "total", F.substring("clip_id", 5, 20).cast("long").alias("number")).withColumn("part", F.floor(F.col("number") / 4096))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = numbered.groupBy("part").agg(F.sum("total").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("total").over(earlier(Window.partitionBy("part").orderBy("number"))), F.lit(0))
    return numbered.withColumn("within", within).join(sums, "part").select("clip_id", (F.col("base") + F.col("within")).alias("before"))


def dataset(spark: SparkSession, config: PipelineConfig, speech: str | None = None) -> Built:
    """Text to mixed clips: plan, speakers, sentences, speech, alignment, schedule, mix, augmentation.

    With ``speech``, a folder, speech is made once and kept there as Parquet; all later steps read it. Without, it is made anew
    wherever a plan needs it, which is the same speech only if text source and engines are deterministic.
    """
    d = config.dataset
    weights = positive(d.engine_weights)
    cloning = {e: ENGINES.create(e).cloning for e in weights}
    bank = voice_bank(spark, d.voice_source_dir) if d.voice_source_dir else None
    if bank is None and any(cloning.values()):
        raise ValueError("cloning engines need a voice bank: set voice_source_dir")
    capacity = bank.select("speaker").distinct().count() if bank is not None else None
    clips = plan(spark, config, capacity)
    if bank is None:
        turns = clips.select("clip_id", F.posexplode(preset_ids(F.col("total"))).alias("ord", "speaker_id"))
    else:
        turns = sample_speakers(clips, bank, config.seed)
    turns = assign_engines(turns, weights, config.seed)
    feed = TEXT_SOURCES.create(d.text_source, spark=spark, **d.text_options)
    feed = feed.where(strip(F.col("sentence")) != "")
    turns = texts.endless(turns.join(turns_before(clips), "clip_id").withColumn("i", F.col("before") + F.col("ord")), feed, "i").drop("i", "before").withColumnRenamed("sentence", "text")
    spoken = None
    for name in weights:
        own = turns.where(F.col("engine") == name)
        if cloning[name]:
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(f"{d.voice_source_dir.rstrip('/')}/*/")
            refs = references(bank.select(F.col("speaker").alias("speaker_id")).distinct(), bank, True, seed=config.seed)
            sound = decoded(files.select("path", "content"), 16_000).select(F.col("path").alias("reference_path"), F.col("pcm").alias("reference"))
            own = own.join(refs.join(sound, "reference_path").select("speaker_id", "reference"), "speaker_id").withColumn("preset", F.lit(None).cast("string"))
        elif d.voice_presets:
            own = own.join(references(own.select("speaker_id").distinct(), own, False, d.voice_presets, config.seed).select("speaker_id", "preset"), "speaker_id")
        else:
            own = own.withColumn("preset", F.col("speaker_id"))
        made = engines.synthesized(own, name).drop("reference", "preset")
        spoken = made if spoken is None else spoken.unionByName(made)
    spoken = spoken.withColumn("duration_s", F.octet_length("pcm") / 4 / F.col("sample_rate"))
    if speech is not None:  # kept, so that schedule, transcripts and audio come from one and the same speech
        spoken.write.mode("overwrite").parquet(speech)
        spoken = spark.read.parquet(speech)
    aligned = ALIGNERS.create(d.aligner)(spoken)
    places = schedule(aligned.select("clip_id", "ord", "duration_s"), clips.select("clip_id", F.col("max_simultaneous").alias("peak")), config.mixing, config.seed).drop("duration_s")
    placed = aligned.join(places, ["clip_id", "ord"])
    u = truncate.placed(F.col("duration_s"), F.col("words"), F.col("text"), F.col("offset_s"), F.col("cut_at_s"), config.mixing.truncation_marker)
    utterances = placed.select("clip_id", "ord", "speaker_id", u.alias("u")).select("clip_id", "ord", "speaker_id", "u.*")
    mixed = audio.rendered(placed.withColumn("kept_s", truncate.kept_seconds(F.col("duration_s"), F.col("cut_at_s"))))
    mixed = audio.augmented(mixed, [AugmentSpec(s.name, s.options) for s in d.augment], config.seed)
    lengths = mixed.select("clip_id", (F.col("num_samples") / F.col("sample_rate")).alias("duration_s"))
    table = sot.serialize(utterances).withColumnRenamed("sot", "transcript").join(counts.speaker_counts(utterances), "clip_id").join(lengths, "clip_id")
    table = table.withColumn("metadata", F.create_map(F.lit("source"), F.lit("synthetic")))
    return Built(manifest_rows(table), utterances, mixed)


def build_dataset(spark: SparkSession, config: PipelineConfig) -> dict[str, Any]:
    """Write the dataset; clips by split."""
    root = config.dataset.output_dir
    built = dataset(spark, config, f"{root}/_speech")
    write_manifest(built.manifest, root)
    write_wavs(built.audio.withColumn("split", assign_split(F.col("clip_id"))), root)
    by = {r["split"]: r["count"] for r in spark.read.json(f"{root}/manifest").groupBy("split").count().collect()}
    return {"output_dir": root, "clips": sum(by.values()), "splits": by}


def _model(stage: str, config: TrainingConfig | EvaluateConfig) -> Trainable:
    if not config.model:
        raise PipelineError(f"{stage} needs a model backend: name a registered model in the configuration")
    return trainable(config.model, **config.model_options)


def phase1(spark: SparkSession, config: PipelineConfig) -> dict[str, Any]:
    c = config.phase1
    t = _model("phase1", c)
    return asdict(training.run_phase1(t.model, t.step, t.checkpoints, with_audio(read_manifest(spark, c.dataset_root), c.dataset_root), c.epochs, c.patience, c.min_delta))


def phase2(spark: SparkSession, config: PipelineConfig) -> dict[str, Any]:
    c = config.phase2
    t = _model("phase2", c)
    synthetic = with_audio(read_manifest(spark, c.synthetic_root).where("split = 'test'"), c.synthetic_root)
    return asdict(training.run_phase2(t.model, t.step, t.checkpoints, with_audio(read_manifest(spark, c.dataset_root), c.dataset_root), synthetic, c.epochs))


def _der(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    return diarization_error_rate(reference, hypothesis).withColumnRenamed("rate", "der")


#: Scores by clip that ``evaluate`` knows.
METRICS: dict[str, training.Metric] = {"der": _der, "cpwer": cpwer, "tcpwer": tcpwer}


def evaluate(spark: SparkSession, config: PipelineConfig) -> dict[str, Any]:
    """The mean of each configured score over the test split."""
    c = config.evaluate
    if unknown := [m for m in c.metrics if m not in METRICS]:
        raise PipelineError(f"no metric {', '.join(unknown)}; there are {', '.join(METRICS)}")
    t = _model("evaluate", c)
    rows = with_audio(read_manifest(spark, c.dataset_root).where("split = 'test'"), c.dataset_root)
    return {m: training.score_rows(t.model, rows, METRICS[m], m) for m in c.metrics}


STAGES: dict[str, Callable[[SparkSession, PipelineConfig], dict[str, Any]]] = {"build_dataset": build_dataset, "phase1": phase1, "phase2": phase2, "evaluate": evaluate}


def run_pipeline(spark: SparkSession | None, config: PipelineConfig, dry_run: bool = False, on_stage: Callable[[str], None] | None = None) -> dict[str, Any]:
    """The stages in order, each one's result by name; a dry run only says that they are planned. Unknown stages raise before any runs."""
    if unknown := [s for s in config.stages if s not in STAGES]:
        raise PipelineError(f"no stage {', '.join(unknown)}; there are {', '.join(STAGES)}")
    out: dict[str, Any] = {}
    for s in config.stages:
        if on_stage:
            on_stage(s)
        out[s] = "planned" if dry_run else STAGES[s](spark, config)
    return out
