"""Models as boundaries: a backend of the caller's own turns a clip's audio into a transcript, another trains on one example at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrow import short
from turnloom.operators import sot
from turnloom.plans.registry import MODELS
from turnloom.sources.wav import decoded

#: Silence, target, other speaker, overlap: the conditions of a frame. Fixed order.
CONDITIONS = ("silence", "target", "non_target", "overlap")

#: From samples, their rate and a mask (frames, conditions) to a serialised transcript.
Generate = Callable[[np.ndarray, int, np.ndarray], str]


def always_target(frames: int) -> np.ndarray:
    """The mask of a clip without a diarizer: each frame is the target speaker's."""
    out = np.zeros((frames, len(CONDITIONS)), np.float32)
    out[:, CONDITIONS.index("target")] = 1.0
    return out


def with_audio(rows: DataFrame, root: str) -> DataFrame:
    """Manifest rows with pcm and sample_rate of their WAV files under ``root``; rows whose file is missing are lost."""
    files = rows.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(root).select("path", "content")
    sound = decoded(files).select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("clip_id"), "pcm", "sample_rate")
    return rows.join(sound, "clip_id")


@dataclass
class TranscriptModel:
    """Utterances of rows (clip_id, pcm, sample_rate): each clip's transcript is generated in the tasks and parsed by the one grammar there is.

    ``load`` runs once in each task; without it every use raises.
    """

    load: Callable[[], Generate] | None = None
    frame_s: float = 0.02

    def transcripts(self, rows: DataFrame) -> DataFrame:
        """(clip_id, sot) as generated."""
        load, frame_s = self.load, self.frame_s
        if load is None:
            raise RuntimeError("no backend generates transcripts; give load=")

        def run(batches):
            generate = load()
            for b in short(batches):
                said = []
                for p, rate in zip(b.column("pcm").to_pylist(), b.column("sample_rate").to_pylist(), strict=True):
                    x = np.frombuffer(p, "<f4")
                    said.append(generate(x, rate, always_target(int(np.ceil(len(x) / rate / frame_s)))))
                yield pa.RecordBatch.from_arrays([b.column("clip_id"), pa.array(said, pa.string())], names=["clip_id", "sot"])

        return rows.select("clip_id", "pcm", "sample_rate").mapInArrow(run, "clip_id string, sot string")

    def predict(self, rows: DataFrame) -> DataFrame:
        return sot.parse(self.transcripts(rows))


@dataclass
class ExampleStep:
    """A training step on one example (samples, rate, transcript) at a time, giving its loss: the adapter of a model that lives on the driver.

    Examples stream to the driver a partition at a time, in order of their ids; ``save`` is the adapter's own.
    """

    train: Callable[[np.ndarray, int, str], float] | None = None
    keep: Callable[[str], None] | None = None
    examples: int = field(default=0, init=False)

    def __call__(self, rows: DataFrame) -> float:
        """The mean loss of a pass over the rows; none give 0."""
        if self.train is None:
            raise RuntimeError("no backend trains; give train=")
        losses = []
        for r in rows.select("clip_id", "pcm", "sample_rate", "transcript").orderBy("clip_id").toLocalIterator():
            losses.append(float(self.train(np.frombuffer(r["pcm"], "<f4"), r["sample_rate"], r["transcript"])))
        self.examples += len(losses)
        return sum(losses) / len(losses) if losses else 0.0

    def save(self, name: str) -> None:
        if self.keep is None:
            raise RuntimeError("no backend saves; give keep=")
        self.keep(name)


@dataclass
class Trainable:
    """What a stage needs: a model, the step that changes it, and where it is saved."""

    model: Any
    step: Callable[[DataFrame], float]
    checkpoints: Any


def trainable(name: str, **options: Any) -> Trainable:
    """A registered model by name; its factory gives a Trainable."""
    return MODELS.create(name, **options)
