"""Training loops around a model of the caller's own: splits, scores and early stopping. The scores are Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.config import SplitRatios
from turnloom.operators.cpwer import cpwer, macro_mean
from turnloom.operators.sot import parse
from turnloom.operators.split import held_out, training_rows

#: A score by clip: reference and hypothesis utterances to (clip_id, value).
Metric = Callable[[DataFrame, DataFrame], DataFrame]


class Model(Protocol):
    """From manifest rows to utterances (clip_id, ord, speaker_id, start_s, end_s, text)."""

    def predict(self, rows: DataFrame) -> DataFrame: ...


class TrainStep(Protocol):
    """One pass over the rows; the mean loss."""

    def __call__(self, rows: DataFrame) -> float: ...


class Checkpointer(Protocol):
    def save(self, name: str) -> None: ...


def score_rows(model: Model, rows: DataFrame, metric: Metric = cpwer, name: str = "cpwer") -> float:
    """The mean score over the rows' clips; no rows raise."""
    reference = parse(rows.select("clip_id", F.col("transcript").alias("sot")))
    return float(macro_mean(metric(reference, model.predict(rows)).select("clip_id", name), name).first()[0])


@dataclass(frozen=True)
class Epoch:
    number: int
    loss: float
    score: float


@dataclass(frozen=True)
class Phase1Result:
    """The name and score of the best checkpoint, all epochs, and whether they ended before their number was reached."""

    best_checkpoint: str | None
    best_score: float
    history: tuple[Epoch, ...]
    stopped_early: bool


def run_phase1(model: Model, step: TrainStep, checkpoints: Checkpointer, manifest: DataFrame, epochs: int = 10, patience: int = 3, min_delta: float = 0.0, metric: Metric = cpwer, name: str = "cpwer") -> Phase1Result:
    """Train on the train rows, score the val rows, save whenever the score falls by more than ``min_delta``, stop after ``patience`` epochs without."""
    train, val = training_rows(manifest)
    if train.isEmpty() or val.isEmpty():
        raise ValueError("training needs train and val rows")
    best, saved, stalled, out = float("inf"), None, 0, []
    for n in range(1, epochs + 1):
        loss = step(train)
        out.append(Epoch(n, loss, score_rows(model, val, metric, name)))
        if out[-1].score < best - min_delta:
            best, saved, stalled = out[-1].score, f"epoch{n}", 0
            checkpoints.save(saved)
        elif (stalled := stalled + 1) >= patience:
            return Phase1Result(saved, best, tuple(out), True)
    return Phase1Result(saved, best, tuple(out), False)


def best_epoch(epochs: Sequence[Epoch], min_delta: float = 0.0) -> Epoch:
    out = epochs[0]
    for e in epochs[1:]:
        if e.score < out.score - min_delta:
            out = e
    return out


def evaluate_test_split(model: Model, manifest: DataFrame, metric: Metric = cpwer, name: str = "cpwer") -> float:
    return score_rows(model, manifest.where("split = 'test'"), metric, name)


@dataclass(frozen=True)
class Phase2Result:
    """Where the adapter was saved, the scores on held-out real clips and on synthetic ones, and the clips of either part."""

    checkpoint: str
    loss: float
    held_out: float
    synthetic: float
    train_clips: int
    held_out_clips: int


def run_phase2(model: Model, step: TrainStep, checkpoints: Checkpointer, real: DataFrame, synthetic_test: DataFrame, epochs: int = 1, ratios: SplitRatios | None = None, metric: Metric = cpwer, name: str = "cpwer", checkpoint: str = "adapter") -> Phase2Result:
    """Train on real clips outside their test split and save once; score the held-out ones, and the synthetic test clips for regressions."""
    parts = held_out(real, ratios)
    train, held = parts.where("part = 'train'"), parts.where("part = 'held_out'")
    clips = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    if len(clips) < 2:
        raise ValueError("training needs real clips in both parts")
    loss = 0.0
    for _ in range(epochs):
        loss = step(train)
    checkpoints.save(checkpoint)
    return Phase2Result(checkpoint, loss, score_rows(model, held, metric, name), score_rows(model, synthetic_test, metric, name), clips["train"], clips["held_out"])
