"""Driver-side settings, read from TOML; unknown keys are ignored, missing ones have defaults."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

#: Samples per second of all rendered audio.
SAMPLE_RATE = 16_000

#: Default weights of a clip's speakers in all, and at once. Fixed values.
TOTAL_WEIGHTS = {1: 1.0, 2: 3.0, 3: 6.0, 4: 10.0, 5: 8.0, 6: 6.0, 7: 4.0, 8: 3.0, 9: 2.0, 10: 2.0} | dict.fromkeys(range(11, 21), 1.0)
SIMULTANEOUS_WEIGHTS = {1: 1.0, 2: 3.0, 3: 6.0, 4: 10.0, 5: 6.0, 6: 3.0}


@dataclass(frozen=True)
class MixingConfig:
    max_simultaneous_speakers: int = 6
    min_truncation_s: float = 0.01
    max_truncation_s: float = 3.0
    overlap_probability: float = 0.8
    uncut_probability: float = 0.5
    simultaneous_weights: Mapping[int, float] = field(default_factory=lambda: dict(SIMULTANEOUS_WEIGHTS))
    truncation_marker: str = "-"


@dataclass(frozen=True)
class BalancingConfig:
    """Weights of a clip's speakers, in all and at once."""

    total_weights: Mapping[int, float] = field(default_factory=lambda: dict(TOTAL_WEIGHTS))
    simultaneous_weights: Mapping[int, float] = field(default_factory=lambda: MixingConfig().simultaneous_weights)


@dataclass(frozen=True)
class GenerationConfig:
    target_hours: float = 10_000.0
    default_hours_per_engine: float = 1_000.0
    hours_per_engine: Mapping[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class SplitRatios:
    """Shares of train, val and test; they have to sum to 1."""

    train: float = 0.8
    val: float = 0.1
    test: float = 0.1

    def __post_init__(self) -> None:
        if abs(self.train + self.val + self.test - 1.0) > 1e-9:
            raise ValueError("split ratios have to sum to 1")


@dataclass(frozen=True)
class AugmentSpec:
    name: str
    options: Mapping[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class DatasetConfig:
    output_dir: str = "data/synthetic"
    num_examples: int = 20
    text_source: str = "static"
    text_options: Mapping[str, Any] = field(default_factory=dict)
    aligner: str = "proportional"
    engine_weights: Mapping[str, float] = field(default_factory=lambda: {"sine": 1.0})
    augment: tuple[AugmentSpec, ...] = ()
    voice_source_dir: str | None = None
    voice_presets: tuple[str, ...] = ()


@dataclass(frozen=True)
class TrainingConfig:
    """``model`` names a registered model; ``synthetic_root`` is where phase 2 takes its clips for regressions."""

    dataset_root: str = "data/synthetic"
    synthetic_root: str = "data/synthetic"
    epochs: int = 1
    patience: int = 3
    min_delta: float = 0.0
    model: str = ""
    model_options: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class EvaluateConfig:
    dataset_root: str = "data/synthetic"
    model: str = ""
    model_options: Mapping[str, Any] = field(default_factory=dict)
    metrics: tuple[str, ...] = ("der", "cpwer")


@dataclass(frozen=True)
class PipelineConfig:
    seed: int = 0
    stages: tuple[str, ...] = ("build_dataset",)
    dataset: DatasetConfig = field(default_factory=DatasetConfig)
    mixing: MixingConfig = field(default_factory=MixingConfig)
    phase1: TrainingConfig = field(default_factory=TrainingConfig)
    phase2: TrainingConfig = field(default_factory=TrainingConfig)
    evaluate: EvaluateConfig = field(default_factory=EvaluateConfig)


_TUPLES = {"stages", "voice_presets", "metrics"}


def _made(kind: type, data: Mapping[str, Any]) -> Any:
    own = {f.name: data[f.name] for f in fields(kind) if f.name in data}
    own |= {k: tuple(own[k]) for k in _TUPLES & own.keys()}
    if "augment" in own:
        own["augment"] = tuple(_made(AugmentSpec, x) for x in own["augment"])
    if "simultaneous_weights" in own:
        own["simultaneous_weights"] = {int(k): float(v) for k, v in own["simultaneous_weights"].items()}
    return kind(**own)


def from_mapping(data: Mapping[str, Any]) -> PipelineConfig:
    parts = {"dataset": DatasetConfig, "mixing": MixingConfig, "phase1": TrainingConfig, "phase2": TrainingConfig, "evaluate": EvaluateConfig}
    return _made(PipelineConfig, dict(data) | {k: _made(kind, data.get(k, {})) for k, kind in parts.items()})


def load_config(path: str) -> PipelineConfig:
    with open(path, "rb") as f:
        return from_mapping(tomllib.load(f))
