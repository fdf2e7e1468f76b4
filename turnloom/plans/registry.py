"""Plug-ins by name: augmenters, aligners, text sources, speech engines."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np

from turnloom.functions import dsp


class Registry:
    """Names and factories. A name is taken once; an unknown one raises with those there are."""

    def __init__(self, kind: str):
        self.kind = kind
        self._factories: dict[str, Callable[..., Any]] = {}

    def register(self, name: str) -> Callable:
        def put(factory: Callable[..., Any]) -> Callable[..., Any]:
            if name in self._factories:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self._factories[name] = factory
            return factory

        return put

    def create(self, name: str, /, **options: Any) -> Any:
        if name not in self._factories:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(self.available()) or 'none'}")
        return self._factories[name](**options)

    def available(self) -> list[str]:
        return sorted(self._factories)


AUGMENTERS = Registry("augmenter")
ALIGNERS = Registry("aligner")
TEXT_SOURCES = Registry("text source")
ENGINES = Registry("engine")
MODELS = Registry("model")

#: An augmenter: samples, rate and a keyed generator to samples.
Step = Callable[[np.ndarray, int, np.random.Generator], np.ndarray]


@AUGMENTERS.register("gain")
def _gain(gain_db: float = 0.0) -> Step:
    return lambda x, rate, rng: dsp.gain(x, gain_db)


@AUGMENTERS.register("white_noise")
def _white_noise(snr_db: float = 20.0) -> Step:
    return lambda x, rate, rng: dsp.white_noise(x, snr_db, rng)


@AUGMENTERS.register("reverb")
def _reverb(decay_s: float = 0.3, wet_level: float = 0.5) -> Step:
    dsp.decaying_response(decay_s, 1)
    return lambda x, rate, rng: dsp.reverb(x, dsp.decaying_response(decay_s, rate), wet_level)


def _from_catalogue(catalogue: list[tuple[np.ndarray, int]], rate: int, rng: np.random.Generator) -> np.ndarray:
    x, own = catalogue[int(rng.integers(len(catalogue)))]
    return dsp.resample(x, own, rate)


def _catalogue(corpus_dir: str | None, recursive: bool, catalogue) -> list[tuple[np.ndarray, int]]:
    from turnloom.sources.wav import local_catalogue

    return catalogue if catalogue is not None else local_catalogue(corpus_dir, recursive)


@AUGMENTERS.register("musan")
def _musan(corpus_dir: str | None = None, snr_db: float = 15.0, catalogue=None) -> Step:
    noises = _catalogue(corpus_dir, True, catalogue)
    return lambda x, rate, rng: dsp.mix_at_snr(x, dsp.fit_length(_from_catalogue(noises, rate, rng), len(x), rng), snr_db)


@AUGMENTERS.register("rir_file")
def _rir_file(corpus_dir: str | None = None, wet_level: float = 0.5, catalogue=None) -> Step:
    responses = _catalogue(corpus_dir, False, catalogue)
    return lambda x, rate, rng: dsp.reverb(x, _from_catalogue(responses, rate, rng), wet_level)
