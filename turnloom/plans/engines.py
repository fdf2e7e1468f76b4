"""Speech engines by name: what voice each takes, and at which rate its backend speaks.

Only ``sine`` is built in. The others are boundaries: their backends are libraries that this package does not bring. An engine holds its
model once in each Python worker; audio comes out at the engine's rate, mono and clipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnloom.config import SAMPLE_RATE
from turnloom.functions import dsp
from turnloom.functions.arrow import grown, short
from turnloom.plans.registry import ENGINES

#: name, voice (clone or preset), native samples per second (0: its backend says). Fixed values.
ROSTER = """
bark preset 24000
chatterbox clone 24000
chatterbox_turbo clone 24000
dia preset 44100
dia2 preset 24000
f5_tts clone 24000
fish_speech clone 44100
gpt_sovits clone 32000
kokoro preset 24000
melotts preset 44100
metavoice_1b clone 0
moshi preset 24000
nemo_fastpitch preset 44100
openvoice clone 24000
orpheus clone 24000
piper preset 0
qwen3_tts clone 0
sesame_csm clone 0
sine preset 16000
step_audio_editx clone 24000
styletts2 clone 24000
vibevoice clone 24000
vits preset 22050
voxcpm2 clone 24000
voxtral preset 0
xtts_v2 clone 24000
"""

#: Presets that an engine knows, where it knows a closed set. Fixed values.
PRESETS = {
    "kokoro": (
        "af_alloy af_aoede af_bella af_heart af_jessica af_kore af_nicole af_nova af_river af_sarah af_sky am_adam am_echo am_eric am_fenrir am_liam am_michael am_onyx am_puck am_santa "
        "bf_alice bf_emma bf_isabella bf_lily bm_daniel bm_fable bm_george bm_lewis jf_alpha jf_gongitsune jf_nezumi jf_tebukuro jm_kumo "
        "zf_xiaobei zf_xiaoni zf_xiaoxiao zf_xiaoyi zm_yunjian zm_yunxi zm_yunxia zm_yunyang ef_dora em_alex em_santa ff_siwis "
        "hf_alpha hf_beta hm_omega hm_psi if_sara im_nicola pf_dora pm_alex pm_santa"
    ).split(),
    "melotts": "EN-US EN-BR EN_INDIA EN-AU EN-Default ES FR ZH JP KR".split(),
}

#: A backend: text, reference audio and preset to samples and their rate.
Backend = Callable[[str, bytes | None, str | None], tuple[np.ndarray, int]]


@dataclass
class Engine:
    name: str
    cloning: bool
    native_rate: int
    load: Callable[[], Backend] | None = None
    _backend: Backend | None = field(default=None, repr=False)

    def check(self, text: str | None, reference: bytes | None, preset: str | None) -> None:
        """Raise for blank texts and voices that the engine does not take."""
        if not text or text.isspace():
            raise ValueError(f"{self.name}: a blank text cannot be spoken")
        if self.cloning and reference is None:
            raise ValueError(f"{self.name} clones voices and needs reference audio")
        if not self.cloning and not preset:
            raise ValueError(f"{self.name} needs a preset")
        if self.name in PRESETS and preset not in PRESETS[self.name]:
            raise ValueError(f"{self.name} has no preset {preset!r}")

    def speak(self, text: str, reference: bytes | None = None, preset: str | None = None) -> np.ndarray:
        """Samples at SAMPLE_RATE, mono, within [-1, 1]."""
        self.check(text, reference, preset)
        if self._backend is None:
            if self.load is None:
                raise RuntimeError(f"the backend of {self.name} is not installed; register one with load=")
            self._backend = self.load()
        x, rate = self._backend(text, reference, preset)
        return dsp.clip(dsp.resample(np.asarray(x, np.float32).ravel(), rate, SAMPLE_RATE))


def _sine() -> Backend:
    return lambda text, reference, preset: (dsp.sine(text, 110.0 + sum(map(ord, preset or "")) % 200), SAMPLE_RATE)


def _factory(name: str, cloning: bool, rate: int) -> Callable[..., Engine]:
    def make(load: Callable[[], Backend] | None = None) -> Engine:
        return Engine(name, cloning, rate, load or (_sine if name == "sine" else None))

    return make


for _line in ROSTER.split("\n"):
    if _line:
        _name, _voice, _rate = _line.split()
        ENGINES.register(_name)(_factory(_name, _voice == "clone", int(_rate)))


def synthesized(clips: DataFrame, engine: str, **options: Any) -> DataFrame:
    """``clips`` (text, preset, reference; missing columns are null) with pcm and sample_rate by a named engine."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in clips.dtypes), "pcm binary", "sample_rate int"])

    def run(batches):
        e = ENGINES.create(engine, **options)
        for b in short(batches):
            get = lambda c, b=b: b.column(c).to_pylist() if c in b.schema.names else [None] * b.num_rows
            made = (e.speak(t, r, p).astype("<f4").tobytes() for t, r, p in zip(get("text"), get("reference"), get("preset"), strict=True))
            for part, pcm in grown(b, made):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pcm, pa.binary()), pa.array([SAMPLE_RATE] * len(pcm), pa.int32())], names=[*b.schema.names, "pcm", "sample_rate"])

    return clips.mapInArrow(run, schema)
