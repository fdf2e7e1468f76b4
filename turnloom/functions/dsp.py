"""Sample arithmetic on float32 arrays, one clip at a time."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np

from turnloom.config import SAMPLE_RATE

#: Decay constants of a synthetic tail that are rendered.
TAIL = 6
#: Samples of a sine that are made at once, and how many such pieces a process keeps (64 MB): texts at one pitch begin with the same samples.
PIECE, KEPT = 1 << 16, 256


def clip(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -1.0, 1.0).astype(np.float32)


def gain(x: np.ndarray, gain_db: float) -> np.ndarray:
    return clip(x * np.float32(10.0 ** (gain_db / 20.0)))


def rms(x: np.ndarray) -> float:
    """Root of the mean square in double precision; 0 for no samples."""
    return float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0


def mix_at_snr(x: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    """Noise scaled to lie ``snr_db`` under the signal; silent noise adds nothing."""
    level = rms(noise)
    scale = rms(x) / 10.0 ** (snr_db / 20.0) / level if level > 0 else 0.0
    return clip(x + noise * np.float32(scale))


def generator(seed: int, *keys: str) -> np.random.Generator:
    """Random numbers that depend on the seed and the keys alone."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(":".join([str(seed), *keys]).encode()).digest()[:8], "little"))


def white_noise(x: np.ndarray, snr_db: float, rng: np.random.Generator) -> np.ndarray:
    return mix_at_snr(x, rng.standard_normal(len(x)).astype(np.float32), snr_db)


def fit_length(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Exactly n samples: short ones repeated, long ones cropped at a drawn place, none as silence."""
    if not len(x):
        return np.zeros(n, np.float32)
    if len(x) < n:
        return np.tile(x, -(-n // len(x)))[:n]
    start = int(rng.integers(0, len(x) - n + 1))
    return x[start : start + n]


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation at the new rate; the last sample holds at the edge."""
    if not len(x) or source == target:
        return x
    n = max(1, round(len(x) / source * target))
    return np.interp(np.arange(n) / target, np.arange(len(x)) / source, x).astype(np.float32)


def downmix(x: np.ndarray, channels: int) -> np.ndarray:
    return x if channels == 1 else x.reshape(-1, channels).mean(axis=1)


def decaying_response(decay_s: float, rate: int) -> np.ndarray:
    """An exponential impulse response that sums to 1."""
    if decay_s <= 0:
        raise ValueError("decay has to be above 0")
    e = np.exp(-np.arange(max(2, round(rate * decay_s * TAIL))) / (decay_s * rate))
    return (e / e.sum()).astype(np.float32)


def convolve(x: np.ndarray, response: np.ndarray) -> np.ndarray:
    """The first len(x) samples of the convolution, by FFT."""
    n = len(x) + len(response) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(response, size), size)[: len(x)]


def reverb(x: np.ndarray, response: np.ndarray, wet_level: float) -> np.ndarray:
    if not 0.0 <= wet_level <= 1.0:
        raise ValueError("wet level has to lie in [0, 1]")
    return clip((1.0 - wet_level) * x + wet_level * convolve(x, response)) if len(x) else x


def silence(duration_s: float, rate: int = SAMPLE_RATE) -> np.ndarray:
    return np.zeros(max(0, round(duration_s * rate)), np.float32)


@functools.lru_cache(KEPT)
def _tone(frequency: float, rate: int, k: int) -> np.ndarray:
    """The k-th PIECE samples of 0.3 of a sine, not to be written to.

    sin(a + b) from the sines and cosines of the block starts a and of the places b in a block: few sines for many samples.
    """
    step, turn = 256, 2 * np.pi * frequency / rate
    n = PIECE // step
    a, b = turn * step * np.arange(k * n, (k + 1) * n)[:, None], turn * np.arange(step)
    out = (0.3 * (np.sin(a) * np.cos(b) + np.cos(a) * np.sin(b))).astype(np.float32).ravel()
    out.flags.writeable = False
    return out


def sine_length(text: str, rate: int = SAMPLE_RATE) -> int:
    return round(max(0.3, 0.06 * len(text)) * rate)


def tones(frequency: float, n: int, rate: int = SAMPLE_RATE) -> Iterator[tuple[int, np.ndarray]]:
    """The first n samples of 0.3 of a sine in pieces: where each starts, and its samples."""
    for at in range(0, n, PIECE):
        yield at, _tone(frequency, rate, at // PIECE)[: n - at]


def sine(text: str, frequency: float, rate: int = SAMPLE_RATE) -> np.ndarray:
    """0.3 of a sine for 0.06 s a character, 0.3 s at least."""
    out = np.empty(sine_length(text, rate), np.float32)
    for at, x in tones(frequency, len(out), rate):
        out[at : at + len(x)] = x
    return out


def add_at(canvas: np.ndarray, x: np.ndarray, start: int) -> None:
    canvas[start : start + len(x)] += x
