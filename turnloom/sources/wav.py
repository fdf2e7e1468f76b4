"""WAV files: 16-bit PCM to float samples and back, as tables."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.config import SAMPLE_RATE
from turnloom.functions import dsp
from turnloom.functions.arrow import first_size, grown, short


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Mono float32 samples (a 32768th a step) at the file's own rate. Anything but 16-bit PCM raises."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError(f"16-bit PCM expected, {8 * w.getsampwidth()} bits found")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / np.float32(32768.0)
        return dsp.downmix(x, w.getnchannels()).astype(np.float32), w.getframerate()


def encode(x: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit file; samples are clipped, scaled by 32767 and cut towards zero."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1.0, 1.0) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def wav_paths(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """(path, speaker): the directory's WAV files, no content read; speaker is the folder's name. Row order is not fixed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", str(recursive).lower()).load(directory)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("speaker"))


def voice_bank(spark: SparkSession, directory: str) -> DataFrame:
    """(speaker, path) of ``directory/speaker/*.wav``; speakers without files do not appear."""
    return wav_paths(spark, f"{directory.rstrip('/')}/*/").select("speaker", "path")


AUDIO = "path string, pcm binary, sample_rate int, num_samples long"


def read_wavs(spark: SparkSession, directory: str, recursive: bool = False, rate: int | None = None) -> DataFrame:
    """(path, pcm, sample_rate, num_samples): the directory's WAV files decoded, resampled only where ``rate`` is given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", str(recursive).lower()).load(directory)
    return decoded(files.select("path", "content"), rate)


def decoded(files: DataFrame, rate: int | None = None) -> DataFrame:
    """AUDIO of (path, content), resampled only where ``rate`` is given."""

    def read(content: bytes) -> tuple[bytes, int]:
        x, own = decode(content)
        return (dsp.resample(x, own, rate) if rate else x).astype("<f4").tobytes(), rate or own

    def run(batches):
        for b in short(batches):
            for part, got in grown(b, map(read, b.column("content").to_pylist()), first_size):
                yield pa.RecordBatch.from_arrays([part.column("path"), pa.array([x for x, _ in got], pa.binary()), pa.array([r for _, r in got], pa.int32()), pa.array([len(x) // 4 for x, _ in got], pa.int64())], names=["path", "pcm", "sample_rate", "num_samples"])

    return files.mapInArrow(run, AUDIO)


def reference_audio(spark: SparkSession, directory: str) -> DataFrame:
    """Voice references decoded and resampled to the engine's rate."""
    return read_wavs(spark, f"{directory.rstrip('/')}/*/", rate=SAMPLE_RATE)


def local_catalogue(directory: str | None, recursive: bool) -> list[tuple[np.ndarray, int]]:
    """A small corpus of noises or responses, read on the driver and given to the tasks; an empty one raises."""
    from pathlib import Path

    top = Path(directory or "")
    paths = sorted(top.rglob("*.wav") if recursive else top.glob("*.wav")) if directory else []
    if not paths:
        raise (ValueError if recursive else FileNotFoundError)(f"no WAV files in {directory!r}")
    return [decode(p.read_bytes()) for p in paths]


def encoded(clips: DataFrame) -> DataFrame:
    """(clip_id, wav) and ``split``, where there is one, from (clip_id, pcm, sample_rate)."""
    keep = [c for c in ("clip_id", "split") if c in clips.columns]

    def run(batches):
        for b in short(batches):
            made = (encode(np.frombuffer(p, "<f4"), r) for p, r in zip(b.column("pcm").to_pylist(), b.column("sample_rate").to_pylist(), strict=True))
            for part, wav in grown(b, made):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(wav, pa.binary())], names=[*keep, "wav"])

    return clips.select(*keep, "pcm", "sample_rate").mapInArrow(run, ", ".join([*(f"{c} string" for c in keep), "wav binary"]))


def write_wavs(clips: DataFrame, root: str) -> None:
    """``root/<split>/audio/<clip_id>.wav`` for (clip_id, split, pcm, sample_rate).

    Files are written to where every executor can write: a mounted or local path. A file is written whole under another name first.
    """
    import os

    def put(part):
        for r in part:
            folder = os.path.join(root, r["split"], "audio")
            os.makedirs(folder, exist_ok=True)
            path = os.path.join(folder, f"{r['clip_id']}.wav")
            with open(f"{path}.part", "wb") as f:
                f.write(r["wav"])
            os.replace(f"{path}.part", path)

    encoded(clips).foreachPartition(put)
