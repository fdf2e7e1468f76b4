"""Audio by clip: levels, augmentation chains, and mixtures rendered from placed clips.

Audio is ``pcm`` (float32, little endian) with ``sample_rate``. A chain of augmenters is one pass over it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.config import SAMPLE_RATE, AugmentSpec
from turnloom.functions import dsp
from turnloom.functions.arrow import grown, short
from turnloom.functions.text import preset_pitch
from turnloom.plans.registry import AUGMENTERS


def samples(pcm: bytes) -> np.ndarray:
    return np.frombuffer(pcm, "<f4")


def sine_duration(text: Column) -> Column:
    """Seconds of the sine voice for a text, in whole samples; no audio needed."""
    return F.rint(F.greatest(F.lit(0.3), F.lit(0.06) * F.length(text)) * SAMPLE_RATE) / SAMPLE_RATE


def rms_of(array: Column) -> Column:
    """Level of an ARRAY<FLOAT>, JVM-side; 0 for none."""
    squares = F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(array) > 0, F.sqrt(squares / F.size(array))).otherwise(0.0)


def gained(array: Column, gain_db: float) -> Column:
    """Gain on an ARRAY<FLOAT>, JVM-side, clipped to [-1, 1]."""
    k = F.lit(10.0 ** (gain_db / 20.0)).cast("float")
    return F.transform(array, lambda x: F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), (x * k).cast("float"))))


def _spoken(text: str | None, hz: float) -> bytes:
    if not text or text.isspace():
        raise ValueError("a blank text cannot be spoken")
    return dsp.sine(text, hz).tobytes()


def synthesized(clips: DataFrame) -> DataFrame:
    """``clips`` (text, preset) with the sine voice's pcm and sample_rate. Blank texts raise."""
    out = clips.withColumn("_hz", preset_pitch(F.col("preset")))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in clips.dtypes), "pcm binary", "sample_rate int"])

    def run(batches):
        for b in short(batches):
            keep = [n for n in b.schema.names if n != "_hz"]
            for part, pcm in grown(b, map(_spoken, b.column("text").to_pylist(), b.column("_hz").to_pylist())):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(pcm, pa.binary()), pa.array([SAMPLE_RATE] * len(pcm), pa.int32())], names=[*keep, "pcm", "sample_rate"])

    return out.mapInArrow(run, schema)


def augmented(clips: DataFrame, chain: Sequence[AugmentSpec], seed: int = 0) -> DataFrame:
    """``clips`` (clip_id, pcm, sample_rate) with the chain applied in order, in one pass; draws are keyed by seed, clip and place.

    An empty chain changes nothing.
    """
    if not chain:
        return clips
    steps = [AUGMENTERS.create(s.name, **s.options) for s in chain]

    def changed(clip: str, pcm: bytes, rate: int) -> bytes:
        x = samples(pcm)
        for i, step in enumerate(steps):
            x = step(x, rate, dsp.generator(seed, clip, str(i)))
        return x.astype("<f4").tobytes()

    def run(batches):
        for b in short(batches):
            for part, out in grown(b, map(changed, *(b.column(k).to_pylist() for k in ("clip_id", "pcm", "sample_rate")))):
                yield part.set_column(part.schema.get_field_index("pcm"), "pcm", pa.array(out, pa.binary()))

    return clips.mapInArrow(run, clips.schema)


def by_clip(parts: DataFrame) -> DataFrame:
    """Parts (clip_id, ord) of a clip in one partition and in order.

    The number of partitions is named: rows without audio are small, and merged partitions would make all their audio in one task. They
    are dealt by a hash of the clip: by the clip itself, an exchange before that deals the same way would stand for this one and be merged.
    """
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, F.xxhash64("clip_id")).sortWithinPartitions("clip_id", "ord")


def rendered(placed: DataFrame, dealt: bool = False) -> DataFrame:
    """(clip_id, pcm, sample_rate, num_samples) from (clip_id, ord, offset_s, kept_s, pcm, sample_rate).

    Where ``placed`` has (text, preset) instead of pcm and sample_rate, the sine voice speaks the texts here, and only texts move.

    Each clip's part is added where it starts; the sum is clipped once at the end. Parts of one clip need one sample rate. A clip's parts
    are bounded by its turns and come as a stream sorted by clip, so only one canvas is held; speech is added to it in pieces. ``dealt``
    says that ``by_clip`` dealt the rows already.
    """
    voiced = "pcm" in placed.columns
    schema = "clip_id string, pcm binary, sample_rate int, num_samples long"
    names = ["clip_id", "pcm", "sample_rate", "num_samples"]
    kinds = [pa.string(), pa.binary(), pa.int32(), pa.int64()]

    def mixed(clip, parts):
        rates = {r for *_, r in parts}
        if len(rates) != 1:
            raise ValueError(f"clip {clip} mixes sample rates {sorted(rates)}")
        rate = rates.pop()
        cut = []
        for o, k, p, hz, _ in parts:
            kept = round(k * rate)
            n = len(range(len(p) // 4 if voiced else dsp.sine_length(p, rate))[:kept])
            # a part's room is what it keeps, even where its audio is shorter
            cut.append((round(o * rate), n, max(kept, n), p, hz))
        canvas = np.zeros(max(s + room for s, _, room, *_ in cut), np.float32)
        for s, n, _, p, hz in cut:
            for at, x in [(0, samples(p)[:n])] if voiced else dsp.tones(hz, n, rate):
                dsp.add_at(canvas, x, s + at)
        np.clip(canvas, -1.0, 1.0, out=canvas)
        # the canvas itself is sent, not a copy
        pcm = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, canvas.nbytes], np.int32)), pa.py_buffer(canvas)])
        return pa.RecordBatch.from_arrays([pa.array([clip], kinds[0]), pcm, pa.array([rate], kinds[2]), pa.array([len(canvas)], kinds[3])], names=names)

    def run(batches):
        clip, parts = None, []
        for b in short(batches):
            for c, o, k, p, r in zip(*(b.column(n).to_pylist() for n in b.schema.names if n != "ord"), strict=True):
                if c != clip:
                    if parts:
                        yield mixed(clip, parts)
                    clip, parts = c, []
                parts.append((o, k, p, None, r) if voiced else (o, k, p, r, SAMPLE_RATE))
        if parts:
            yield mixed(clip, parts)

    source = ("pcm", "sample_rate") if voiced else ("text", preset_pitch(F.col("preset")).alias("hz"))
    parts = placed.select("clip_id", "ord", "offset_s", "kept_s", *source)
    return (parts if dealt else by_clip(parts)).mapInArrow(run, schema)


def array_chain(table: DataFrame, key: str, array: str, f) -> DataFrame:
    """(key, array): f(key, float32 array) on an ARRAY<FLOAT> column, for tables that hold samples as arrays."""
    kind = dict(table.dtypes)[key]

    def run(batches):
        for b in short(batches):
            made = (f(str(k), np.asarray(x, np.float32)) for k, x in zip(b.column(key).to_pylist(), b.column(array).to_pylist(), strict=True))
            for part, out in grown(b, made, lambda x: x.nbytes):
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(out, pa.list_(pa.float32()))], names=[key, array])

    return table.select(key, array).mapInArrow(run, f"`{key}` {kind}, `{array}` array<float>")
