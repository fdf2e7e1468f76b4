"""Aligners by name: from a clip's text, duration and audio to words with times."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import vocabulary_form, words
from turnloom.operators.align import clamped, proportional, textgrid_words
from turnloom.plans.registry import ALIGNERS
from turnloom.sources.wav import encode

#: A recogniser: samples, rate and normalised tokens to (start, end) of each.
Segmenter = Callable[[np.ndarray, int, list[str]], list[tuple[float, float]]]


@ALIGNERS.register("proportional")
def _proportional() -> Callable[[DataFrame], DataFrame]:
    """Words by their length alone; needs text and duration_s."""
    return lambda clips: clips.withColumn("words", proportional(F.col("text"), F.col("duration_s")))


@ALIGNERS.register("ctc_segmentation")
def _ctc(load: Callable[[], Segmenter] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Words from a recogniser's segments, clamped; a token without a letter that it knows raises. Needs pcm and sample_rate too."""

    def run(clips: DataFrame) -> DataFrame:
        if load is None:
            raise RuntimeError("ctc_segmentation needs a recogniser: its library is not installed; give load=")
        known = F.transform(F.col("_w"), lambda w: F.coalesce(vocabulary_form(w), F.raise_error(F.concat(F.lit("no letters to align in "), w)).cast("string")))
        rows = clips.withColumn("_w", words(F.col("text"))).withColumn("_t", known)
        schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), "_s array<struct<start_s:double,end_s:double>>"])

        def segment(batches):
            model = load()
            for b in batches:
                got = [[{"start_s": float(s), "end_s": float(e)} for s, e in model(np.frombuffer(p, "<f4"), r, t)] for p, r, t in zip(*(b.column(c).to_pylist() for c in ("pcm", "sample_rate", "_t")), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])))], names=[*b.schema.names, "_s"])

        out = rows.mapInArrow(segment, schema)
        return out.withColumn("words", clamped(F.col("_w"), F.col("_s"), F.col("duration_s"))).drop("_w", "_t", "_s")

    return run


@ALIGNERS.register("mfa")
def _mfa(binary: str = "mfa", dictionary: str = "english_us_arpa", model: str = "english_us_arpa") -> Callable[[DataFrame], DataFrame]:
    """Words from the command-line aligner, run on the executors over a folder of one clip; a missing binary raises."""

    def run(clips: DataFrame) -> DataFrame:
        schema = ", ".join([*(f"`{n}` {t}" for n, t in clips.dtypes), "_grid string"])

        def ask(batches):
            if shutil.which(binary) is None:
                raise RuntimeError(f"{binary} is not installed on this executor; install the Montreal Forced Aligner")
            for b in batches:
                grids = [one(*x) for x in zip(*(b.column(c).to_pylist() for c in ("pcm", "sample_rate", "text")), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(grids, pa.string())], names=[*b.schema.names, "_grid"])

        def one(pcm: bytes, rate: int, text: str) -> str:
            if not text or text.isspace():
                raise ValueError("a blank text has no words to align")
            with tempfile.TemporaryDirectory() as d:
                os.makedirs(f"{d}/in")
                with open(f"{d}/in/clip.wav", "wb") as f:
                    f.write(encode(np.frombuffer(pcm, "<f4"), rate))
                with open(f"{d}/in/clip.lab", "w", encoding="utf-8") as f:
                    f.write(text)
                got = subprocess.run([binary, "align", f"{d}/in", dictionary, model, f"{d}/out"], capture_output=True, text=True)
                if got.returncode:
                    raise RuntimeError(f"{binary} failed: {got.stderr[-500:]}")
                with open(f"{d}/out/clip.TextGrid", encoding="utf-8") as f:
                    return f.read()

        return clips.mapInArrow(ask, schema).withColumn("words", textgrid_words(F.col("_grid"))).drop("_grid")

    return run
