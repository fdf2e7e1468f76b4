"""Word error of several speakers: each speaker's words in one stream, the pairing of streams with the fewest errors.

A surplus stream on either side counts with all its words, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrow import short
from turnloom.operators.align import timed_words
from turnloom.operators.assignment import assign
from turnloom.schemas import WORDS


def word_streams(utterances: DataFrame) -> DataFrame:
    """(clip_id, speaker_id, words): each speaker's words, utterances in order of start and end."""
    u = utterances
    if "words" not in u.columns:
        u = u.withColumn("words", F.array().cast(WORDS))
    order = F.col("ord") if "ord" in u.columns else F.lit(0)
    rows = F.array_sort(F.collect_list(F.struct("start_s", "end_s", order.alias("o"), timed_words(F.col("words"), F.col("text"), F.col("start_s"), F.col("end_s")).alias("w"))))
    return u.groupBy("clip_id", "speaker_id").agg(F.flatten(F.transform(rows, lambda r: r.w)).alias("words"))


class Streams:
    """Word streams of one side of a clip as flat arrays: where each stream ends, the words' numbers and times."""

    def __init__(self, sizes: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.sizes, self.codes, self.start, self.end = np.diff(self.at), codes, start, end

    def __len__(self) -> int:
        return len(self.sizes)


def paired(sides: Sequence[pa.StructArray], sizes: Sequence[np.ndarray]) -> list[Streams]:
    """Streams of both sides from their words in Arrow, equal texts under equal numbers on either side."""
    texts = [w.field("text") for w in sides]
    codes = pa.concat_arrays(texts).dictionary_encode("encode").indices.to_numpy()
    cut = np.split(codes, [len(texts[0])])
    times = [[w.field(k).to_numpy(zero_copy_only=False) for k in ("start_s", "end_s")] for w in sides]
    return [Streams(n, c, *t) for n, c, t in zip(sizes, cut, times, strict=True)]


def listed(ref: list[list[dict]], hyp: list[list[dict]]) -> list[Streams]:
    """The same from lists of words."""
    kind = pa.struct([("text", pa.string()), ("start_s", pa.float64()), ("end_s", pa.float64())])
    return paired([pa.array([w for s in side for w in s], kind) for side in (ref, hyp)], [np.array([len(s) for s in side], np.int64) for side in (ref, hyp)])


def distances(ref: Streams, hyp: Streams, collar: float | None = None) -> np.ndarray:
    """Word edits with unit costs of every pair of streams. With a collar, equal words also have to meet in time within it.

    All streams of ``hyp`` lie behind each other in one row, each after a cell for its start, and one word of ``ref`` is taken at a time.
    A cell holds its edits less its place in the stream, so that insertions run along as a running minimum; each stream lies lower than
    the one before it by more than edits can differ, so that none runs on into the next.
    """
    k, ends = np.arange(len(hyp)), hyp.at[1:] + np.arange(len(hyp))
    drop = len(hyp.codes) + (int(ref.sizes.max()) if len(ref) else 0) + 2
    level = -drop * np.repeat(k, hyp.sizes + 1)
    word = np.ones(len(level), bool)
    word[hyp.at[:-1] + k] = False
    codes = np.full(len(level), -1, np.int64)
    codes[word] = hyp.codes
    if collar is not None:
        start, end = np.zeros(len(level)), np.zeros(len(level))
        start[word], end[word] = hyp.start, hyp.end
    out = np.empty((len(ref), len(hyp)), np.int64)
    cell, from_left = np.empty_like(level), np.empty_like(level[1:])
    for r, (i, j) in enumerate(zip(ref.at[:-1].tolist(), ref.at[1:].tolist(), strict=True)):
        cell[:] = level
        for w in range(i, j):
            same = codes == ref.codes[w]
            if collar is not None:
                same &= (start <= ref.end[w] + collar) & (end >= ref.start[w] - collar)
            np.subtract(cell[:-1], same[1:], out=from_left)
            cell += 1
            np.minimum(cell[1:], from_left, out=cell[1:])
            cell = np.minimum.accumulate(cell)
        out[r] = cell[ends] - level[ends] + hyp.sizes
    return out


def edit_distance(ref: list[dict], hyp: list[dict], collar: float | None = None) -> int:
    """``distances`` of two streams."""
    return int(distances(*listed([ref], [hyp]), collar)[0, 0])


def errors(ref: Streams, hyp: Streams, collar: float | None = None) -> int:
    """Fewest edits over all pairings of streams. A pair's edits do not depend on other pairs, so assignment is exact."""
    n = max(len(ref), len(hyp))
    if not n:
        return 0
    cost = np.zeros((n, n), np.int64)
    cost[: len(ref)] += ref.sizes[:, None]
    cost[:, : len(hyp)] += hyp.sizes
    cost[: len(ref), : len(hyp)] = distances(ref, hyp, collar)
    return int(cost[np.arange(n), assign(cost)].sum())


def score(reference: DataFrame, hypothesis: DataFrame, collar: float | None = None, name: str = "cpwer") -> DataFrame:
    """(clip_id, errors, n_ref_words, rate) of every clip that either side knows.

    Without reference words the rate is 0 if there are no other words either, else 1.
    """
    side = lambda t, c: word_streams(t).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("speaker_id", "words"))).alias(c))
    both = side(reference, "r").join(side(hypothesis, "h"), "clip_id", "full_outer")
    schema = f"clip_id string, errors long, n_ref_words long, {name} double"

    def words_of(cell):
        """A side's words in one array, and how many each stream has."""
        w = (cell.values if cell.is_valid else pa.array([], cell.type.value_type)).field("words")
        return w.flatten(), pc.fill_null(w.value_lengths(), 0).to_numpy(zero_copy_only=False)

    def run(batches):
        # words stay in Arrow: as Python objects those of a batch would take many times its bytes
        for b in short(batches):
            out = []
            for clip, *sides in zip(b.column("clip_id").to_pylist(), b.column("r"), b.column("h"), strict=True):
                rs, hs = paired(*zip(*map(words_of, sides), strict=True))
                n, e = len(rs.codes), errors(rs, hs, collar)
                out.append((clip, e, n, e / n if n else float(e > 0)))
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["clip_id", "errors", "n_ref_words", name])

    return both.mapInArrow(run, schema)


def cpwer(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    return score(reference, hypothesis)


def tcpwer(reference: DataFrame, hypothesis: DataFrame, collar: float = 0.0) -> DataFrame:
    return score(reference, hypothesis, collar, "tcpwer")


def macro_mean(scores: DataFrame, column: str) -> DataFrame:
    """The mean over clips, each counting once; an empty table raises."""
    return scores.agg(F.when(F.count(column) == 0, F.raise_error("no clips to score").cast("double")).otherwise(F.avg(column)).alias(f"mean_{column}"))
