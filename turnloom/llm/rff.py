"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel. Each partition sums its part of the normal equations; the sums of the partitions are added
in Spark and solved on the driver, whose work does not grow with the rows. Isotonic regression then makes the scores shares of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrow import short
from turnloom.llm.common import arrow_types, record, text_bytes
from turnloom.llm.docstats import BASE, RATIOS, doc_stats, labelled_sample, stats_table

#: Labelled rows that the scores are learned from, at most.
SAMPLE_ROWS = 24_000
#: Random features, and the ridge.
FEATURES, RIDGE = 192, 1e-3
#: Columns that enter the kernel.
INPUTS = RATIOS


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray  # raw scores
    shares: np.ndarray  # calibrated ones

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale, self.omega, self.phase)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.beta, self.knots, self.shares), 0.0, 1.0)


def squashed(x: np.ndarray) -> np.ndarray:
    """Statistics with long tails pulled in, so that one odd document cannot lie outside the kernel's reach."""
    return np.sign(x) * np.log1p(np.abs(x))


def fourier(z: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """sqrt(2 / D) cos(z w + b), and a constant."""
    z = np.clip(z, -6.0, 6.0)
    return np.hstack([np.sqrt(2.0 / omega.shape[1]) * np.cos(z @ omega + phase), np.ones((len(z), 1))])


def normal_sums(stats: DataFrame, features, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y of the rows (INPUTS and y): summed within partitions, the sums added by position."""
    schema = "i int, j int, v double"
    types = arrow_types(schema)
    up = np.triu_indices(width)

    def run(batches):
        a, c = np.zeros((width, width)), np.zeros(width)
        for b in short(batches):
            if b.num_rows:
                z = features(squashed(np.column_stack([b.column(k).to_numpy() for k in INPUTS])))
                a += z.T @ z
                c += z.T @ b.column("y").to_numpy()
        yield record({"i": pa.array(np.concatenate([up[0], np.arange(width)]).astype(np.int32)), "j": pa.array(np.concatenate([up[1], np.full(width, -1)]).astype(np.int32)), "v": pa.array(np.concatenate([a[up], c]))}, types)

    got = stats.select(*INPUTS, F.col("y").cast("double").alias("y")).mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    a, c = np.zeros((width, width)), np.zeros(width)
    own = got["j"].to_numpy() < 0
    c[got["i"].to_numpy()[own]] = got["v"].to_numpy()[own]
    i, j, v = (got[k].to_numpy()[~own] for k in "ijv")
    a[i, j] = v
    a[j, i] = v
    return a, c


def isotonic(raw: np.ndarray, y: np.ndarray, least: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; blocks' centres and shares, to be joined by lines. Shares stay off 0 and 1 by a pseudo-count."""
    order = np.argsort(raw, kind="stable")
    raw, y = raw[order], y[order].astype(float)
    parts = np.array_split(np.arange(len(raw)), max(1, len(raw) // least))
    blocks: list[list[float]] = []  # sum of y, count, sum of raw
    for p in parts:
        blocks.append([y[p].sum(), len(p), raw[p].sum()])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    base = y.mean()
    knots = np.array([b[2] / b[1] for b in blocks])
    shares = np.array([(b[0] + base) / (b[1] + 1) for b in blocks])
    shares = np.maximum.accumulate(shares)
    # ends: lines go on to the scores' bounds, so that ranks outside the blocks' centres stay apart
    return np.concatenate([[knots[0] - 1], knots, [knots[-1] + 1]]), np.concatenate([[shares[0] * 0.5], shares, [1 - (1 - shares[-1]) * 0.5]])


def fit(docs: DataFrame, marks: DataFrame, usable: Column, rows: int = SAMPLE_ROWS, width: int = FEATURES, ridge: float = RIDGE, seed: int = 17) -> QualityModel:
    """Learn from at most ``rows`` labelled documents for which ``usable`` (of doc_id) holds; a quarter of them calibrate."""
    sample = labelled_sample(docs, marks.where(usable), "quality", rows)
    table = stats_table(sample, y="int").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4))).persist()
    try:
        sums = table.agg(*[F.avg(_squashed(k)).alias(k) for k in INPUTS], *[F.stddev_pop(_squashed(k)).alias("s_" + k) for k in INPUTS], F.count("*").alias("n")).first()
        if not sums["n"]:
            d = len(INPUTS)
            return QualityModel(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(2), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
        mean = np.array([sums[k] for k in INPUTS])
        scale = np.array([max(sums["s_" + k], 1e-3) for k in INPUTS])
        rng = np.random.default_rng(seed)
        omega = rng.standard_normal((len(INPUTS), width)) / np.sqrt(0.6 * len(INPUTS))
        phase = rng.uniform(0, 2 * np.pi, width)

        def features(x):
            return fourier((x - mean) / scale, omega, phase)

        a, c = normal_sums(table.where("part > 0"), features, width + 1)
        n = max(a[-1, -1], 1.0)
        beta = np.linalg.solve(a / n + ridge * np.eye(width + 1), c / n)
        held = table.where("part = 0").select("doc_id", "y", *INPUTS).orderBy("doc_id", *INPUTS).toPandas()
    finally:
        table.unpersist()
    if held.empty:
        knots, shares = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        raw = features(squashed(held[list(INPUTS)].to_numpy(float))) @ beta
        knots, shares = isotonic(raw, held["y"].to_numpy())
    return QualityModel(mean, scale, omega, phase, beta, knots, shares)


def _squashed(k: str) -> Column:
    return F.signum(k) * F.log1p(F.abs(F.col(k)))


SCORES = "doc_id long, score double"


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for each row; null and empty texts have zero statistics and are scored by them.

    Null ids stay null; repeated rows and ties get equal scores; an empty table gives an empty one; other columns are not read.
    """
    types = arrow_types(SCORES)
    skip = len(BASE)

    def run(batches):
        for b in short(batches):
            if b.num_rows:
                x = np.array([doc_stats(t)[skip:] for t in text_bytes(b)], float)
                yield record({"doc_id": b.column("doc_id"), "score": pa.array(np.round(model.score(squashed(x)), 9))}, types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)
