"""Quality rules: an ordered decision list learned by sequential covering.

Each rule is a conjunction of thresholds over document statistics, grown on two thirds of the labelled sample by information
gain, pruned on the other third, and kept if it is precise on both. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.docstats import BASE, RATIOS, labelled_sample, stats_table, with_stats

#: Labelled rows that the list is learned from, at most.
SAMPLE_ROWS = 20_000


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.name)
        return c >= self.value if self.above else c <= self.value

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.value if self.above else x[self.name] <= self.value


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a document that meets all conditions of one is rejected, one that meets none is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self, prefix: str = "") -> Column:
        out = F.when(F.lit(False), F.lit(False))
        for rule in self.rules:
            test = F.lit(True)
            for c in rule:
                test = test & c.column(prefix)
            out = out.when(test, F.lit(False))
        return out.otherwise(F.lit(True))

    def rejects(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            out |= _covers(rule, x)
        return out


def _covers(rule, x) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], longest: int) -> tuple[Condition, ...]:
    rule: list[Condition] = []
    here = np.ones(len(bad), bool)
    while len(rule) < longest and (~bad & here).any():
        p0, n0 = (bad & here).sum(), (~bad & here).sum()
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for name, values in cuts.items():
            v = x[name]
            for above in (True, False):
                m = (v[None, here] >= values[:, None]) if above else (v[None, here] <= values[:, None])
                p = m @ bad[here].astype(np.float64)
                t = m.sum(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(t, 1)) - base), 0.0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (gain[k], Condition(name, above, float(values[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        here &= best[1].holds(x)
    return tuple(rule)


def _prune(rule, x, bad):
    def worth(r):
        m = _covers(r, x)
        p, n = (m & bad).sum(), (m & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, most_rules: int = 12, longest: int = 4, precision: float = 0.9, least: int = 3, cuts_per_statistic: int = 48) -> DecisionList:
    """Sequential covering. With no bad rows, or no good ones to hold them against, the list is empty."""
    rules: list[tuple[Condition, ...]] = []
    fold = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        g, q = left & ~fold, left & fold
        if (bad & g).sum() < least or not (~bad & g).any():
            break
        at = {k: v[g] for k, v in x.items()}
        cuts = {k: np.unique(np.quantile(v[bad[g]], np.linspace(0, 1, cuts_per_statistic))) for k, v in at.items()}
        rule = _prune(_grow(at, bad[g], cuts, longest), {k: v[q] for k, v in x.items()}, bad[q]) if len(cuts) else ()
        m = _covers(rule, x) & left if rule else np.zeros(len(bad), bool)
        if not rule or (m & bad).sum() < least or (m & bad).sum() < precision * m.sum():
            break
        rules.append(rule)
        left &= ~m
    return DecisionList(tuple(rules))


def fit_decision_list(docs: DataFrame, marks: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learn from at most ``rows`` labelled documents; label 0 is what rules reject. Without labels the list is empty."""
    got = stats_table(labelled_sample(docs, marks, label, rows), y="int").orderBy("doc_id", *BASE).toPandas()
    if got.empty:
        return DecisionList(())
    x = {k: got[k].to_numpy(np.float64) for k in (*BASE, *RATIOS)}
    order = np.argsort((got["doc_id"].to_numpy(np.int64) * 2654435761) % (1 << 31), kind="stable")
    return learn({k: v[order] for k, v in x.items()}, got["y"].to_numpy()[order] == 0)


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 50) | (100 * repeats > 50 * words)


def judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the statistics, base_failed and kept, a row for each row of ``docs``.

    Null and empty texts have no words and fail the base. Null ids are kept as null. Repeated rows and ties have equal results;
    an empty table gives an empty one; other columns are not read.
    """
    return stats_table(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.kept())


def accepted(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    own = "_tl_"
    return with_stats(docs, own).where(~base_failed(own) & rules.kept(own)).select(*docs.columns)
