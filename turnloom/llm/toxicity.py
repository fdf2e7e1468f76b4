"""Toxicity by a weighted finite-state pattern grammar.

Five weighted transducers read the words of a clause side by side:

* insult: words whose weight comes from arcs learned from labelled documents, word stems beside a few given ones; close repeats weigh more;
* threat: a verb of harm and a word that points at a person, within a few words of each other, either way round;
* target: insults shortly after, or before, a word that points at a person;
* negation: after a negating word the next few words' matches are negated;
* reported speech: after a verb of saying, the matches up to the clause's end are reported.

They are composed into one table before any text is read: its states are those of all five, its arcs carry all marks and the product of all
weights. A clause's score is the sum of its matches by those weights; a document's score comes from its matched clauses through a
logistic fit.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrow import short
from turnloom.llm.common import arrow_types, record
from turnloom.llm.docstats import labelled_sample

#: Labelled rows that the grammar is learned from, at most.
SAMPLE_ROWS = 24_000
#: Learned arcs, at most: the size of the model, not of what it reads.
MOST_ARCS = 6_000
#: Lengths of the stems that may become arcs; 0 is the whole word.
STEMS = (0, 3, 4, 5, 6, 7, 8)
#: Words after a negation, an insult or a verb of harm that it reaches, and words after one that points at a person.
REACH, AIM = 3, 4

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Words of the closed classes, English, German, French and Spanish.
CLASSES: dict[int, str] = {
    THREAT: "kill hurt destroy beat stab shoot strangle burn punch töten umbringen schlagen tuer frapper brûler matar golpear quemar",
    TARGET: "you your yours u he him she her they them du dich dir ihr euch tu toi te vous ils elles tú ti ustedes ellos ellas",
    NEGATION: "not no never don't isn't aren't won't nicht kein keine nie pas jamais ni nunca",
    REPORT: "said says say told wrote quoted called claims claimed sagte sagt schrieb dit écrit dijo dice escribió",
}
GIVEN = {w: c for c, words in CLASSES.items() for w in words.split()}
#: Insults known before any label; learned weights go before this one.
SEEDS = "idiot moron stupid pathetic worthless scum loser"
SEED_WEIGHT = 2.0

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_CLAUSE_END = re.compile(r"[.?!;\n]")


NEGATED, REPORTED, TARGETED, REPEATED, MATCHED, THREATENED, AIMED = (1 << i for i in range(7))
#: What a match weighs under each mark; a threat's own weight is that of its two words together.
WEIGHTS = {NEGATED: 0.5, REPORTED: 0.7, TARGETED: 1.3, REPEATED: 1.1, THREATENED: 2.0}


@dataclass(frozen=True)
class Transducer:
    """For each (state, class) the next state and the marks on what is matched there; class -1 is any other, and without it states stay."""

    arcs: dict[tuple[int, int], tuple[int, int]]

    def read(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), self.arcs.get((state, -1), (state, 0)))


def _insult() -> Transducer:
    down = {(s, -1): (max(0, s - 1), 0) for s in range(REACH + 1)}
    return Transducer(down | {(s, INSULT): (REACH, MATCHED | REPEATED * (s > 0)) for s in range(REACH + 1)})


def _threat() -> Transducer:
    """States 1 to REACH wait for a person, those above for a verb of harm."""
    verb, person = range(1, REACH + 1), range(REACH + 1, 2 * REACH + 1)
    arcs = {(0, -1): (0, 0)} | {(s, -1): (s - 1, 0) for s in verb} | {(s, -1): (s - 1 if s > REACH + 1 else 0, 0) for s in person}
    for s in (0, *verb, *person):
        arcs[s, THREAT] = (0, THREATENED) if s in person else (REACH, 0)
        arcs[s, TARGET] = (0, THREATENED) if s in verb else (2 * REACH, 0)
    return Transducer(arcs)


def _target() -> Transducer:
    """A state counts words left since a person, and since an insult that no person came before."""
    number = {(a, i): a * (REACH + 1) + i for a in range(AIM + 1) for i in range(REACH + 1)}
    arcs = {}
    for (a, i), s in number.items():
        arcs[s, -1] = (number[max(0, a - 1), max(0, i - 1)], 0)
        arcs[s, TARGET] = (number[AIM, 0], AIMED * (i > 0))
        arcs[s, INSULT] = (number[max(0, a - 1), 0], TARGETED) if a else (number[0, REACH], 0)
    return Transducer(arcs)


def _negation() -> Transducer:
    mark = lambda s: NEGATED * (s > 0)
    return Transducer({(s, -1): (max(0, s - 1), mark(s - 1)) for s in range(REACH + 1)} | {(s, NEGATION): (REACH, NEGATED) for s in range(REACH + 1)})


def _reported() -> Transducer:
    return Transducer({(0, REPORT): (1, 0), (1, -1): (1, REPORTED)})


PARTS = {"insult": _insult(), "threat": _threat(), "target": _target(), "negation": _negation(), "reported": _reported()}


def compose(*parts: Transducer) -> list[list[tuple[int, int, float]]]:
    """The product's table, states by classes: next state, marks, and the product of the marks' weights. Only states that can be reached."""
    start = (0,) * len(parts)
    number, todo, table = {start: 0}, [start], []
    for state in todo:
        row = []
        for symbol in range(6):
            read = [p.read(s, symbol) for p, s in zip(parts, state, strict=True)]
            to, marks = tuple(s for s, _ in read), sum(m for _, m in read)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append((number[to], marks, math.prod(w for m, w in WEIGHTS.items() if marks & m)))
        table.append(row)
    return table


TABLE = compose(*PARTS.values())
#: Features of a document: see ``Grammar.features``.
N_FEATURES = 10


def stems(word: str) -> list[str]:
    """The arcs that accept a word: itself, marked by a final blank, and its beginnings."""
    n = len(word)
    return [word + " " if k == 0 else word[:k] for k in STEMS if k < n]


class Grammar:
    """The learned arcs, ready to run: an automaton finds words that may match; clauses with none cost nothing."""

    def __init__(self, arcs: dict[str, float], table: list[list[tuple[int, int, float]]] = TABLE):
        import ahocorasick

        self.arcs, self.table = arcs, table
        self.find = ahocorasick.Automaton()
        for a in arcs:
            self.find.add_word(a.rstrip(" "), len(a.rstrip(" ")))
        for w, c in GIVEN.items():
            if c == THREAT:
                self.find.add_word(w, len(w))
        if len(self.find):
            self.find.make_automaton()

    def weight(self, word: str) -> float:
        """The heaviest path of the insult transducer over one word."""
        get = self.arcs.get
        return max([get(s, 0.0) for s in stems(word)])

    def clauses(self, text: str):
        """The matches, (weight of the words, marks, weight by the marks), of each clause that has one."""
        low = text.lower()
        if not len(self.find):
            return
        hits = [e - n + 1 for e, n in self.find.iter(low)]
        hits = [h for h in dict.fromkeys(hits) if not h or not low[h - 1].isalpha()]
        if not hits:
            return
        ends = [m.start() for m in _CLAUSE_END.finditer(low)]
        done = -1
        for h in hits:
            k = bisect_right(ends, h)
            if k == done:
                continue
            done = k
            first, last = (ends[k - 1] + 1 if k else 0), (ends[k] if k < len(ends) else len(low))
            got = self.clause(_WORD.findall(low, first, last))
            if got is not None:
                yield got

    def clause(self, words: list[str]) -> list[tuple[float, int, float]] | None:
        out: list[tuple[float, int, float]] = []
        state, insult = 0, -1
        for w in words:
            c = GIVEN.get(w, OTHER)
            x = self.weight(w) if c == OTHER else 0.0
            state, marks, factor = self.table[state][INSULT if x > 0 else c]
            if marks & MATCHED:
                insult = len(out)
                out.append((x, marks, x * factor))
            if marks & THREATENED:
                out.append((0.0, marks & ~MATCHED, factor))
            if marks & AIMED and insult >= 0:  # the insult that this person follows
                x, m, y = out[insult]
                out[insult] = (x, m | TARGETED, y * WEIGHTS[TARGETED])
        return out or None

    def features(self, text: str | None) -> list[float]:
        """The document's matched clauses in numbers: weight by marks, direct and other threats, best clause, their count and share."""
        out = [0.0] * N_FEATURES
        if not text:
            return out
        plain = negated = reported = targeted = repeated = threats = indirect = best = total = 0.0
        n = 0
        for matches in self.clauses(text):
            n += 1
            score = 0.0
            for x, m, y in matches:
                score += y
                if m & THREATENED:
                    if m & (NEGATED | REPORTED):
                        indirect += 1
                    else:
                        threats += 1
                elif m & NEGATED:
                    negated += x
                elif m & REPORTED:
                    reported += x
                else:
                    plain += x
                    targeted += x * bool(m & TARGETED)
                    repeated += x * bool(m & REPEATED)
            best, total = max(best, score), total + score
        return [math.log1p(plain), math.log1p(negated), math.log1p(reported), math.log1p(targeted), best, math.log1p(threats), math.log1p(n), total / (5.0 + len(text) / 100.0), math.log1p(indirect), math.log1p(repeated)]


@dataclass(frozen=True)
class ToxicityModel:
    arcs: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _arc_counts(sample: DataFrame, wanted: dict[str, None] | None = None) -> DataFrame:
    """(arc, fold, y, n): the documents that have each arc; those not in ``wanted`` are left out."""
    schema = "arc string, fold int, y int, n long"
    types = arrow_types(schema)

    def run(batches):
        seen: dict[tuple[int, int], Counter] = {}
        for b in short(batches):
            for t, f, y in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), b.column("y").to_pylist(), strict=True):
                own = {s for w in set(_WORD.findall((t or "").lower())) if w not in GIVEN for s in stems(w)}
                seen.setdefault((f, y), Counter()).update(own if wanted is None else own & wanted.keys())
        for (f, y), c in seen.items():
            keys = list(c)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield record({"arc": part, "fold": [f] * len(part), "y": [y] * len(part), "n": [c[k] for k in part]}, types)

    return sample.select("text", "fold", "y").mapInArrow(run, schema).groupBy("arc", "fold", "y").agg(F.sum("n").alias("n"))


def _weights(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios of document shares, and the likelihood-ratio statistic that tells them from chance."""
    p, q = (pos + 0.5) / (n_pos + 1), (neg + 0.5) / (n_neg + 1)
    base = n_pos / max(n_pos + n_neg, 1)
    t = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(pos > 0, pos * np.log(pos / (t * base)), 0) + np.where(neg > 0, neg * np.log(neg / (t * (1 - base))), 0))
    return np.log(p / q), g


def _chosen(rows, n_pos: int, n_neg: int, most: int) -> dict[str, float]:
    """Arcs that toxic documents have far more often than chance, heaviest evidence first, beside the given ones."""
    out = {w + " ": SEED_WEIGHT for w in SEEDS.split()}
    if n_pos and n_neg and len(rows):
        w, g = _weights(rows["pos"].to_numpy(float), rows["neg"].to_numpy(float), n_pos, n_neg)
        good = np.flatnonzero((w > 1.5) & (g > 16))
        good = good[np.lexsort((rows["arc"].to_numpy()[good], -g[good]))][:most]
        for i in good:
            out[rows["arc"].iloc[i]] = float(min(w[i], 6.0))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _feature_rows(sample: DataFrame, arcs: list[dict[str, float]]) -> DataFrame:
    """(doc_id, y, x): features under the arcs learned without the document's own fold."""
    schema = "doc_id long, y int, x array<double>"
    types = arrow_types(schema)

    def run(batches):
        g = [Grammar(a) for a in arcs]
        for b in short(batches):
            x = [g[f].features(t) for t, f in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)]
            yield record({"doc_id": b.column("doc_id"), "y": b.column("y"), "x": x}, types)

    return sample.select("doc_id", "text", "fold", "y").mapInArrow(run, schema)


def fit(docs: DataFrame, marks: DataFrame, usable: Column, rows: int = SAMPLE_ROWS, most_arcs: int = MOST_ARCS) -> ToxicityModel:
    """Learn arcs and the logistic fit from at most ``rows`` labelled documents for which ``usable`` (of doc_id) holds.

    Arcs are counted in two folds; each document's features for the fit come from arcs that did not see it.
    """
    sample = labelled_sample(docs, marks.where(usable), "toxic", rows).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")).persist()
    try:
        size = {(r["fold"], r["y"]): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
        found = _arc_counts(sample.where("y = 1")).groupBy("arc").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "arc").limit(20 * most_arcs)
        wanted = dict.fromkeys(r["arc"] for r in found.select("arc").toLocalIterator())
        table = _arc_counts(sample, wanted).toPandas() if wanted else None
        arcs = []
        for own in (0, 1, None):  # without fold 0, without fold 1, all
            n = [sum(v for (f, y), v in size.items() if y == k and f != own) for k in (0, 1)]
            if table is None:
                arcs.append(_chosen((), *n[::-1], most_arcs))
                continue
            part = table[table["fold"] != own] if own is not None else table
            wide = part.pivot_table(index="arc", columns="y", values="n", aggfunc="sum", fill_value=0).reindex(columns=[0, 1], fill_value=0).reset_index()
            wide.columns = ["arc", "neg", "pos"]
            arcs.append(_chosen(wide, n[1], n[0], most_arcs))
        got = _feature_rows(sample, arcs[:2]).orderBy("doc_id").toPandas()
    finally:
        sample.unpersist()
    x = np.array(got["x"].tolist(), float).reshape(-1, N_FEATURES)
    y = got["y"].to_numpy(float)
    if not len(x) or y.min() == y.max():
        mean, scale, w = np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([0, 0, 0, 0, 1.0, 1.0, 0, 0, 0, 0, -2.0])
    else:
        mean, scale, w = _logistic(x, y)
    return ToxicityModel(arcs[2], mean, scale, w)


SCORES = "doc_id long, score double, n_clauses int"


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, n_clauses) for each row. Null and empty texts have no clauses and get the score of none.

    Null ids stay null; repeated rows and ties get equal scores; an empty table gives an empty one; other columns are not read.
    """
    types = arrow_types(SCORES)

    def run(batches):
        g = Grammar(model.arcs)
        for b in short(batches):
            if b.num_rows:
                x = np.array([g.features(t) for t in b.column("text").to_pylist()])
                n = np.rint(np.expm1(x[:, 6])).astype(np.int32)
                yield record({"doc_id": b.column("doc_id"), "score": pa.array(model.score(x)), "n_clauses": pa.array(n)}, types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)
