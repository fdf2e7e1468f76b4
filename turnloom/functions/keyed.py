"""Draws that depend on keys alone, never on the order of calls: the first 60 bits of a SHA-256."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 15


def fraction(text: Column) -> Column:
    """A number in [0, 1) for a text."""
    return F.conv(F.substring(F.sha2(text, 256), 1, DIGITS), 16, 10).cast("long").cast("double") / float(16**DIGITS)


def uniform(seed: int, *keys: Column) -> Column:
    return fraction(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def positive(weights: Mapping) -> dict:
    """The weights above zero; ValueError if there is none."""
    out = {k: float(w) for k, w in weights.items() if w > 0}
    if not out:
        raise ValueError("no positive weight")
    return out


def weighted(u: Column, weights: Mapping) -> Column:
    """The key that a uniform draw falls on, keys in their given order; zero weights are never drawn."""
    own = positive(weights)
    total, seen, out = sum(own.values()), 0.0, None
    keys = list(own)
    for k in keys[:-1]:
        seen += own[k]
        out = F.when(u < seen / total, F.lit(k)) if out is None else out.when(u < seen / total, F.lit(k))
    return out.otherwise(F.lit(keys[-1])) if out is not None else F.lit(keys[-1])


def capped(weights: Mapping[int, float], ceiling: int) -> dict[int, float]:
    """The weights of counts up to ``ceiling``; where none is left, {1: 1.0}."""
    return {k: w for k, w in weights.items() if k <= ceiling} or {1: 1.0}


def weighted_up_to(u: Column, weights: Mapping[int, float], ceiling: Column) -> Column:
    """A weighted draw among the counts up to a column's value; 1 if none of them has weight."""
    own = sorted(positive(weights).items())
    total = sum(F.when(ceiling >= k, F.lit(w)).otherwise(0.0) for k, w in own)
    seen, out = F.lit(0.0), None
    for k, w in own:
        seen = seen + F.when(ceiling >= k, F.lit(w)).otherwise(0.0)
        test = (ceiling >= k) & (u * total < seen)
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    last = F.lit(1)
    for k, _ in own:
        last = F.when(ceiling >= k, F.lit(k)).otherwise(last)
    return out.otherwise(last)
