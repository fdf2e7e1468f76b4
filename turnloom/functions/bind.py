"""Naming a value inside an expression, so that it is computed once where a lambda uses it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def let_all(use: Callable[[Column], Column], **values: Column) -> Column:
    """The same for several values, as fields of one struct."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), use)
