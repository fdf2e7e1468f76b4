"""Statistics of one document, for quality rules and the quality classifier."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from turnloom.functions.arrow import short
from turnloom.llm.common import arrow_types, record, text_bytes

#: Counted as symbols.
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
CONTINUATION = bytes(range(0x80, 0xC0))

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "distinct_rate", "shout_rate", "line_rate", "longest_word", "stop_rate", "comma_rate", "pipe_rate", "top_rate", "log_words")
SCHEMA = ", ".join(["doc_id long", *(f"{x} long" for x in BASE), *(f"{x} double" for x in RATIOS)])


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur at least twice in the text."""
    if len(words) < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    at = np.fromiter((seen[g] > 1 for g in grams), bool, len(grams))
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(grams)] |= at
    return int(hit.sum())


def doc_stats(text: bytes) -> tuple:
    """BASE and RATIOS of one text; an empty text has zeros."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.translate(None, CONTINUATION))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    rep = repeat_words(words)
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    per, ch, ln = max(n, 1), max(chars, 1), max(len(lines), 1)
    distinct = len(set(words))
    top = max(Counter(words).values()) if 0 < distinct < 0.6 * n else 0
    return (
        n, chars, symbols, dup, rep,
        chars / per, symbols / per, dup / ln, rep / per,
        (len(joined) - len(joined.translate(None, UPPER))) / ch,
        (len(joined) - len(joined.translate(None, DIGITS))) / ch,
        distinct / per, joined.count(b"!") / per, len(lines) / per,
        float(max(map(len, words), default=0)), joined.count(b".") / per, joined.count(b",") / per, joined.count(b"|") / per,
        top / per, float(np.log1p(n)),
    )


def stats_table(docs: DataFrame, **extra: str) -> DataFrame:
    """One row of statistics per row of ``docs`` (doc_id, text), every whole text read once. ``extra`` names columns of ``docs`` that come along, with their types."""
    schema = ", ".join([SCHEMA, *(f"{k} {t}" for k, t in extra.items())])
    types = arrow_types(schema)

    def run(batches):
        for b in short(batches):
            cols = list(zip(*map(doc_stats, text_bytes(b)), strict=True))
            yield record({k: b.column(k) for k in ("doc_id", *extra)} | dict(zip((*BASE, *RATIOS), cols, strict=True)), types)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text", *extra).mapInArrow(run, schema)


def with_stats(docs: DataFrame, prefix: str) -> DataFrame:
    """All columns of ``docs`` and the statistics of its texts, their names after ``prefix``."""
    own = T.StructType([*(T.StructField(prefix + x, T.LongType()) for x in BASE), *(T.StructField(prefix + x, T.DoubleType()) for x in RATIOS)])
    types = [pa.int64() for _ in BASE] + [pa.float64() for _ in RATIOS]

    def run(batches):
        for b in short(batches):
            if b.num_rows:
                cols = zip(*map(doc_stats, text_bytes(b)), strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*b.schema.names, *(f.name for f in own)])

    return docs.mapInArrow(run, T.StructType([*docs.schema, *own]))


def labelled_sample(docs: DataFrame, marks: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y): at most ``rows`` labelled documents, those whose ids hash lowest. Ids are bounded by ``rows``, so they are broadcast.

    Where an id has several labels, the highest counts; labels other than 0 and 1, and rows without an id, are left out.
    """
    from pyspark.sql import functions as F

    ids = marks.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


__all__ = ["BASE", "RATIOS", "SCHEMA", "doc_stats", "labelled_sample", "repeat_words", "stats_table"]
