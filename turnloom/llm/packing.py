"""Packing into optimal length buckets.

The histogram of all lengths, rounded up to the alignment, goes to the driver: its rows are bounded by the longest document, not by their
number. Dynamic programming over it chooses the bucket bounds with the least padding in total. Inside a bucket every document is
padded to the bucket's bound, and batches take as many documents as the token budget allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import Scratch

BUCKETS, TOKEN_BUDGET, ALIGN = 12, 16_384, 8
#: Documents numbered together, and parts whose sizes are summed together; buckets are dealt into parts of about so many.
PART = 4_096


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, ascending, of at most ``buckets`` ranges of the lengths (distinct, ascending) with the least total padding.

    The best last bucket of a prefix never moves left as the prefix grows, so each layer is solved by halving.
    """
    n = len(lengths)
    if n <= buckets:
        return [int(x) for x in lengths]
    size = np.concatenate([[0], np.cumsum(counts.astype(np.float64))])
    mass = np.concatenate([[0], np.cumsum(counts.astype(np.float64) * lengths)])

    def cost(i, j):  # lengths i..j-1 in one bucket
        return lengths[j - 1] * (size[j] - size[i]) - (mass[j] - mass[i])

    best = np.array([0.0] + [cost(0, j) for j in range(1, n + 1)])
    cuts: list[np.ndarray] = []
    for _ in range(buckets - 1):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            c = best[i] + cost(i, mid)
            k = int(c.argmin())
            new[mid], cut[mid] = c[k], i[k]
            todo += [(lo, mid - 1, a, int(i[k])), (mid + 1, hi, int(i[k]), b)]
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    if j:
        out.append(int(lengths[j - 1]))
    return sorted(out)


def word_tokens(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def packed(docs: DataFrame, tokens: Column | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, align: int = ALIGN) -> DataFrame:
    """doc_id, n_tokens, bucket, padded, batch, slot: a row for each row of ``docs``.

    ``padded`` is the bucket's bound, a multiple of ``align``; ``batch`` numbers the batches of a bucket and ``slot`` the documents of a batch,
    which together are padded to at most ``budget`` tokens (a document over the budget is a batch of its own). Null and empty texts
    have no tokens and fill no budget worth counting; null ids, repeated rows and ties are packed like others. An empty table gives an
    empty one; other columns are not read.
    """
    n = word_tokens() if tokens is None else tokens
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)  # so that rows without an id do not meet in one part
    # texts are measured once; everything after works on two numbers a row
    rows = Scratch(docs.sparkSession).keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_tokens"), salt.alias("salt"))).withColumn("length", (F.ceil(F.col("n_tokens") / align) * align).cast("long"))
    hist = rows.groupBy("length").count().toPandas().sort_values("length")
    bounds = bucket_bounds(hist["length"].to_numpy(np.int64), hist["count"].to_numpy(np.int64), buckets) or [align]
    parts = max(1, int(hist["count"].sum()) // PART)
    array = F.array(*[F.lit(x).cast("long") for x in bounds])
    rows = rows.withColumn("bucket", F.size(F.filter(array, lambda x: x < F.col("length")))).withColumn("padded", F.element_at(array, F.col("bucket") + 1)).withColumn("part", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(parts)))

    def before(counts: DataFrame, order: str, *within: str) -> DataFrame:
        """(within, order, before): what the rows before have, in all."""
        earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))

    sizes = rows.groupBy("bucket", "part").count().withColumn("group", F.floor(F.col("part") / PART))
    groups = before(sizes.groupBy("bucket", "group").agg(F.sum("count").alias("count")), "group", "bucket").select("bucket", "group", F.col("before").alias("base"))
    offsets = before(sizes, "part", "bucket", "group").join(groups, ["bucket", "group"]).select("bucket", "part", (F.col("before") + F.col("base")).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "n_tokens"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("padded")))).cast("long")
    numbered = rows.withColumn("number", own).join(offsets, ["bucket", "part"]).withColumn("number", F.col("number") + F.col("before") - 1)
    return numbered.select("doc_id", "n_tokens", "bucket", "padded", F.floor(F.col("number") / room).alias("batch"), (F.col("number") % room).alias("slot"))
