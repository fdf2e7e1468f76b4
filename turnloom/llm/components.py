"""Connected components by minimum labels and pointer jumping, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b), the component being its lowest node.

    In each round a node takes the lowest label among itself and its neighbours, then its label's label. Labels only fall, and the
    rounds end when none does; jumping makes their number grow with the logarithm of a path's length.
    """
    scratch = Scratch(edges.sparkSession)
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    path = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component"), F.lit(1).alias("moved")))
    read = edges.sparkSession.read.schema("node long, component long, moved int").parquet
    while True:
        now = read(path).drop("moved")
        heard = both.join(now, both["b"] == now["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        low = now.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("low"))
        jump = now.select(F.col("node").alias("low"), F.col("component").alias("next"))
        new = low.join(jump, "low").select("node", F.least("low", "next").alias("component"), (F.least("low", "next") < F.col("old")).cast("int").alias("moved"))
        after = scratch.write(new)
        scratch.drop(path)
        path = after
        if not read(path).where("moved = 1").limit(1).count():
            return read(path).drop("moved")
