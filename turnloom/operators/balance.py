"""Planned speaker counts by weights, and how a batch's shares compare with them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.config import BalancingConfig
from turnloom.functions.keyed import capped, positive, uniform, weighted, weighted_up_to


def plan_clip_counts(spark: SparkSession, clips: int, config: BalancingConfig | None = None, seed: int = 0) -> DataFrame:
    """(clip_id, total, max_simultaneous): two draws for each clip, the second among the counts up to the first. No exchange."""
    c = config or BalancingConfig()
    ids = spark.range(clips).select(F.format_string("clip%06d", "id").alias("clip_id"))
    return with_counts(ids, c, seed)


def with_counts(clips: DataFrame, c: BalancingConfig, seed: int = 0) -> DataFrame:
    total = weighted(uniform(seed, F.col("clip_id"), F.lit("total")), c.total_weights).cast("int")
    most = weighted_up_to(uniform(seed, F.col("clip_id"), F.lit("simultaneous")), c.simultaneous_weights, F.col("total")).cast("int")
    return clips.withColumn("total", total).withColumn("max_simultaneous", most)


def run_balance(config: BalancingConfig, ceiling: int, capacity: int | None) -> BalancingConfig:
    """The weights a run can meet: simultaneous speakers up to its ceiling, speakers in all up to the voices there are."""
    total = dict(config.total_weights) if capacity is None else capped(config.total_weights, capacity)
    return BalancingConfig(total, capped(config.simultaneous_weights, ceiling))


def proportions(counts: DataFrame, column: str) -> DataFrame:
    """(count, realized): each value's share of the rows."""
    by = counts.groupBy(F.col(column).cast("int").alias("count")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("all"))
    return by.crossJoin(F.broadcast(total)).select("count", (F.col("n") / F.col("all")).alias("realized"))


def targets(spark: SparkSession, weights: Mapping[int, float]) -> DataFrame:
    """(count, target): weights by their sum; zero weights stay as 0."""
    positive(weights)
    total = float(sum(weights.values()))
    return spark.createDataFrame([(int(k), float(w) / total) for k, w in weights.items()], "count int, target double")


def realized_vs_target(counts: DataFrame, config: BalancingConfig | None = None) -> DataFrame:
    """(dimension, count, target, realized) for both counts; a share that one side lacks is 0."""
    c = config or BalancingConfig()
    out = None
    for dimension, column, weights in (("total", "total", c.total_weights), ("simultaneous", "max_simultaneous", c.simultaneous_weights)):
        part = targets(counts.sparkSession, weights).join(proportions(counts, column), "count", "full_outer").na.fill(0.0, ["target", "realized"]).select(F.lit(dimension).alias("dimension"), "count", "target", "realized")
        out = part if out is None else out.union(part)
    return out
