"""Engines' budgets in hours: what each is to make, what is left, and which clips a budget still takes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.config import GenerationConfig
from turnloom.functions.keyed import uniform, weighted

SECONDS_PER_HOUR = 3600.0


def resolve_budgets(engines: DataFrame, overrides: DataFrame, default_hours: float) -> DataFrame:
    """(name, target_hours): the override or the default; targets of zero or less leave an engine out."""
    o = overrides.select(F.col("name"), F.col("hours"))
    return engines.join(F.broadcast(o), "name", "left").select("name", F.coalesce("hours", F.lit(float(default_hours))).alias("target_hours")).where("target_hours > 0")


def budgets(spark: SparkSession, names: list[str], config: GenerationConfig) -> DataFrame:
    over = spark.createDataFrame(list(config.hours_per_engine.items()), "name string, hours double")
    return resolve_budgets(spark.createDataFrame([(n,) for n in sorted(names)], "name string"), over, config.default_hours_per_engine)


def generated_hours(clips: DataFrame) -> DataFrame:
    """(name, hours) from (engine, duration_s)."""
    return clips.groupBy(F.col("engine").alias("name")).agg((F.sum("duration_s") / SECONDS_PER_HOUR).alias("hours"))


def remaining(targets: DataFrame, state: DataFrame) -> DataFrame:
    """(name, target_hours, hours, remaining_hours): what is left, never below zero."""
    return targets.join(state, "name", "left").select("name", "target_hours", F.coalesce("hours", F.lit(0.0)).alias("hours"), F.greatest(F.lit(0.0), F.col("target_hours") - F.coalesce("hours", F.lit(0.0))).alias("remaining_hours"))


def is_complete(targets: DataFrame, state: DataFrame) -> DataFrame:
    return remaining(targets, state).agg(F.coalesce(F.bool_and(F.col("hours") >= F.col("target_hours")), F.lit(True)).alias("complete"))


def pick_engine(targets: DataFrame, state: DataFrame, seed: int = 0, draw: str = "0") -> DataFrame:
    """(name) of one engine drawn by its configured target among those with hours left; no row if none has."""
    left = remaining(targets, state).where("remaining_hours > 0")
    total = F.sum("target_hours").over(Window.partitionBy())
    upto = F.sum("target_hours").over(Window.orderBy("name"))
    u = uniform(seed, F.lit(draw))
    return left.select("name", total.alias("all"), upto.alias("upto")).where(F.col("upto") > u * F.col("all")).orderBy("upto").limit(1).select("name")


def assign_engines(clips: DataFrame, weights: Mapping[str, float], seed: int = 0) -> DataFrame:
    """``clips`` with an engine each, drawn by weight and keyed by clip and order."""
    return clips.withColumn("engine", weighted(uniform(seed, F.col("clip_id"), F.col("ord"), F.lit("engine")), weights))


def within_budget(clips: DataFrame, targets: DataFrame, state: DataFrame | None = None, order: str = "clip_id", stretch: Column | None = None) -> DataFrame:
    """The clips that a run makes: those before which their engine's hours, earlier runs' included, are below its target.

    So each engine goes over its target by less than a clip. Engines are few and their clips many: hours are summed over stretches of
    the order first, so that no window runs over all clips of an engine. ``stretch`` has to follow the order; it is by default the
    first seven characters of its text.
    """
    rows = clips.withColumn("_stretch", F.substring(F.col(order).cast("string"), 1, 7) if stretch is None else stretch)
    by = Window.partitionBy("engine").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("engine", "_stretch").agg(F.sum("duration_s").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(by), F.lit(0.0))).drop("_s")
    inside = F.coalesce(F.sum("duration_s").over(Window.partitionBy("engine", "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_inside", inside).join(sums, ["engine", "_stretch"]).withColumn("before_hours", (F.col("_base") + F.col("_inside")) / SECONDS_PER_HOUR)
    done = F.lit(0.0)
    if state is not None:
        rows = rows.join(F.broadcast(state.select(F.col("name").alias("engine"), F.col("hours").alias("_done"))), "engine", "left")
        done = F.coalesce("_done", F.lit(0.0))
    rows = rows.join(F.broadcast(targets.withColumnRenamed("name", "engine")), "engine")
    return rows.where(done + F.col("before_hours") < F.col("target_hours")).select(*clips.columns, (done + F.col("before_hours")).alias("before_hours"))
