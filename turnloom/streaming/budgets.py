"""Extension: budgets and turns over streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADMITTED = "engine string, clip_id string, duration_s double, before_hours double"


def admitted(clips: DataFrame, targets: dict[str, float]) -> DataFrame:
    """From a stream (engine, clip_id, duration_s): the clips that come while their engine's hours are below its target.

    The seconds made are the state, one number an engine, and live in the query's checkpoint: a run that is started again goes on from there.
    Clips of a batch are taken in the order of their ids.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made = state.get[0] if state.exists else 0.0
        target = 3600.0 * targets.get(key[0], 0.0)
        for f in frames:
            rows = []
            for clip, seconds in f.sort_values("clip_id")[["clip_id", "duration_s"]].itertuples(index=False):
                if made < target:
                    rows.append((key[0], clip, seconds, made / 3600.0))
                    made += seconds
            yield pd.DataFrame(rows, columns=["engine", "clip_id", "duration_s", "before_hours"])
        state.update((made,))

    return clips.select("engine", "clip_id", "duration_s").groupBy("engine").applyInPandasWithState(step, ADMITTED, "made double", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events (user_id, ts, value), closed by a gap; events later than the watermark are left out."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events", "value")


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by type and hour of their own time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")
