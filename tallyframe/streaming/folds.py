"""Structured Streaming forms of the event-log operators. An extra: the batch forms are the reference."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_scores(log: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """Points by game and team so far; a state is dropped after an hour of silence.

    ``log``: game_id, ts, team_id, points. Output (append): a row for each game and team of a micro-batch.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        points, n = state.get if state.exists else (0, 0)
        for b in batches:
            points += int(b["points"].sum())
            n += len(b)
        state.update((points, n))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"game_id": [key[0]], "team_id": [key[1]], "points": [points], "events": [n]})

    return log.withWatermark("ts", delay).groupBy("game_id", "team_id").applyInPandasWithState(update, "game_id string, team_id long, points long, events long", "points long, events long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, *, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and their value by type in tumbling windows, late ones up to ``delay``."""
    w = F.window("ts", window)
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
