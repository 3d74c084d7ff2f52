"""Monitoring a strategy's returns with a CUSUM of its rolling Sharpe ratio, in batch and as a stream.

For each return: the annualised ratio of the last 63 (the expected one until ten are there; population deviation), z = (ratio -
expected) * sqrt(max(n, 10)) with n of 63 at most, and S = max(0, S - z - drift). Levels are 3, 5 and 7; an alarm (7) resets S after
it is reported. Batch and stream run the same step, so they give the same rows.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW, LEAST = 63, 10
#: Levels of S. Fixed values.
WATCH, WARNING, ALARM = 3.0, 5.0, 7.0
OUT = "key string, ts timestamp, z_score double, statistic double, level string, message string"


def level_of(s: float) -> str:
    return "alarm" if s >= ALARM else "warning" if s >= WARNING else "watch" if s >= WATCH else "normal"


class Monitor:
    """The state of one key."""

    def __init__(self, expected: float, drift: float = 0.5, state: tuple | None = None):
        self.expected, self.drift = expected, drift
        self.s, self.n, self.level, self.held = (state[0], state[1], state[2], deque(state[3], WINDOW)) if state else (0.0, 0, "normal", deque(maxlen=WINDOW))

    def state(self) -> tuple:
        return self.s, self.n, self.level, list(self.held)

    def ratio(self) -> float:
        if len(self.held) < LEAST:
            return self.expected
        mean = sum(self.held) / len(self.held)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in self.held) / len(self.held))
        return mean / deviation * math.sqrt(252) if deviation > 1e-12 else 0.0

    def step(self, ret: float) -> tuple[float, float, str, str | None]:
        """z, S before any reset, level, and a message when the level changes."""
        self.held.append(ret)
        self.n += 1
        z = (self.ratio() - self.expected) * math.sqrt(max(min(self.n, WINDOW), LEAST))
        self.s = max(0.0, self.s - z - self.drift)
        shown, level = self.s, level_of(self.s)
        message = f"{self.level} -> {level}: S {shown:.2f}, z {z:.2f}" if level != self.level else None
        self.level = level
        if level == "alarm":
            self.s, self.n = 0.0, 0
        return z, shown, level, message


def _rows(key: str, monitor: Monitor, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("ts", kind="stable")
    made = [monitor.step(float(r)) for r in rows["ret"]]
    return pd.DataFrame({"key": key, "ts": rows["ts"].to_numpy(), "z_score": [m[0] for m in made], "statistic": [m[1] for m in made], "level": [m[2] for m in made], "message": [m[3] for m in made]})


def monitor(returns: DataFrame, expected: float, drift: float = 0.5) -> DataFrame:
    """All rows of (key, ts, ret) at once, each key from a clean state."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _rows(rows["key"].iloc[0], Monitor(expected, drift), rows)

    return returns.groupBy("key").applyInPandas(run, OUT)


def monitor_stream(returns: DataFrame, expected: float, drift: float = 0.5) -> DataFrame:
    """The same for a stream of (key, ts, ret) that brings each key's rows in order of time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get if state.exists else None
        own = Monitor(expected, drift, s)
        rows = pd.concat(list(batches))
        yield _rows(key[0], own, rows)
        state.update(own.state())

    return returns.groupBy("key").applyInPandasWithState(run, OUT, "s double, n long, level string, held array<double>", "append", GroupStateTimeout.NoTimeout)


def alerts(found: DataFrame) -> DataFrame:
    """Rows where the level changes, back to normal included."""
    before = F.lag("level", 1, "normal").over(Window.partitionBy("key").orderBy("ts"))
    return found.withColumn("_b", before).where(F.col("_b") != F.col("level")).drop("_b")


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Bars of a stream or table of (ts, event_type, event_id, value) by hour; rows later than the watermark are left out of a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    key = F.struct("ts", "event_id")
    bars = events.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
