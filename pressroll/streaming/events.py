"""Streaming forms of the interaction-event operators.

* usage counts: tumbling event-time windows with a watermark;
* debounce: session windows whose gap is the debounce gap minus one
  microsecond (a session window merges an event arriving exactly ``gap``
  after the last one; the debounce timer has fired by then), keeping the
  last input of each session when the box is not empty.

Hold detection is in ``holds``.

Windows, sessions and timers are emitted once the watermark passes them (append
mode), so state is dropped as time goes on. Where an input ends, a closing event
well after its last one moves the watermark past everything before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _minus_one_micro(gap: str) -> str:
    n, unit = gap.split()
    micros = {"milliseconds": 1000, "millisecond": 1000, "seconds": 1_000_000, "second": 1_000_000,
              "minutes": 60_000_000, "minute": 60_000_000, "hours": 3_600_000_000, "hour": 3_600_000_000}[unit]
    return f"{int(n) * micros - 1} microseconds"


def gap_micros(gap: str) -> int:
    return int(_minus_one_micro(gap).split()[0]) + 1


def usage_stream(events: DataFrame, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Events and distinct users per window and name: counted per user first,
    then per window, so the number of users is exact (append mode)."""
    per_user = (events.withWatermark("ts", watermark)
                      .groupBy(F.window("ts", window).alias("w"), "name", "user")
                      .agg(F.count(F.lit(1)).alias("n")))
    return (per_user.groupBy(F.window(F.window_time("w"), window).alias("w"), "name")
                    .agg(F.sum("n").alias("n_events"), F.count("user").alias("n_users"))
                    .select(F.col("w.start").alias("window_start"), "name", "n_events", "n_users"))


def debounce_stream(inputs: DataFrame, gap: str, watermark: str = "1 hour",
                    length_col: str = "chars") -> DataFrame:
    last = F.max_by(F.struct("seq", length_col, "ts"), F.struct("ts", "seq"))
    return (inputs.withWatermark("ts", watermark)
                  .groupBy("user", F.session_window("ts", _minus_one_micro(gap)).alias("s"))
                  .agg(last.alias("last"))
                  .where(F.col(f"last.{length_col}") > 0)
                  .select("user", F.col("last.seq").alias("seq"), F.col(f"last.{length_col}").alias(length_col),
                          (F.col("last.ts") + F.expr(f"INTERVAL {gap}")).alias("fire_ts")))
