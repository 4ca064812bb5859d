"""Press-and-hold detection as a stream that a hot user does not hold up.

A user's events are cut into time slices. A slice is grouped by user *and* slice
(so the slices of one user are spread over the tasks), and says two things:

* which holds start and end inside it whatever came before, as output rows;
* what it does to a hold that is open at its start, as one summary row: when
  its first event comes (does a press armed before fire?), which cancel comes
  first (does an active hold end there?), and what it leaves behind (an armed
  press, an active hold).

The summaries of a user are folded in order of time by a small state (armed
press, active hold); an armed press that nothing follows fires by a timer. What
passes through one user's task is a row a slice, not a row an event.

Two queries: the first one writes the slices with a file sink, whose log shows
an epoch as a whole; the second one folds their summaries. :func:`detected` is
the union of both results, equal to the batch form once the feed is closed.

Edge cases: events of equal time are ordered by ``seq`` (a press before a
cancel); a null user is a user; events later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from pressroll.streaming.days import ROCKSDB
from pressroll.streaming.events import gap_micros

SLICES = ("user string, slice_end timestamp, first_us long, cancel_us long, cancel_seq long, cancel_known boolean, "
          "fires_last boolean, press_us long, press_seq long, outputs array<struct<seq:bigint,kind:string,at_us:bigint>>")
_OUTPUTS = pa.list_(pa.struct([("seq", pa.int64()), ("kind", pa.string()), ("at_us", pa.int64())]))
OUT = "user string, seq long, kind string, at_us long"


def _summary_task(delay_us: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events = batch.column("events")
            first, flat = events.offsets.to_numpy(), events.flatten()
            if not len(flat):
                continue
            first = first - first[0]
            begin, last = first[:-1], first[1:] - 1  # a slice has an event at least
            row = np.repeat(np.arange(len(begin)), np.diff(first))
            us, seq = flat.field("us").to_numpy(), flat.field("seq").to_numpy()
            cancel = flat.field("is_cancel").to_numpy(zero_copy_only=False).astype(bool)
            at = np.arange(len(us))
            follows = np.append(us[1:] - us[:-1] >= delay_us, False)
            follows[last] = False  # what follows the last event is not known here
            fired = ~cancel & follows
            # The last cancel and the last fired press before each event, in its slice.
            def before(which: np.ndarray) -> np.ndarray:
                seen = np.append(-1, np.maximum.accumulate(np.where(which, at, -1))[:-1])
                return np.where(seen >= begin[row], seen, -1)

            last_fired, last_cancel = before(fired), before(cancel)
            ends = cancel & (last_fired > last_cancel)
            marked = np.flatnonzero(fired | ends)
            starts = fired[marked]
            outputs = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(marked, first).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(seq[marked]), pa.array(np.where(starts, "start", "end").astype(object), pa.string()),
                                            pa.array(us[marked] + np.where(starts, delay_us, 0))], ["seq", "kind", "at_us"]))
            cancels = np.flatnonzero(cancel)
            found = np.searchsorted(cancels, begin)
            has = found < len(cancels)
            one = cancels[np.minimum(found, len(cancels) - 1)] if len(cancels) else np.zeros(len(begin), np.int64)
            has &= one <= last
            # As seen after the last event of the slice.
            end_fired, end_cancel = (np.where(w[last], last, b[last]) for w, b in ((fired, last_fired), (cancel, last_cancel)))
            press = ~cancel[last]
            yield pa.RecordBatch.from_arrays(
                [batch.column("user"), batch.column("slice_end"), pa.array(us[begin]), pa.array(us[one], mask=~has), pa.array(seq[one], mask=~has),
                 pa.array(has & (last_fired[one] >= 0)), pa.array(end_fired > end_cancel), pa.array(us[last], mask=~press),
                 pa.array(seq[last], mask=~press), outputs.cast(_OUTPUTS)],
                ["user", "slice_end", "first_us", "cancel_us", "cancel_seq", "cancel_known", "fires_last", "press_us", "press_seq", "outputs"])

    return summarise


def hold_slices(presses: DataFrame, delay: str, width: str, watermark: str = "1 hour") -> DataFrame:
    """A row per user and slice of ``width`` (append mode): its own outputs and
    its summary. ``presses`` has user, seq, ts and is_cancel."""
    event = F.struct(F.unix_micros("ts").alias("us"), "seq", "is_cancel")
    cut = (presses.withWatermark("ts", watermark).groupBy("user", F.window("ts", width).alias("w"))
                  .agg(F.array_sort(F.collect_list(event)).alias("events"))
                  .select("user", F.col("w.end").alias("slice_end"), "events"))
    return cut.mapInArrow(_summary_task(gap_micros(delay)), SLICES)


class Fold(StatefulProcessor):
    """Folds a user's slices in order of time: an armed press, an active hold."""

    def __init__(self, delay_us: int) -> None:
        self.delay = delay_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hold", "press_us long, press_seq long, active boolean")

    def handleInputRows(self, key, rows, timerValues):
        us, seq, active = self.state.get() if self.state.exists() else (None, None, False)
        user = key[0]
        for s in sorted(rows, key=lambda r: r["slice_end"]):
            if s["first_us"] is None:
                continue
            if us is not None and s["first_us"] >= us + self.delay:
                yield Row(user=user, seq=seq, kind="start", at_us=us + self.delay)
                active = True
            if s["cancel_us"] is not None:
                if active and not s["cancel_known"]:
                    yield Row(user=user, seq=s["cancel_seq"], kind="end", at_us=s["cancel_us"])
                active = s["fires_last"]
            else:
                active = active or s["fires_last"]
            us, seq = s["press_us"], s["press_seq"]
        self.state.update((us, seq, active))
        if us is not None:
            self.handle.registerTimer(-(-(us + self.delay) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        us, seq, _ = self.state.get()
        if us is not None and us + self.delay <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.state.update((None, None, True))
            yield Row(user=key[0], seq=seq, kind="start", at_us=us + self.delay)

    def close(self) -> None:
        pass


def hold_edges(slices: DataFrame, delay: str) -> DataFrame:
    """Starts and ends that depend on more than one slice (append mode)."""
    narrow = slices.drop("outputs").withWatermark("slice_end", "0 seconds")
    return narrow.groupBy("user").transformWithState(Fold(gap_micros(delay)), OUT, "Append", "EventTime")


def start_slices(presses: DataFrame, folder: str, delay: str, width: str, watermark: str = "1 hour") -> StreamingQuery:
    writer = hold_slices(presses, delay, width, watermark).writeStream.format("parquet").outputMode("append")
    return writer.option("path", f"{folder}/slices").option("checkpointLocation", f"{folder}/slices-checkpoint").trigger(availableNow=True).start()


def close_feed(spark: SparkSession, folder: str) -> None:
    """A slice of nothing at the end of time: presses still armed fire."""
    row = spark.sql("SELECT cast(null AS string) AS user, timestamp'9999-12-31 00:00:00' AS slice_end")
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/closing")


def start_edges(spark: SparkSession, folder: str, delay: str) -> StreamingQuery:
    # A folder without files has no schema to read; the closing slice may come later.
    spark.createDataFrame([], "user string, slice_end timestamp").write.mode("append").parquet(f"{folder}/closing")
    reader = spark.readStream.schema(SLICES)
    slices = reader.parquet(f"{folder}/slices").unionByName(reader.parquet(f"{folder}/closing"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        writer = hold_edges(slices, delay).writeStream.format("parquet").outputMode("append")
        return writer.option("path", f"{folder}/edges").option("checkpointLocation", f"{folder}/edges-checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def detected(spark: SparkSession, folder: str) -> DataFrame:
    """All starts and ends found so far: user, seq, kind, at."""
    inside = spark.read.schema(SLICES).parquet(f"{folder}/slices").select("user", F.explode("outputs").alias("o")).select("user", "o.*")
    edges = spark.read.schema(OUT).parquet(f"{folder}/edges")
    return inside.unionByName(edges).select("user", "seq", "kind", F.timestamp_micros("at_us").alias("at"))
