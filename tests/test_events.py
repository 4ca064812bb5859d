"""Event contract, debounce and hold detection (batch and streaming forms)."""

import datetime as dt
import random
import re

import pytest

from pressroll.operators import events as Ev
from pressroll.session import work_dir
from pressroll.streaming import events as Se
from pressroll.streaming import holds as Sh

T0 = dt.datetime(2026, 8, 15, 12, 0, 0)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def inputs(spark, seq_ms_chars, user="u"):
    rows = [(user, i, at(ms), c) for i, (ms, c) in enumerate(seq_ms_chars)]
    return spark.createDataFrame(rows, "user string, seq long, ts timestamp, chars long")


def fired(df):
    return sorted((r["seq"], r["chars"]) for r in df.collect())


def test_debounce_one_event_after_pause(spark):
    assert fired(Ev.debounce(inputs(spark, [(0, 1), (300, 2), (600, 3)]))) == [(2, 3)]


def test_debounce_emptied_box_sends_nothing(spark):
    assert fired(Ev.debounce(inputs(spark, [(0, 4), (200, 0)]))) == []


def test_debounce_gap_boundary(spark):
    # next input exactly 800 ms later: the timer fired first
    assert fired(Ev.debounce(inputs(spark, [(0, 1), (800, 2), (1599, 3)]))) == [(0, 1), (2, 3)]


def presses(spark, seq_ms_cancel, user="u"):
    rows = [(user, i, at(ms), c) for i, (ms, c) in enumerate(seq_ms_cancel)]
    return spark.createDataFrame(rows, "user string, seq long, ts timestamp, is_cancel boolean")


def holds(df):
    return sorted((r["kind"], r["seq"]) for r in df.collect())


def test_hold_start_then_cancels(spark):
    out = Ev.hold(presses(spark, [(0, False), (600, True), (700, True)]))
    assert holds(out) == [("end", 1), ("start", 0)]


def test_hold_early_cancel(spark):
    assert holds(Ev.hold(presses(spark, [(0, False), (200, True)]))) == []


def test_hold_restart_rearms(spark):
    out = Ev.hold(presses(spark, [(0, False), (300, False), (1000, True)]))
    assert holds(out) == [("end", 2), ("start", 1)]


def test_hold_stays_active_across_restart(spark):
    out = Ev.hold(presses(spark, [(0, False), (600, False), (700, True)]))
    assert holds(out) == [("end", 2), ("start", 0)]


def test_hold_input_ending_while_held(spark):
    assert holds(Ev.hold(presses(spark, [(0, False)]))) == [("start", 0)]


def test_contract(spark):
    df = spark.createDataFrame(
        [("u", 1, "nav_tab", {"page": "x"}), ("u", 2, "nav_tab", None), ("u", 3, "bogus", {"a": "1"}),
         ("u", 4, "archive_search", {"chars": "3", "x": "1", "y": "2"}), ("u", 5, "lang_toggle", {"page": "x"})],
        "user string, seq long, name string, data map<string,string>")
    got = {r["seq"]: r["reasons"] for r in Ev.contract_violations(df).collect()}
    assert got == {3: "unknown_name", 4: "unknown_key,too_many_keys", 5: "unknown_key"}


def run_stream(spark, df, build, mode):
    src = work_dir(spark, "t-src")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out, ck = work_dir(spark, "t-out"), work_dir(spark, "t-ck")

    def write(b, e):
        b.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    q = build(stream).writeStream.outputMode(mode).foreachBatch(write) \
        .option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def test_debounce_stream_equals_batch(spark):
    df = inputs(spark, [(0, 1), (799, 2), (1599, 3), (2398, 4), (9000, 5), (9500, 0)])
    batch = fired(Ev.debounce(df))
    stream = fired(run_stream(spark, df, lambda s: Se.debounce_stream(s, Ev.DEBOUNCE), "complete"))
    assert stream == batch == [(1, 2), (3, 4)]


def hold_stream(spark, df, width, max_files=None):
    """Both queries over one file per task of ``df`` and a closing event."""
    src, folder = work_dir(spark, "t-src"), work_dir(spark, "t-hold")
    closing = spark.createDataFrame([("closing", -1, at(10**10), True)], "user string, seq long, ts timestamp, is_cancel boolean")
    df.unionByName(closing).write.parquet(src)
    reader = spark.readStream.schema(df.schema)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    Sh.start_slices(reader.parquet(src), folder, Ev.HOLD_DELAY, width, "1 day").awaitTermination()
    Sh.close_feed(spark, folder)
    Sh.start_edges(spark, folder, Ev.HOLD_DELAY).awaitTermination()
    return Sh.detected(spark, folder)


def full(df):
    return sorted((r["user"], r["seq"], r["kind"], r["at"]) for r in df.collect())


@pytest.mark.parametrize("width", ["1 second", "1 minute"])
def test_hold_stream_equals_batch_when_closed(spark, width):
    seq = [(0, False), (600, True), (700, True), (1000, False), (1200, False), (1300, True), (5000, False),
           (60_000, True), (60_400, False), (60_900, False), (200_000, False)]
    df = presses(spark, seq)
    batch = full(Ev.hold(df))
    assert full(hold_stream(spark, df, width)) == batch and len(batch) == 7


def test_hold_stream_of_a_hot_user(spark):
    """Random events, half of them of one user: every slice boundary case comes up."""
    rng = random.Random(3)
    rows, ms = [], 0
    for i in range(3000):
        ms += rng.choice([0, 1, 100, 499, 500, 501, 900])
        rows.append(("hot" if i % 2 else f"u{rng.randrange(5)}", i, at(ms), rng.random() < 0.4))
    df = spark.createDataFrame(rows, "user string, seq long, ts timestamp, is_cancel boolean").repartition(3)
    batch = full(Ev.hold(df))
    assert full(hold_stream(spark, df, "2 seconds", max_files=1)) == batch and len(batch) > 500


def test_slices_of_a_hot_user_are_spread(spark):
    """The grouping of events is by user and slice, and what the fold gets of a
    user is a row a slice."""
    df = spark.range(5000).selectExpr("concat('hot', id * 0) AS user", "id AS seq", "timestamp_millis(id * 300) AS ts", "id % 3 = 0 AS is_cancel")
    slices = Sh.hold_slices(df, Ev.HOLD_DELAY, "1 minute")
    assert slices.count() == 25
    p = slices._jdf.queryExecution().executedPlan().toString()
    keys = re.search(r"hashpartitioning\(([^)]*)\)", p)[1].split(", ")
    assert len(keys) >= 2 and len({k.split("#")[0] for k in keys if "#" in k}) == 2


def test_usage_stream_equals_batch(spark):
    rows = [("u1", 1, at(0), "nav_tab", {"page": "a"}), ("u2", 2, at(1000), "nav_tab", None),
            ("u1", 3, at(86_400_000 + 5), "lang_toggle", {"lang": "ko"}), ("u1", 4, at(2000), "nav_tab", None)]
    df = spark.createDataFrame(rows, "user string, seq long, ts timestamp, name string, data map<string,string>")
    got = lambda u: sorted((r["window_start"], r["name"], r["n_events"], r["n_users"]) for r in u.collect())
    closing = spark.createDataFrame([(None, 9, at(20 * 86_400_000), "nav_tab", None)], df.schema)
    stream = got(run_stream(spark, df.union(closing), lambda s: Se.usage_stream(s), "append"))
    assert stream == got(Ev.usage(df))
    assert ("nav_tab", 3, 2) in {r[1:] for r in stream}
