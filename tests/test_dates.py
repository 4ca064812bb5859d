"""Date parsing, newer-than, labels, weekday, wall clock, kickoff conversion."""

import pytest
from pyspark.sql import functions as F

from pressroll.functions import dates as D


def run(spark, fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("raw,iso", [
    ("October 9, 2031", "2031-10-09"),
    ("March 28, 1999", "1999-03-28"),
    ("Nov. 30, 2031", "2031-11-30"),
    ("Dec 2, 2031", "2031-12-02"),
    ("Sept 21, 2031", "2031-09-21"),
    ("Jun 7 2031", "2031-06-07"),
    ("\t May 19, 2031\n", "2031-05-19"),
    ("\u00a0jul 4,2031\u3000", "2031-07-04"),
    ("OCTOBER 9, 2031", "2031-10-09"),
    ("Apr 112031", "2031-04-11"),
    ("Jun 31, 2031", "2031-06-31"),
])
def test_parse_us_date_accepts(spark, raw, iso):
    assert run(spark, D.parse_us_date, [raw]) == [iso]


@pytest.mark.parametrize("raw", ["", None, "yesterday", "2031-10-09", "Octember 9, 2031",
                                 "October 9, 2031\nlate", "Oct 999, 2031"])
def test_parse_us_date_rejects(spark, raw):
    assert run(spark, D.parse_us_date, [raw]) == [None]


def test_newer_than(spark):
    df = spark.createDataFrame(
        [("2031-05-06", None), ("2031-05-06", ""), ("2031-05-06", "2031-05-06"),
         ("2031-05-05", "2031-05-06"), ("2031-06-01", "2031-05-31"), ("2032-01-01", "2031-12-31")],
        "d string, b string")
    got = [r[0] for r in df.select(D.newer_than(F.col("d"), F.col("b"))).collect()]
    assert got == [True, True, False, False, True, True]


def test_date_labels(spark):
    df = spark.createDataFrame([("2031-02-03",)], "d string")
    r = df.select(D.date_label(F.col("d")).alias("l"), D.date_label_plain(F.col("d")).alias("p")).first()
    assert r["l"].asDict() == {"ko": "2031-02-03 (현지)", "en": "Feb 3, 2031 (local)"}
    assert r["p"].asDict() == {"ko": "2031-02-03 (현지)", "en": "2031-02-03"}


def test_labels_of_odd_text_are_null_not_errors(spark):
    odd = ["2031-00-10", "2031/08/15", "x", "", None, "2031-13-01"]
    assert [r["en"] for r in run(spark, D.date_label, odd)] == [None] * 6
    assert run(spark, lambda c: D.weekday_name(c, "en"), ["2031/08/15", "x", None]) == [None] * 3
    assert run(spark, lambda c: D.format_wall_clock(c, "en"), ["2031-08-15", "x", None]) == [None] * 3


def test_weekday_and_overflow(spark):
    # 2031-05-06 is a Tuesday; Jun 31 rolls over to Jul 1 (a Tuesday)
    assert run(spark, lambda c: D.weekday_name(c, "en"), ["2031-05-06", "2031-06-31"]) == ["Tue", "Tue"]
    assert run(spark, lambda c: D.weekday_name(c, "ko"), ["2031-05-06"]) == ["화"]


def test_wall_clock_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert run(spark, lambda c: D.format_wall_clock(c, "en"), ["2031-05-06T07:45:00+09:00"]) == ["Tue 5/6 07:45"]
        assert run(spark, lambda c: D.format_wall_clock(c, "ko"), ["2031-12-07T23:30:00+09:00"]) == ["12/7(일) 23:30"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_convert_kickoff_across_dst(spark):
    df = spark.createDataFrame([("2031-07-01 13:05:00",), ("2031-12-01 13:05:00",)], "t string")
    got = [r[0] for r in df.select(D.convert_kickoff(F.to_timestamp_ntz("t"))).collect()]
    assert got == ["2031-07-02T02:05:00+09:00", "2031-12-02T03:05:00+09:00"]
