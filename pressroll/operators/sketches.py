"""Distinct users of any span of days from sketches of single days.

A sketch (HyperLogLog, ``2**LG_K`` registers) is stored per day and event name;
weeks, months or any other spans are unions of the stored sketches, so the
events are read once. Counts of events add up exactly. The estimate's relative
standard error is about ``0.83 / sqrt(2**LG_K)``, 1.3 % for the default; ``bound``
is four times that and at least one user.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def error_bound(lg_k: int = LG_K) -> float:
    return 4 * 0.83 / sqrt(2**lg_k)


def daily(events: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(day, name, n_events, sketch): what is stored of the events. A null user is no user."""
    return events.groupBy(F.to_date("ts").alias("day"), "name").agg(
        F.count(F.lit(1)).alias("n_events"), F.hll_sketch_agg("user", F.lit(lg_k)).alias("sketch"))


def merged(days: DataFrame, span: Column) -> DataFrame:
    """(span, name, n_events, n_users_estimate) of the spans the days fall into."""
    return days.groupBy(span.alias("span"), "name").agg(
        F.sum("n_events").alias("n_events"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_users_estimate"))


def measured(estimates: DataFrame, exact: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Estimates beside exact counts (span, name, n_users) and whether they keep the bound."""
    both = estimates.join(exact, ["span", "name"])
    apart = F.abs(F.col("n_users_estimate") - F.col("n_users"))
    return both.withColumn("in_bound", apart <= F.greatest(F.lit(1.0), F.col("n_users") * error_bound(lg_k)))
