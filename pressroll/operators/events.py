"""Interaction events: usage counts, the event contract, debounce and
press-and-hold detection (batch forms; streaming forms in ``streaming``).

Per-user sequences are ordered by (ts, seq). "Next event of the same user"
comes from ``sequence.next_match``, which stays exact and parallel when one
user produces a large share of all events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroll.operators.sequence import next_match, next_matches

# --- fixed values (must equal the reference) ---------------------------------------
# event name -> the one data key it may carry
EVENT_CATALOGUE = {
    "nav_tab": "page",
    "schedule_team_tab": "team",
    "archive_tag_filter": "tag",
    "story_tag_filter": "tag",
    "archive_search": "chars",
    "lang_toggle": "lang",
}
MAX_DATA_KEYS = 2
DEBOUNCE = "800 milliseconds"
HOLD_DELAY = "500 milliseconds"
# ------------------------------------------------------------------------------------


def usage(events: DataFrame, window: str = "1 day") -> DataFrame:
    """Events and distinct users per tumbling window and event name."""
    return (events.groupBy(F.window("ts", window).alias("w"), "name")
                  .agg(F.count(F.lit(1)).alias("n_events"),
                       F.count_distinct("user").alias("n_users"))
                  .select(F.col("w.start").alias("window_start"), "name", "n_events", "n_users"))


def contract_violations(events: DataFrame) -> DataFrame:
    """Events that break the contract, with the reasons (comma-joined):
    unknown name, a key the name does not allow, more than two keys."""
    allowed = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in EVENT_CATALOGUE.items() for x in kv]), F.col("name"))
    keys = F.coalesce(F.map_keys("data"), F.array().cast("array<string>"))
    reasons = F.filter(F.array(
        F.when(allowed.isNull(), F.lit("unknown_name")),
        F.when(allowed.isNotNull() & F.exists(keys, lambda k: k != allowed), F.lit("unknown_key")),
        F.when(F.size(keys) > MAX_DATA_KEYS, F.lit("too_many_keys")),
    ), lambda r: r.isNotNull())
    return (events.withColumn("reasons", reasons)
                  .where(F.size("reasons") > 0)
                  .select("user", "seq", "name", F.array_join("reasons", ",").alias("reasons")))


def debounce(inputs: DataFrame, gap: str = DEBOUNCE, length_col: str = "chars") -> DataFrame:
    """One event per pause: an input fires ``gap`` after itself when the box is
    not empty and the user's next input (of any kind) comes ``gap`` or more later
    (or never). Emits (user, seq, chars, fire_ts)."""
    nx = next_match(inputs.select("user", "ts", "seq", length_col), ["user"], ["ts", "seq"])
    gap_ok = F.col("next").isNull() | (F.col("next.ts") >= F.col("ts") + F.expr(f"INTERVAL {gap}"))
    return (nx.where((F.col(length_col) > 0) & gap_ok)
              .select("user", "seq", length_col, (F.col("ts") + F.expr(f"INTERVAL {gap}")).alias("fire_ts")))


def hold(presses: DataFrame, delay: str = HOLD_DELAY) -> DataFrame:
    """Press-and-hold: ``start`` arms a timer, a second ``start`` re-arms it,
    ``cancel`` disarms. A start fires (becomes active) when no event of the
    user follows within ``delay``; a cancel ends an active hold once.

    Input (user, seq, ts, is_cancel); output (user, seq, kind, at) with kind
    ``start`` (at = press + delay) or ``end`` (at = the cancel).
    """
    p = presses.select("user", "ts", "seq", "is_cancel")
    nc = next_matches(p, ["user"], ["ts", "seq"],
                      conditions={"next_any": None, "next_cancel": F.col("is_cancel")})
    later = F.col("ts") + F.expr(f"INTERVAL {delay}")
    fired = nc.where(~F.col("is_cancel") & (F.col("next_any").isNull() | (F.col("next_any.ts") >= later)))
    starts = fired.select("user", "seq", F.lit("start").alias("kind"), later.alias("at"))
    ends = (fired.where(F.col("next_cancel").isNotNull())
                 .select("user", F.col("next_cancel.seq").alias("seq"), F.col("next_cancel.ts").alias("at"))
                 .distinct()
                 .select("user", "seq", F.lit("end").alias("kind"), "at"))
    return starts.unionByName(ends)
