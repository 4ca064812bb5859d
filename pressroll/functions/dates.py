"""Date and time column functions (Column in, Column out).

Dates stay ISO strings ``YYYY-MM-DD`` (compared as text); a calendar-invalid
string such as ``2026-02-31`` is a legal value, so nothing here calls
``to_date`` on parsed input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressroll.functions.strings import WS, js_trim

# --- fixed values (must equal the reference) --------------------------------
# Month spellings accepted by the US date parser, lower case.
MONTH_NUMBERS = {
    "january": "01", "jan": "01",
    "february": "02", "feb": "02",
    "march": "03", "mar": "03",
    "april": "04", "apr": "04",
    "may": "05",
    "june": "06", "jun": "06",
    "july": "07", "jul": "07",
    "august": "08", "aug": "08",
    "september": "09", "sep": "09", "sept": "09",
    "october": "10", "oct": "10",
    "november": "11", "nov": "11",
    "december": "12", "dec": "12",
}
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
              "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAYS_EN = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
WEEKDAYS_KO = ["일", "월", "화", "수", "목", "금", "토"]
LOCAL_KO = " (현지)"
LOCAL_EN = " (local)"
# ----------------------------------------------------------------------------

# month word, optional dot, blanks, 1-2 digit day, optional comma, optional
# blanks, 4-digit year; the whole (trimmed) text must match.
US_DATE_PATTERN = (
    r"^([A-Za-z]+)\.?[" + WS + r"]+([0-9]{1,2}),?[" + WS + r"]*([0-9]{4})\z"
)


def _month_map() -> Column:
    pairs = []
    for name, num in MONTH_NUMBERS.items():
        pairs += [F.lit(name), F.lit(num)]
    return F.create_map(*pairs)


def _let(value: Column, fn) -> Column:
    return F.transform(F.array(value), fn)[0]


_MARK = "\u0001"


def parse_us_date(raw: Column) -> Column:
    """``August 15, 2026`` / ``Aug. 15 2026`` -> ``2026-08-15``; NULL if no match.

    No calendar check: ``Feb 31, 2026`` gives ``2026-02-31``. One regex pass
    per value: a match is rewritten to marked parts, which are then split.
    """
    def from_trimmed(t):
        def from_parts(r):
            p = F.split(r, _MARK)
            month = F.try_element_at(_month_map(), F.lower(p[2]))
            ok = (r != t) & month.isNotNull()
            return F.when(ok, F.concat(p[1], F.lit("-"), month, F.lit("-"), F.lpad(p[3], 2, "0")))
        return _let(F.regexp_replace(t, US_DATE_PATTERN, _MARK + "$3" + _MARK + "$1" + _MARK + "$2"), from_parts)
    return _let(js_trim(raw.cast("string")), from_trimmed)


def newer_than(date: Column, baseline: Column) -> Column:
    """Strictly newer than the baseline; an empty or missing baseline accepts all."""
    return F.when(baseline.isNull() | (baseline == F.lit("")), F.lit(True)).otherwise(
        date > baseline
    )


def _parts(iso: Column):
    p = F.split(iso, "-")
    return F.get(p, 0).try_cast("int"), F.get(p, 1).try_cast("int"), F.get(p, 2).try_cast("int")


def date_label(iso: Column) -> Column:
    """Library style: ``{ko: "2026-01-05 (현지)", en: "Jan 5, 2026 (local)"}``."""
    y, mo, d = _parts(iso)
    en = F.concat(
        F.get(F.array(*[F.lit(m) for m in MONTH_ABBR]), mo - 1),
        F.lit(" "), d.cast("string"), F.lit(", "), y.cast("string"), F.lit(LOCAL_EN),
    )
    return F.struct(F.concat(iso, F.lit(LOCAL_KO)).alias("ko"), en.alias("en"))


def date_label_plain(iso: Column) -> Column:
    """Ingest-job style: ``{ko: iso + " (현지)", en: iso}``."""
    return F.struct(F.concat(iso, F.lit(LOCAL_KO)).alias("ko"), iso.alias("en"))


def civil_date(y: Column, mo: Column, d: Column) -> Column:
    """Calendar date of (y, mo, d) with day/month overflow rolled forward."""
    return F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), mo - 1), d - 1)


def weekday_index(iso: Column) -> Column:
    """0 = Sunday .. 6 = Saturday, for an ISO date string (overflow rolls over)."""
    y, mo, d = _parts(iso)
    return F.dayofweek(civil_date(y, mo, d)) - 1


def weekday_name(iso: Column, lang: str = "en") -> Column:
    names = WEEKDAYS_KO if lang == "ko" else WEEKDAYS_EN
    return F.get(F.array(*[F.lit(n) for n in names]), weekday_index(iso))


def format_wall_clock(iso_ts: Column, lang: str = "en") -> Column:
    """Wall clock of an offset timestamp text, read off the text (no zone math).

    ko: ``9/14(월) 05:25``; en: ``Mon 9/14 05:25``.
    """
    date_part = F.get(F.split(iso_ts, "T"), 0)
    time_part = F.get(F.split(iso_ts, "T"), 1)
    _, mo, d = _parts(date_part)
    hh = F.get(F.split(time_part, ":"), 0)
    mm = F.get(F.split(time_part, ":"), 1)
    dow = weekday_name(date_part, lang)
    md = F.concat(mo.cast("string"), F.lit("/"), d.cast("string"))
    clock = F.concat(hh, F.lit(":"), mm)
    if lang == "ko":
        return F.concat(md, F.lit("("), dow, F.lit(") "), clock)
    return F.concat(dow, F.lit(" "), md, F.lit(" "), clock)


def convert_kickoff(et_wall_clock: Column,
                    source_tz: str = "America/New_York",
                    target_tz: str = "Asia/Seoul",
                    offset_text: str = "+09:00") -> Column:
    """Eastern wall-clock kickoff (timestamp_ntz) -> ``YYYY-MM-DDTHH:MM:SS+09:00``."""
    local = F.convert_timezone(F.lit(source_tz), F.lit(target_tz), et_wall_clock)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset_text))


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
