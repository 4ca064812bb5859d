"""Rules over VARIANT documents (type tests, bilingual tests, validators,
index-entry derivation).

JSON keeps two facts a typed struct loses: whether a key is present (absent
is not the same as null) and the exact JSON type of a value ("12345" and
12345 differ). Both are read from the VARIANT: a present key gives a
non-NULL variant (JSON null included), ``schema_of_variant`` names the type.
Every rule returns a non-NULL boolean; validators return ``array<string>``
(empty = valid), child errors prefixed with their path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressroll.functions.strings import is_blank

# --- fixed values (must equal the reference): validator messages ------------
MSG_STORY_NOT_OBJECT = "story is not an object"
MSG_STORY_ICON = "story.icon must be a non-empty string"
MSG_STORY_STATUS = "story.status must be a non-empty string"
MSG_STORY_TAGS = "story.tags must be a non-empty array of non-empty strings"
MSG_STORY_TITLE = "story.title must be {ko, en} non-empty strings"
MSG_STORY_FACTS = "story.facts must be {ko: [...], en: [...]} with matching, non-zero length"
MSG_STORY_INTERP = "story.interp must be {ko, en} non-empty strings"
MSG_STORY_URL = "story.url must be a non-empty string when present"
MSG_INJURY_NOT_OBJECT = "injury row is not an object"
MSG_INJURY_PLAYER = "injury.player must be {ko, en}"
MSG_INJURY_ISSUE = "injury.issue must be {ko, en}"
MSG_INJURY_STATUS = "injury.status must be {ko, en}"
MSG_INJURY_WATCH = "injury.watch must be boolean when present"
MSG_MOVE_NOT_OBJECT = "move row is not an object"
MSG_MOVE_DATE = "move.date must be a non-empty string"
MSG_MOVE_TEXT = "move.text must be {ko, en}"
MSG_SCHEDULE_NOT_OBJECT = "schedule row is not an object"
MSG_SCHEDULE_DATE = "schedule.date must be {ko, en}"
MSG_SCHEDULE_TEXT = "schedule.text must be {ko, en}"
MSG_DAY_NOT_OBJECT = "day data is not an object"
MSG_DAY_DATE = "day.date must be a YYYY-MM-DD string"
MSG_DAY_LABEL = "day.dateLabel must be {ko, en}"
MSG_DAY_HEADLINE = "day.headline must be {ko, en}"
MSG_DAY_STORIES = "day.stories must be a non-empty array"
MSG_DAY_INJURIES = "day.injuries must be an array"
MSG_DAY_MOVES = "day.moves must be an array"
MSG_DAY_SCHEDULE = "day.schedule must be an array"
DAY_KEYS = ("date", "dateLabel", "headline", "stories", "injuries", "moves", "schedule")
INDEX_KEYS = ("date", "dateLabel", "headline", "storyCount", "moveCount", "tags")
# ----------------------------------------------------------------------------

ISO_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


class J:
    """A JSON value inside a variant column: the column plus a path.

    Paths compose (``J(doc)["headline"]["ko"]`` reads ``$.headline.ko``) so a
    rule extracts each leaf once instead of copying every enclosing object.
    """

    def __init__(self, base: Column, path: str = "$"):
        self.base, self.path = base, path

    def __getitem__(self, key: str) -> "J":
        return J(self.base, f"{self.path}.{key}")

    def at(self, i: int) -> "J":
        return J(self.base, f"{self.path}[{i}]")

    @property
    def v(self) -> Column:
        return self.base if self.path == "$" else F.variant_get(self.base, self.path, "variant")

    def text(self) -> Column:
        return F.variant_get(self.base, self.path, "string")


def _j(x) -> J:
    return x if isinstance(x, J) else J(x)


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it in ``fn`` (a lambda variable); keeps the
    optimizer from pasting a costly definition into every reference."""
    return F.transform(F.array(value), fn)[0]


def _b(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def get(v, key: str) -> J:
    """Child value (absent key or non-object parent -> NULL variant)."""
    return _j(v)[key]


def vtype(v) -> Column:
    return F.schema_of_variant(_j(v).v)


def has_key(v, key: str) -> Column:
    """``key in v`` for an object: present, even when its value is null."""
    return _b(_j(v)[key].v.isNotNull())


def is_string(v) -> Column:
    return _b(vtype(v) == F.lit("STRING"))


def is_boolean(v) -> Column:
    return _b(vtype(v) == F.lit("BOOLEAN"))


def is_number(v) -> Column:
    t = vtype(v)
    return _b(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")
              | t.startswith("DECIMAL"))


def is_array(v) -> Column:
    return _b(vtype(v).startswith("ARRAY"))


def is_object_like(v) -> Column:
    """Non-null object or array (an array passes, then fails field by field)."""
    t = vtype(v)
    return _b(t.startswith("OBJECT") | t.startswith("ARRAY"))


def as_text(v) -> Column:
    return _j(v).text()


def as_array(v) -> Column:
    return _j(v).v.try_cast("array<variant>")


def is_nonempty(v) -> Column:
    """A JSON string with at least one non-space character."""
    j = _j(v)
    return is_string(j) & _b(~is_blank(j.text()))


def is_bilingual(v) -> Column:
    j = _j(v)
    return is_nonempty(j["ko"]) & is_nonempty(j["en"])


def _all_nonempty(arr: Column) -> Column:
    return F.forall(arr, lambda e: is_nonempty(J(e)))


def is_bilingual_list(v) -> Column:
    j = _j(v)
    ko, en = as_array(j["ko"]), as_array(j["en"])
    return _b(
        (F.size(ko) > 0) & (F.size(en) > 0) & (F.size(ko) == F.size(en))
        & _all_nonempty(ko) & _all_nonempty(en)
    )


def _errors(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(msg)) for bad, msg in pairs]),
                    lambda e: e.isNotNull())


def _guarded(v, not_object_msg: str, rules: Column) -> Column:
    return F.when(~is_object_like(v), F.array(F.lit(not_object_msg))).otherwise(rules)


def story_errors(s) -> Column:
    s = _j(s)
    tags = as_array(s["tags"])
    tags_ok = _b((F.size(tags) > 0) & _all_nonempty(tags))
    return _guarded(s, MSG_STORY_NOT_OBJECT, _errors(
        (~is_nonempty(s["icon"]), MSG_STORY_ICON),
        (~is_nonempty(s["status"]), MSG_STORY_STATUS),
        (~tags_ok, MSG_STORY_TAGS),
        (~is_bilingual(s["title"]), MSG_STORY_TITLE),
        (~is_bilingual_list(s["facts"]), MSG_STORY_FACTS),
        (~is_bilingual(s["interp"]), MSG_STORY_INTERP),
        (has_key(s, "url") & ~is_nonempty(s["url"]), MSG_STORY_URL),
    ))


def injury_errors(r) -> Column:
    r = _j(r)
    return _guarded(r, MSG_INJURY_NOT_OBJECT, _errors(
        (~is_bilingual(r["player"]), MSG_INJURY_PLAYER),
        (~is_bilingual(r["issue"]), MSG_INJURY_ISSUE),
        (~is_bilingual(r["status"]), MSG_INJURY_STATUS),
        (has_key(r, "watch") & ~is_boolean(r["watch"]), MSG_INJURY_WATCH),
    ))


def move_errors(r) -> Column:
    r = _j(r)
    return _guarded(r, MSG_MOVE_NOT_OBJECT, _errors(
        (~is_nonempty(r["date"]), MSG_MOVE_DATE),
        (~is_bilingual(r["text"]), MSG_MOVE_TEXT),
    ))


def schedule_errors(r) -> Column:
    r = _j(r)
    return _guarded(r, MSG_SCHEDULE_NOT_OBJECT, _errors(
        (~is_bilingual(r["date"]), MSG_SCHEDULE_DATE),
        (~is_bilingual(r["text"]), MSG_SCHEDULE_TEXT),
    ))


ROW_RULES = {
    "stories": story_errors,
    "injuries": injury_errors,
    "moves": move_errors,
    "schedule": schedule_errors,
}


def prefixed_child_errors(arr: Column, name: str) -> Column:
    """``name[i]: message`` for every error of every element, in element order."""
    rule = ROW_RULES[name]
    return F.flatten(F.transform(
        arr,
        lambda x, i: F.transform(rule(J(x)), lambda e: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]: "), e)),
    ))


def _day_rules(d: J) -> Column:
    date = d["date"]
    date_ok = is_nonempty(date) & _b(date.text().rlike(ISO_DATE_PATTERN))
    stories = d["stories"]
    stories_ok = is_array(stories) & _b(F.size(as_array(stories)) > 0)

    def section(name: str, ok: Column, msg: str) -> Column:
        return F.when(ok, prefixed_child_errors(as_array(d[name]), name)).otherwise(F.array(F.lit(msg)))

    rules = F.concat(
        _errors((~date_ok, MSG_DAY_DATE),
                (~is_bilingual(d["dateLabel"]), MSG_DAY_LABEL),
                (~is_bilingual(d["headline"]), MSG_DAY_HEADLINE)),
        section("stories", stories_ok, MSG_DAY_STORIES),
        section("injuries", is_array(d["injuries"]), MSG_DAY_INJURIES),
        section("moves", is_array(d["moves"]), MSG_DAY_MOVES),
        section("schedule", is_array(d["schedule"]), MSG_DAY_SCHEDULE),
    )
    return _guarded(d, MSG_DAY_NOT_OBJECT, rules)


def day_errors(d: Column) -> Column:
    """All errors of a day document, in the reference's order."""
    return let(d, lambda x: _day_rules(J(x)))


_BUILT: dict = {}


def day_errors_of(name: str) -> Column:
    """``day_errors(col(name))``, built once per Spark context (the rule tree
    has thousands of nodes; building it through the Python bridge is slow)."""
    from pyspark import SparkContext

    key = (name, id(SparkContext._active_spark_context))
    if key not in _BUILT:
        _BUILT[key] = day_errors(F.col(name))
    return _BUILT[key]


def missing_keys(v: Column, keys) -> Column:
    """Required keys absent from an object, in the given key order."""
    return let(v, lambda x: F.filter(F.array(*[F.when(~has_key(J(x), k), F.lit(k)) for k in keys]),
                                      lambda e: e.isNotNull()))
