"""String column functions: trimming, HTML stripping, cuts, base64, put
records, fenced JSON, prompt templates, text blocks, literal replacement.

Everything is a built-in expression (JVM side, whole-stage codegen); regular
expressions are written so that DuckDB (RE2) accepts the same pattern text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as JavaScript's trim() and \s see it (line terminators,
# NBSP, the Zs block, ideographic space and BOM). Java's \s and Spark's trim
# are ASCII only, hence the explicit class.
WS = (r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}\x{FEFF}")

# --- fixed values (must equal the reference) --------------------------------
LIST_PAGE_BUDGET = 60000      # characters of stripped list page sent on
ARTICLE_BUDGET = 15000        # characters of stripped article body
ERROR_EXCERPT = 200           # characters of unparsable text quoted in errors
DAY_SEPARATOR = "\n\n---\n\n"  # between article texts of one date
FETCH_FAILED_PREFIX = "[Could not fetch full article body: "
# ----------------------------------------------------------------------------


# The same set as single characters (for trim, which only looks at the ends).
WS_CHARS = ("\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(c: Column) -> Column:
    """Strip leading and trailing Unicode white space (only the ends are read)."""
    return F.trim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    """True when the text has no non-space character (NULL for NULL)."""
    return ~c.rlike(r"[^" + WS + r"]")


def strip_html(html: Column) -> Column:
    """Drop script and style elements and comments, collapse white space, trim.

    Other tags stay; the result only has to be readable text.
    """
    out = F.regexp_replace(html, r"(?i)<script[\s\S]*?</script>", " ")
    out = F.regexp_replace(out, r"(?i)<style[\s\S]*?</style>", " ")
    out = F.regexp_replace(out, r"<!--[\s\S]*?-->", " ")
    out = F.regexp_replace(out, r"[" + WS + r"]+", " ")
    return js_trim(out)


def truncate(c: Column, n: int) -> Column:
    """First ``n`` characters (code points; a surrogate pair is never split)."""
    return F.substring(c, 1, n)


def b64encode(text: Column) -> Column:
    """UTF-8 bytes as one line of base64 (no line breaks, whatever the conf)."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")


def b64decode(b64: Column) -> Column:
    return F.decode(F.unbase64(b64), "UTF-8")


def put_record(content: Column, message: Column, sha: Column) -> Column:
    """JSON body ``{message, content: base64, sha?}``; ``sha`` only when non-empty."""
    return F.to_json(
        F.struct(
            message.alias("message"),
            b64encode(content).alias("content"),
            F.when(sha != F.lit(""), sha).alias("sha"),
        )
    )


FENCE_PATTERN = r"^```(?:json)?[" + WS + r"]*([\s\S]*?)[" + WS + r"]*```\z"


def _let(value: Column, fn) -> Column:
    return F.transform(F.array(value), fn)[0]


def unfence(text: Column) -> Column:
    """Trimmed text, or the trimmed inside of one ``` / ```json fence around all
    of it (the fence pattern above, decided from the two ends and cut by
    position instead of a scan of the whole text)."""
    def cut(t):
        fenced = t.startswith("```") & t.endswith("```") & (F.length(t) >= 6)
        body = F.substring(t, F.lit(4), F.length(t) - 6)
        body = F.when(body.startswith("json"), F.substring(body, F.lit(5), F.length(body))).otherwise(body)
        return F.when(fenced, js_trim(body)).otherwise(t)
    return _let(js_trim(text), cut)


def parse_fenced_json(text: Column) -> Column:
    """struct(value variant, error string): exactly one of them is set.

    The error carries the first 200 characters of the text that failed; the
    wording of the engine's own parse message is not reproduced. The text is
    unfenced and parsed once per row.
    """
    def build(inner):
        def with_value(v):
            error = (F.when(text.isNull(), F.lit("parse_fenced_json: expected a string, got object"))
                      .when(v.isNull(), F.concat(F.lit("parse_fenced_json: failed to parse JSON: "),
                                                 truncate(inner, ERROR_EXCERPT))))
            return F.struct(F.when(error.isNull(), v).alias("value"), error.alias("error"))
        return _let(F.try_parse_json(inner), with_value)
    return _let(unfence(text), build)


def _shape(fields: dict) -> str:
    """A field list as a prompt shows it: ``{"a": text, "b": [text]}``."""
    def one(v):
        return _shape(v) if isinstance(v, dict) else f"[{one(v[0])}]" if isinstance(v, list) else v
    return "{" + ", ".join(f'"{k}": {one(v)}' for k, v in fields.items()) + "}"


# What the parser of the answer reads, and so what a prompt has to ask for.
BOTH = {"ko": "text", "en": "text"}
ARTICLE_SHAPE = {"title": "text", "url": "text", "publishedRaw": "text"}
DAY_SHAPE = {
    "headline": BOTH,
    "stories": [{"icon": "text", "status": "text", "tags": ["text"], "title": BOTH,
                 "facts": {"ko": ["text"], "en": ["text"]}, "interp": BOTH, "url": "text"}],
    "injuries": [{"player": BOTH, "issue": BOTH, "status": BOTH, "watch": "true or false"}],
    "moves": [{"date": "text", "text": BOTH}],
    "schedule": [{"date": BOTH, "text": BOTH}],
}
ORGANIZE_SECTIONS = tuple(DAY_SHAPE)

EXTRACT_PROMPT_LINES = (
    "Input: the visible text of one web page with links to articles.",
    "Output: a bare JSON array with an object for each article: " + _shape(ARTICLE_SHAPE),
    "Copy all three fields from the page. A program parses the date, so keep its spelling.",
    "Objects that lack a field are dropped.",
    "<<< page",
)
EXTRACT_PROMPT_END = ">>> page"


def extract_prompt(page_text: Column) -> Column:
    """Prompt asking a model to list the articles of a stripped list page."""
    return F.concat_ws("\n", *[F.lit(x) for x in EXTRACT_PROMPT_LINES], page_text,
                       F.lit(EXTRACT_PROMPT_END))


ORGANIZE_PROMPT_HEAD = "Input: texts of articles of one day. Output: their briefing as a bare JSON object."
ORGANIZE_PROMPT_DATE = ("Day: ", "")
# What the status of a story may be.
STORY_STATUS = ("NEW", "UPDATE", "CONFIRMED", "RUMOR", "UPCOMING")
ORGANIZE_PROMPT_BODY = (
    "Shape of the object: " + _shape(DAY_SHAPE),
    "Compose each en text first; its ko text is a fluent translation of it with the same meaning.",
    "A story has one of these as its status: " + ", ".join(STORY_STATUS) + ".",
    "The validator refuses blank texts, a story without tags, and fact lists of unequal length in ko and en.",
    "A list with nothing to report is []. The url of a story is that of its article's first line; "
    "watch may be left out.",
    "<<< articles",
)
ORGANIZE_PROMPT_END = ">>> articles"


def organize_prompt(date_iso: Column, articles_text: Column) -> Column:
    """Prompt asking a model to turn one date's articles into a day document."""
    return F.concat_ws(
        "\n",
        F.lit(ORGANIZE_PROMPT_HEAD),
        F.concat(F.lit(ORGANIZE_PROMPT_DATE[0]), date_iso, F.lit(ORGANIZE_PROMPT_DATE[1])),
        *[F.lit(x) for x in ORGANIZE_PROMPT_BODY],
        articles_text,
        F.lit(ORGANIZE_PROMPT_END),
    )


def concat_text_blocks(content: Column) -> Column:
    """Join the ``text`` of blocks whose ``type`` is ``text``; missing list -> ''."""
    blocks = F.coalesce(content, F.array().cast("array<struct<type:string,text:string>>"))
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == F.lit("text")), lambda b: b["text"])
    return F.array_join(texts, "")


def literal_replace(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Replace every occurrence of each literal (not a pattern), pairs in order."""
    out = text
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out
