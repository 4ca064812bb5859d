"""The registered queries restated in plain SQL (DuckDB dialect), used as the
independent check of every Spark result. Tables are the driver's views.

Fragments below restate the adapters of ``sources.tables``; expressions are
written out again (not generated from the Spark code) so that a mistake in
one of the two shows up as a mismatch.
"""

from __future__ import annotations

from pressroll.functions.dates import MONTH_ABBR, MONTH_NUMBERS
from pressroll.functions.strings import WS
from pressroll.functions import documents as Dm
from pressroll.functions import strings as St
from pressroll.operators.events import EVENT_CATALOGUE
from pressroll.operators.schedule import HOME_SITES, LABELS
from pressroll.sources.tables import FULL_MONTHS, SAVED_THROUGH

ORACLE: dict[str, str] = {}


def sql_list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+\\z', '', 'g')"


US_P = f"^([A-Za-z]+)\\.?[{WS}]+([0-9]{{1,2}}),?[{WS}]*([0-9]{{4}})\\z"
MONTH_CASE = "CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MONTH_NUMBERS.items()) + " END"


def parse_us(x: str) -> str:
    t = js_trim(x)
    m = MONTH_CASE.format(x=f"lower(regexp_extract({t}, '{US_P}', 1))")
    return (f"CASE WHEN regexp_matches({t}, '{US_P}') AND {m} IS NOT NULL THEN "
            f"regexp_extract({t}, '{US_P}', 3) || '-' || {m} || '-' || "
            f"lpad(regexp_extract({t}, '{US_P}', 2), 2, '0') END")


def label_en(x: str) -> str:
    return (f"{sql_list(MONTH_ABBR)}[TRY_CAST(string_split({x}, '-')[2] AS INTEGER)] || ' ' || "
            f"CAST(TRY_CAST(string_split({x}, '-')[3] AS INTEGER) AS VARCHAR) || ', ' || "
            f"CAST(TRY_CAST(string_split({x}, '-')[1] AS INTEGER) AS VARCHAR) || ' (local)'")


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d')"


ARTICLES = f"""articles AS (
  SELECT o_orderkey AS ordinal, o_orderpriority AS title, '/o/' || o_orderkey AS url,
    CASE WHEN o_orderkey % 50 = 0 THEN 'Updated ' || year(o_orderdate)
         WHEN o_orderkey % 4 = 0 THEN {sql_list(FULL_MONTHS)}[month(o_orderdate)] || ' ' || day(o_orderdate) || ', ' || year(o_orderdate)
         WHEN o_orderkey % 4 = 1 THEN {sql_list(MONTH_ABBR)}[month(o_orderdate)] || ' ' || day(o_orderdate) || ', ' || year(o_orderdate)
         WHEN o_orderkey % 4 = 2 THEN (CASE WHEN month(o_orderdate) = 9 THEN 'Sept' ELSE {sql_list(MONTH_ABBR)}[month(o_orderdate)] END)
                                      || '. ' || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') || ' ' || year(o_orderdate)
         ELSE chr(160) || ' ' || lower({sql_list(FULL_MONTHS)}[month(o_orderdate)]) || ' ' || day(o_orderdate) || ',' || year(o_orderdate) || chr(10)
    END AS publishedRaw
  FROM orders)"""

PARSED = f"""parsed AS (SELECT *, {parse_us('publishedRaw')} AS date FROM articles)"""


def day_store(suffix: str, through: str | None) -> str:
    cond = f"o_orderdate < DATE '{through}' + INTERVAL 1 DAY" if through else "TRUE"
    return f"""stories{suffix} AS (
  SELECT {iso('o_orderdate')} AS date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
         CASE WHEN l_quantity >= 40 THEN 'BULK' WHEN l_quantity >= 10 THEN 'CASE' ELSE 'UNIT' END AS tag0,
         'FLAG_' || l_returnflag AS tag1, 'LINE_' || l_linestatus AS tag2,
         l_quantity, l_returnflag, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {cond}),
moves{suffix} AS (
  SELECT {iso('o_orderdate')} AS date, o_orderkey AS move_ord FROM orders
  WHERE o_orderstatus = 'F' AND {cond}),
days{suffix} AS (
  SELECT {iso('o_orderdate')} AS date, min(o_orderkey) AS first_key FROM orders WHERE {cond} GROUP BY 1),
tagpos{suffix} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY date, tag
                                 ORDER BY l_orderkey, l_linenumber, tp) AS rn
    FROM (SELECT date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, tag0 AS tag, 0 AS tp FROM stories{suffix}
          UNION ALL SELECT date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, tag1, 1 FROM stories{suffix}
          UNION ALL SELECT date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, tag2, 2 FROM stories{suffix}))
  WHERE rn = 1),
index{suffix} AS (
  SELECT d.date, d.date || ' (현지)' AS label_ko, {label_en('d.date')} AS label_en,
         '주문 ' || d.first_key || ' 외' AS headline_ko, 'Order ' || d.first_key || ' and more' AS headline_en,
         CAST(coalesce(s.n, 0) AS BIGINT) AS storyCount, CAST(coalesce(m.n, 0) AS BIGINT) AS moveCount,
         coalesce(t.tags, '') AS tags
  FROM days{suffix} d
  LEFT JOIN (SELECT date, count(*) AS n FROM stories{suffix} GROUP BY 1) s ON s.date = d.date
  LEFT JOIN (SELECT date, count(*) AS n FROM moves{suffix} GROUP BY 1) m ON m.date = d.date
  LEFT JOIN (SELECT date, string_agg(tag, ',' ORDER BY l_orderkey, l_linenumber, tp, tag) AS tags
             FROM tagpos{suffix} GROUP BY 1) t ON t.date = d.date)"""


SAVED = day_store("_saved", SAVED_THROUGH)
FULL = day_store("", None)
MARK = "mark AS (SELECT max(date) AS mark FROM index_saved)"
FRESH = """fresh AS (SELECT p.* FROM parsed p, mark
  WHERE p.date IS NOT NULL AND (mark.mark IS NULL OR mark.mark = '' OR p.date > mark.mark))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLE["incremental_index"] = with_(ARTICLES, PARSED, SAVED, MARK, FRESH, f"""flat AS (
  SELECT g.date, g.date || ' (현지)' AS label_ko, {label_en('g.date')} AS label_en,
         g.head AS headline_ko, g.head AS headline_en, CAST(g.n AS BIGINT) AS storyCount,
         CAST(0 AS BIGINT) AS moveCount, t.tags
  FROM (SELECT date, count(*) AS n, arg_min(title, ordinal) AS head FROM fresh GROUP BY date) g
  JOIN (SELECT date, string_agg(title, ',' ORDER BY first) AS tags
        FROM (SELECT date, title, min(ordinal) AS first FROM fresh GROUP BY date, title) GROUP BY date) t
    ON t.date = g.date)""") + """
SELECT * FROM index_saved WHERE date NOT IN (SELECT date FROM flat)
UNION ALL SELECT * FROM flat"""

ORACLE["parse_us_date"] = with_(ARTICLES, PARSED) + "SELECT ordinal, publishedRaw, date FROM parsed"

ORACLE["high_water_mark"] = with_(FULL) + "SELECT max(date) AS mark FROM index"

ORACLE["newer_than"] = with_(ARTICLES, PARSED, SAVED, MARK) + """
SELECT ordinal, date, (mark.mark IS NULL OR mark.mark = '' OR date > mark.mark) AS is_newer
FROM parsed, mark"""

ORACLE["incremental_articles"] = with_(ARTICLES, PARSED, SAVED, MARK, FRESH) + \
    "SELECT ordinal, title, url, date FROM fresh"

ORACLE["group_by_date"] = with_(ARTICLES, PARSED) + """
SELECT date, min(ordinal) OVER (PARTITION BY date) AS first_ordinal,
       CAST(row_number() OVER (PARTITION BY date ORDER BY ordinal) - 1 AS BIGINT) AS pos, ordinal, title
FROM parsed WHERE date IS NOT NULL"""

DAYS_ONLY = f"""days AS (SELECT {iso('o_orderdate')} AS date, min(o_orderkey) AS first_key FROM orders GROUP BY 1)"""

ORACLE["date_label"] = with_(DAYS_ONLY) + f"""
SELECT date, date || ' (현지)' AS label_ko, {label_en('date')} AS label_en FROM days"""

ORACLE["date_label_plain"] = with_(DAYS_ONLY) + """
SELECT date, date || ' (현지)' AS label_ko, date AS label_en FROM days"""

ORACLE["weekday_name"] = with_(DAYS_ONLY) + """
SELECT date, dayofweek(CAST(date AS DATE)) AS dow,
       ['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][dayofweek(CAST(date AS DATE)) + 1] AS name_en,
       ['일','월','화','수','목','금','토'][dayofweek(CAST(date AS DATE)) + 1] AS name_ko
FROM days"""

ORACLE["index_entry"] = with_(FULL) + "SELECT * FROM index"


# --- text functions ------------------------------------------------------------------


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def nl_join(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


def strip_sql(x: str) -> str:
    r = f"regexp_replace({x}, '(?i)<script[\\s\\S]*?</script>', ' ', 'g')"
    r = f"regexp_replace({r}, '(?i)<style[\\s\\S]*?</style>', ' ', 'g')"
    r = f"regexp_replace({r}, '<!--[\\s\\S]*?-->', ' ', 'g')"
    r = f"regexp_replace({r}, '[{WS}]+', ' ', 'g')"
    return js_trim(r)


SEP_SQL = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"

FEED = """feed AS (
  SELECT page_id AS ordinal, 'Page ' || page_id AS title,
         CASE WHEN page_id % 9 = 0 AND page_id % 28 % 4 = 0 THEN url || '#gone' ELSE url END AS url,
         '2026-08-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS date
  FROM pages)"""
BODIES = f"""bodies AS (
  SELECT f.ordinal, f.date, f.url,
         'URL: ' || f.url || chr(10) || f.title || chr(10) || chr(10) ||
         coalesce({strip_sql('p.html')},
                  {q(St.FETCH_FAILED_PREFIX)} || 'Failed to fetch ' || f.url || ' (404)]') AS text
  FROM feed f LEFT JOIN (SELECT url, arg_max(html, page_id) AS html FROM pages GROUP BY url) p ON f.url = p.url)"""
DAYTEXT = f"""daytext AS (
  SELECT date, CAST(pos // 64 AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n_rows,
         string_agg(text, {SEP_SQL} ORDER BY ordinal) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ordinal) - 1 AS pos FROM bodies)
  GROUP BY date, pos // 64)"""

ORACLE["strip_html"] = f"""SELECT page_id, {strip_sql('html')} AS text,
  CAST(length({strip_sql('html')}) AS BIGINT) AS n_chars FROM pages"""

ORACLE["truncate_text"] = f"""SELECT page_id, substring(t, 1, {St.LIST_PAGE_BUDGET}) AS list_text,
  substring(t, 1, {St.ARTICLE_BUDGET}) AS body_text, substring(html, 1, {St.ERROR_EXCERPT}) AS excerpt
FROM (SELECT page_id, html, {strip_sql('html')} AS t FROM pages)"""

ORACLE["article_bodies"] = with_(FEED, BODIES) + "SELECT ordinal, date, url, text FROM bodies"

ORACLE["day_text"] = with_(FEED, BODIES, DAYTEXT) + "SELECT date, part, n_rows, text FROM daytext"

ORACLE["organize_prompt"] = with_(FEED, BODIES, DAYTEXT) + "SELECT date, part, " + nl_join(
    q(St.ORGANIZE_PROMPT_HEAD),
    q(St.ORGANIZE_PROMPT_DATE[0]) + " || date || " + q(St.ORGANIZE_PROMPT_DATE[1]),
    *[q(x) for x in St.ORGANIZE_PROMPT_BODY], "text", q(St.ORGANIZE_PROMPT_END)) + " AS prompt FROM daytext"

ORACLE["extract_prompt"] = "SELECT page_id, " + nl_join(
    *[q(x) for x in St.EXTRACT_PROMPT_LINES], strip_sql('html'),
    q(St.EXTRACT_PROMPT_END)) + " AS prompt FROM pages"

ORACLE["base64_roundtrip"] = """SELECT doc_id, to_base64(encode(text)) AS b64,
  decode(from_base64(to_base64(encode(text)))) = text AS same FROM documents"""

ORACLE["put_record"] = """SELECT doc_id, 'briefing ' || doc_id AS message, to_base64(encode(text)) AS content,
  CASE WHEN doc_id % 3 = 2 THEN sha1(text) END AS sha,
  CASE WHEN doc_id % 3 = 2 THEN 'message,content,sha' ELSE 'message,content' END AS keys
FROM documents"""


def jstr(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


RAW_DAYS = f"""raw_days AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS raw
  FROM (
    SELECT doc_id, CASE WHEN doc_id % 37 = 10 THEN substring(b, 1, length(b) - 1) ELSE b END AS body
    FROM (
      SELECT doc_id, '{{' || concat_ws(',',
        '"date":' || CASE WHEN doc_id % 19 = 6 THEN '"' || dt || '\\n"' ELSE '"' || dt || '"' END,
        '"dateLabel":{{"ko":"' || dt || ' (현지)","en":"' || dt || '"}}',
        '"headline":' || CASE WHEN doc_id % 13 = 4 THEN t ELSE '{{"ko":' || lg || ',"en":' || t || '}}' END,
        '"stories":' || CASE WHEN doc_id % 23 = 7 THEN '[]' ELSE '[' ||
            '{{' || CASE WHEN doc_id % 5 = 1 THEN '' ELSE '"icon":"📰",' END ||
            '"status":"NEW","tags":[' || lg || ',' || src || '],"title":{{"ko":' || src || ',"en":' || src || '}}' ||
            ',"facts":{{"ko":[' || lg || '],"en":' ||
              CASE WHEN doc_id % 11 = 3 THEN '[' || lg || ',"extra"]' ELSE '[' || lg || ']' END ||
            '}},"interp":{{"ko":"해설","en":' || t || '}},"url":' ||
              CASE WHEN doc_id % 7 = 2 THEN 'null' WHEN doc_id % 29 = 8 THEN '12345' ELSE '"/d/' || doc_id || '"' END ||
            '}}' || ',' ||
            CASE WHEN doc_id % 43 = 12 THEN '"oops"' WHEN doc_id % 47 = 13 THEN '[]'
                 ELSE '{{"icon":"🏈","status":"RUMOR","tags":["NOTE"],"title":{{"ko":"메모","en":"Note"}},"facts":{{"ko":["가"],"en":["a"]}},"interp":{{"ko":"나","en":"b"}}}}' END ||
            ']' END,
        CASE WHEN doc_id % 31 = 9 THEN NULL ELSE
          '"injuries":[{{"player":{{"ko":"선수","en":"Player"}},"issue":{{"ko":"무릎","en":"Knee"}},"status":{{"ko":"주의","en":"Questionable"}},"watch":'
          || CASE WHEN doc_id % 17 = 5 THEN '"yes"' ELSE 'true' END || '}}]' END,
        '"moves":' || CASE WHEN doc_id % 3 = 1 THEN '[{{"date":' || CASE WHEN doc_id % 53 = 14 THEN '""' ELSE '"08-15"' END
                              || ',"text":{{"ko":"이동","en":"Move"}}}}]' ELSE '[]' END,
        '"schedule":[{{"date":{{"ko":"8월 15일\\n","en":"Aug 15\\n"}},"text":{{"ko":"경기","en":"Game"}}}}]'
      ) || '}}' AS b
      FROM (SELECT doc_id, {jstr('text')} AS t, {jstr('lang')} AS lg, {jstr('source')} AS src,
                   '2026-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' ||
                   lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS dt
            FROM documents))))"""

FENCE_SQL = St.FENCE_PATTERN
PARSED_DAYS = f"""inner_days AS (
  SELECT doc_id, raw, CASE WHEN regexp_matches({js_trim('raw')}, '{FENCE_SQL}')
                          THEN {js_trim(f"regexp_extract({js_trim('raw')}, '{FENCE_SQL}', 1)")}
                          ELSE {js_trim('raw')} END AS inner_text
  FROM raw_days),
docs AS (SELECT doc_id, CAST(inner_text AS JSON) AS doc FROM inner_days WHERE json_valid(inner_text))"""

ORACLE["parse_fenced_json"] = with_(RAW_DAYS, PARSED_DAYS) + """
SELECT doc_id, json_valid(inner_text) AS ok, starts_with(raw, '```') AS fenced,
       CASE WHEN NOT json_valid(inner_text)
            THEN 'parse_fenced_json: failed to parse JSON: ' || substring(inner_text, 1, 200) END AS error
FROM inner_days"""


# JSON rules -------------------------------------------------------------------------

def j_nonempty(x: str, path: str = "$") -> str:
    return (f"coalesce(json_type({x}, '{path}') = 'VARCHAR' AND "
            f"regexp_matches(json_extract_string({x}, '{path}'), '[^{WS}]'), false)")


def j_bi(x: str, path: str) -> str:
    return f"({j_nonempty(x, path + '.ko')} AND {j_nonempty(x, path + '.en')})"


def j_all_nonempty(x: str, path: str) -> str:
    return f"coalesce(list_bool_and(list_transform(json_extract({x}, '{path}[*]'), lambda e: {j_nonempty('e')})), false)"


def j_bilist(x: str, path: str) -> str:
    ko, en = path + ".ko", path + ".en"
    return (f"coalesce(json_type({x}, '{ko}') = 'ARRAY' AND json_type({x}, '{en}') = 'ARRAY' "
            f"AND json_array_length({x}, '{ko}') > 0 AND json_array_length({x}, '{en}') > 0 "
            f"AND json_array_length({x}, '{ko}') = json_array_length({x}, '{en}') "
            f"AND {j_all_nonempty(x, ko)} AND {j_all_nonempty(x, en)}, false)")


def j_objlike(x: str) -> str:
    return f"coalesce(json_type({x}) IN ('OBJECT', 'ARRAY'), false)"


def j_errors(x: str, not_obj: str, pairs) -> str:
    items = ", ".join(f"CASE WHEN NOT ({bad}) THEN {q(msg)} END" for bad, msg in pairs)
    return (f"(CASE WHEN NOT {j_objlike(x)} THEN [{q(not_obj)}] "
            f"ELSE list_filter([{items}], lambda e: e IS NOT NULL) END)")


def j_story(x: str) -> str:
    tags_ok = (f"coalesce(json_type({x}, '$.tags') = 'ARRAY' AND json_array_length({x}, '$.tags') > 0 "
               f"AND {j_all_nonempty(x, '$.tags')}, false)")
    url_ok = f"(NOT coalesce(json_exists({x}, '$.url'), false) OR {j_nonempty(x, '$.url')})"
    return j_errors(x, Dm.MSG_STORY_NOT_OBJECT, [
        (j_nonempty(x, "$.icon"), Dm.MSG_STORY_ICON),
        (j_nonempty(x, "$.status"), Dm.MSG_STORY_STATUS),
        (tags_ok, Dm.MSG_STORY_TAGS),
        (j_bi(x, "$.title"), Dm.MSG_STORY_TITLE),
        (j_bilist(x, "$.facts"), Dm.MSG_STORY_FACTS),
        (j_bi(x, "$.interp"), Dm.MSG_STORY_INTERP),
        (url_ok, Dm.MSG_STORY_URL),
    ])


def j_injury(x: str) -> str:
    watch_ok = (f"(NOT coalesce(json_exists({x}, '$.watch'), false) OR "
                f"coalesce(json_type({x}, '$.watch') = 'BOOLEAN', false))")
    return j_errors(x, Dm.MSG_INJURY_NOT_OBJECT, [
        (j_bi(x, "$.player"), Dm.MSG_INJURY_PLAYER),
        (j_bi(x, "$.issue"), Dm.MSG_INJURY_ISSUE),
        (j_bi(x, "$.status"), Dm.MSG_INJURY_STATUS),
        (watch_ok, Dm.MSG_INJURY_WATCH),
    ])


def j_move(x: str) -> str:
    return j_errors(x, Dm.MSG_MOVE_NOT_OBJECT, [
        (j_nonempty(x, "$.date"), Dm.MSG_MOVE_DATE),
        (j_bi(x, "$.text"), Dm.MSG_MOVE_TEXT),
    ])


def j_sched(x: str) -> str:
    return j_errors(x, Dm.MSG_SCHEDULE_NOT_OBJECT, [
        (j_bi(x, "$.date"), Dm.MSG_SCHEDULE_DATE),
        (j_bi(x, "$.text"), Dm.MSG_SCHEDULE_TEXT),
    ])


J_RULES = {"stories": j_story, "injuries": j_injury, "moves": j_move, "schedule": j_sched}


def j_children(x: str, name: str) -> str:
    rule = J_RULES[name]
    return (f"flatten(list_transform(json_extract({x}, '$.{name}[*]'), lambda el, i: "
            f"list_transform({rule('el')}, lambda m: '{name}[' || (i - 1) || ']: ' || m)))")


def j_day(x: str) -> str:
    date_ok = f"({j_nonempty(x, '$.date')} AND coalesce(regexp_matches(json_extract_string({x}, '$.date'), '{Dm.ISO_DATE_PATTERN}'), false))"
    stories_ok = f"coalesce(json_type({x}, '$.stories') = 'ARRAY' AND json_array_length({x}, '$.stories') > 0, false)"

    def section(name, ok, msg):
        return f"(CASE WHEN {ok} THEN {j_children(x, name)} ELSE [{q(msg)}] END)"

    def is_arr(name):
        return f"coalesce(json_type({x}, '$.{name}') = 'ARRAY', false)"

    head = ", ".join(f"CASE WHEN NOT ({bad}) THEN {q(msg)} END" for bad, msg in [
        (date_ok, Dm.MSG_DAY_DATE), (j_bi(x, "$.dateLabel"), Dm.MSG_DAY_LABEL),
        (j_bi(x, "$.headline"), Dm.MSG_DAY_HEADLINE)])
    rules = (f"list_concat(list_filter([{head}], lambda e: e IS NOT NULL), "
             f"{section('stories', stories_ok, Dm.MSG_DAY_STORIES)}, "
             f"{section('injuries', is_arr('injuries'), Dm.MSG_DAY_INJURIES)}, "
             f"{section('moves', is_arr('moves'), Dm.MSG_DAY_MOVES)}, "
             f"{section('schedule', is_arr('schedule'), Dm.MSG_DAY_SCHEDULE)})")
    return f"(CASE WHEN NOT {j_objlike(x)} THEN [{q(Dm.MSG_DAY_NOT_OBJECT)}] ELSE {rules} END)"


DOCS = with_(RAW_DAYS, PARSED_DAYS)

ALL_DOCS = with_(RAW_DAYS, PARSED_DAYS) + """, all_docs AS (
  SELECT doc_id, CASE WHEN json_valid(inner_text) THEN CAST(inner_text AS JSON) END AS doc,
         'parse_fenced_json: failed to parse JSON: ' || substring(inner_text, 1, 200) AS parse_error FROM inner_days)
"""
CHECKED = ALL_DOCS + f""", checked AS (
  SELECT doc_id, CASE WHEN doc IS NULL THEN [parse_error] ELSE {j_day('doc')} END AS e FROM all_docs)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_errors, array_to_string(e, ' | ') AS errors FROM checked"""

ORACLE["is_nonempty"] = ALL_DOCS + f"""SELECT doc_id, {j_nonempty('doc', '$.date')} AS date_ok,
  {j_nonempty('doc', '$.headline.en')} AS headline_en_ok,
  coalesce(json_type(doc, '$.headline') = 'VARCHAR', false) AS headline_is_text FROM all_docs"""

ORACLE["is_bilingual"] = ALL_DOCS + f"""SELECT doc_id, {j_bi('doc', '$.headline')} AS headline_ok,
  {j_bi('doc', '$.dateLabel')} AS label_ok FROM all_docs"""

ORACLE["is_bilingual_list"] = ALL_DOCS + f"""SELECT doc_id, {j_bilist('doc', '$.stories[0].facts')} AS facts_ok FROM all_docs"""

ORACLE["validate_days"] = CHECKED

ORACLE["quarantine_days"] = CHECKED + " WHERE len(e) > 0"

ORACLE["validate_stories"] = DOCS + f"""SELECT doc_id, CAST(pos - 1 AS BIGINT) AS story_pos,
  array_to_string({j_story('s')}, ' | ') AS errors
FROM (SELECT doc_id, unnest(json_extract(doc, '$.stories[*]')) AS s,
             unnest(generate_series(1, CAST(json_array_length(doc, '$.stories') AS BIGINT))) AS pos
      FROM docs WHERE json_type(doc, '$.stories') = 'ARRAY')"""

ORACLE["validate_rows"] = DOCS + " UNION ALL ".join(
    f"""SELECT doc_id, '{kind}' AS kind, CAST(pos - 1 AS BIGINT) AS pos, array_to_string({J_RULES[kind]('r')}, ' | ') AS errors
FROM (SELECT doc_id, unnest(json_extract(doc, '$.{kind}[*]')) AS r,
             unnest(generate_series(1, CAST(json_array_length(doc, '$.{kind}') AS BIGINT))) AS pos
      FROM docs WHERE json_type(doc, '$.{kind}') = 'ARRAY')
""" for kind in ("injuries", "moves", "schedule"))

ORACLE["valid_days"] = DOCS + f"""SELECT doc_id, json_extract_string(doc, '$.date') AS date
FROM (SELECT doc_id, doc, {j_day('doc')} AS e FROM docs) WHERE len(e) = 0"""

ORACLE["concat_text_blocks"] = """SELECT conv_id,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS text FROM conversations GROUP BY conv_id"""

ORACLE["literal_replace"] = """SELECT doc_id, t AS text, t <> text AS changed FROM (
  SELECT doc_id, text, replace(replace(replace(replace(text,
    'ment ', 'ment' || chr(160)), 'the', 'THE'), 'ción', 'cion'), ' und ', ' & ') AS t
  FROM documents)"""


# an edited document is judged as a raw one of its own
_FIXED = """replace(replace(replace(raw, '"status":"NEW"', '"status":"UPDATE"'), '"en":"en"', '"en":" "'), '해설', '설명')"""
ORACLE["replace_validated"] = with_(RAW_DAYS.replace("raw_days AS (", "given AS (", 1), f"raw_days AS (SELECT doc_id, {_FIXED} AS raw FROM given)",
                                    PARSED_DAYS) + """, all_docs AS (
  SELECT i.doc_id, CASE WHEN json_valid(inner_text) THEN CAST(inner_text AS JSON) END AS doc, i.raw AS fixed, g.raw AS old
  FROM inner_days i JOIN given g ON g.doc_id = i.doc_id),
""" + f"""checked AS (SELECT *, CASE WHEN fixed = old THEN 0 WHEN doc IS NULL THEN 1 ELSE len({j_day('doc')}) END AS n FROM all_docs)
SELECT doc_id, CASE WHEN fixed = old THEN 'unchanged' WHEN n = 0 THEN 'edited' ELSE 'refused' END AS outcome, CAST(n AS BIGINT) AS n_errors,
  sha256(CASE WHEN n = 0 THEN fixed ELSE old END) AS raw_sha256 FROM checked"""

ORACLE["delete_nested"] = DOCS + f""", valid AS (SELECT doc_id, doc FROM (SELECT doc_id, doc, {j_day('doc')} AS e FROM docs) WHERE len(e) = 0),
stories AS (
  SELECT doc_id, pos, contains(json_extract_string(s, '$.title.ko'), '메모') AS gone, CAST(json_extract(s, '$.tags') AS VARCHAR[]) AS tags
  FROM (SELECT doc_id, unnest(json_extract(doc, '$.stories[*]')) AS s, generate_subscripts(json_extract(doc, '$.stories[*]'), 1) AS pos FROM valid)),
moves AS (
  SELECT doc_id, contains(json_extract_string(m, '$.text.ko'), '메모') AS gone
  FROM (SELECT doc_id, unnest(json_extract(doc, '$.moves[*]')) AS m FROM valid)),
counted AS (
  SELECT v.doc_id, (SELECT count(*) FROM stories s WHERE s.doc_id = v.doc_id) AS n, (SELECT count(*) FROM stories s WHERE s.doc_id = v.doc_id AND gone) AS g,
         (SELECT count(*) FROM moves m WHERE m.doc_id = v.doc_id) AS mn, (SELECT count(*) FROM moves m WHERE m.doc_id = v.doc_id AND gone) AS mg FROM valid v),
judged AS (SELECT *, CASE WHEN g + mg = 0 THEN 'unchanged' WHEN g = n THEN 'refused' ELSE 'edited' END AS outcome FROM counted),
tag_list AS (
  SELECT doc_id, string_agg(tag, ',' ORDER BY pos, tp) AS tags FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, tag ORDER BY pos, tp) AS k FROM (
      SELECT s.doc_id, pos, unnest(tags) AS tag, generate_subscripts(tags, 1) AS tp FROM stories s JOIN judged j ON j.doc_id = s.doc_id
      WHERE NOT (gone AND outcome = 'edited'))) WHERE k = 1 GROUP BY doc_id)
SELECT j.doc_id, outcome, CAST(g + mg AS BIGINT) AS n_deleted, CAST(CASE outcome WHEN 'edited' THEN n - g ELSE n END AS BIGINT) AS storyCount,
  CAST(CASE outcome WHEN 'edited' THEN mn - mg ELSE mn END AS BIGINT) AS moveCount, coalesce(tags, '') AS tags
FROM judged j LEFT JOIN tag_list t ON t.doc_id = j.doc_id"""


# --- integrity, upserts ------------------------------------------------------------

def _entry_json(date_expr: str, story_expr: str, move_expr: str, with_headline: str) -> str:
    return f"""'{{' || concat_ws(',',
      '"date":' || CAST(to_json({date_expr}) AS VARCHAR),
      '"dateLabel":' || CAST(json_object('ko', label_ko, 'en', label_en) AS VARCHAR),
      CASE WHEN {with_headline} THEN '"headline":' || CAST(json_object('ko', headline_ko, 'en', headline_en) AS VARCHAR) END,
      '"storyCount":' || {story_expr},
      '"moveCount":' || {move_expr},
      '"tags":' || CAST(to_json(string_split(tags, ',')) AS VARCHAR)) || '}}'"""


EPOCH = "date_diff('day', DATE '1970-01-01', CAST(date AS DATE))"
INDEX_JSON = f"""ix AS (SELECT *, {EPOCH} AS e FROM index),
index_json AS (
  SELECT date AS source_date, {_entry_json("CASE WHEN e % 19 = 0 THEN '' ELSE date END",
                                           "CAST(storyCount + CASE WHEN e % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR)",
                                           "CASE WHEN e % 13 = 0 THEN '\"' || moveCount || '\"' ELSE CAST(moveCount AS VARCHAR) END",
                                           "e % 17 <> 0")} AS entry
  FROM ix WHERE e % 7 <> 0
  UNION ALL
  SELECT date, {_entry_json("strftime(CAST(date AS DATE) + 36500, '%Y-%m-%d')", "CAST(storyCount AS VARCHAR)",
                            "CAST(moveCount AS VARCHAR)", "TRUE")}
  FROM ix WHERE e % 7 <> 0 AND e % 11 = 0),
entries AS (
  SELECT e, json_extract_string(e, '$.date') AS date,
    coalesce(CASE json_type(e, '$.date') WHEN 'VARCHAR' THEN length(json_extract_string(e, '$.date')) > 0
                  WHEN 'BOOLEAN' THEN CAST(json_extract(e, '$.date') AS BOOLEAN)
                  WHEN 'NULL' THEN false WHEN 'OBJECT' THEN true WHEN 'ARRAY' THEN true
                  ELSE TRY_CAST(json_extract_string(e, '$.date') AS DOUBLE) <> 0 END, false) AS has_date,
    CASE WHEN json_type(e, '$.storyCount') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(e, '$.storyCount') AS DOUBLE) END AS storyCount,
    CASE WHEN json_type(e, '$.moveCount') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(e, '$.moveCount') AS DOUBLE) END AS moveCount
  FROM (SELECT CAST(entry AS JSON) AS e FROM index_json)),
store AS (SELECT date, storyCount, moveCount FROM index),
referenced AS (SELECT * FROM entries WHERE has_date),
joined AS (SELECT r.*, s.storyCount AS s_story, s.moveCount AS s_move, s.date IS NOT NULL AS found
           FROM referenced r LEFT JOIN store s ON r.date = s.date),
findings AS (
  {" UNION ALL ".join(f"SELECT 'missing_key' AS rule, date, '{k}' AS detail FROM entries WHERE NOT json_exists(e, '$.{k}')" for k in Dm.INDEX_KEYS)}
  UNION ALL SELECT 'missing_detail', date, '' FROM joined WHERE NOT found
  UNION ALL SELECT 'story_count', date, 'index ' || CAST(CAST(storyCount AS BIGINT) AS VARCHAR) || ' vs day ' || s_story
            FROM joined WHERE found AND storyCount IS NOT NULL AND storyCount <> s_story
  UNION ALL SELECT 'move_count', date, 'index ' || CAST(CAST(moveCount AS BIGINT) AS VARCHAR) || ' vs day ' || s_move
            FROM joined WHERE found AND moveCount IS NOT NULL AND moveCount <> s_move
  UNION ALL SELECT 'orphan', date, '' FROM store WHERE date NOT IN (SELECT date FROM referenced WHERE date IS NOT NULL))"""

INTEG = with_(FULL, INDEX_JSON)

ORACLE["integrity_check"] = INTEG + "SELECT rule, date, detail FROM findings"

ORACLE["integrity_summary"] = INTEG + """
SELECT rule, CAST(count(*) AS BIGINT) AS n FROM findings GROUP BY rule
UNION ALL SELECT 'total', CAST(count(*) AS BIGINT) FROM findings
UNION ALL SELECT 'briefings', CAST(count(*) AS BIGINT) FROM index_json"""

ORACLE["index_detail_join"] = INTEG + """
SELECT r.date, CAST(r.storyCount AS BIGINT) AS index_stories, s.storyCount AS day_stories, s.moveCount AS day_moves
FROM referenced r LEFT JOIN store s ON r.date = s.date"""

ORACLE["orphan_days"] = INTEG + "SELECT date FROM store WHERE date NOT IN (SELECT date FROM referenced WHERE date IS NOT NULL)"

ORACLE["dangling_index"] = INTEG + "SELECT date FROM referenced WHERE date NOT IN (SELECT date FROM store)"

UPD = with_(FULL, f"""index_saved AS (SELECT * FROM index WHERE date <= '{SAVED_THROUGH}'),
updates AS (SELECT * REPLACE (headline_ko || ' (rev)' AS headline_ko, headline_en || ' (rev)' AS headline_en) FROM index)""")

ORACLE["index_upsert"] = UPD + """
SELECT * FROM index_saved WHERE date NOT IN (SELECT date FROM updates) UNION ALL SELECT * FROM updates"""

ORACLE["index_insert_absent"] = UPD + """
SELECT * FROM index_saved UNION ALL SELECT * FROM updates WHERE date NOT IN (SELECT date FROM index_saved)"""

ORACLE["index_replace"] = UPD + """
SELECT *, 'index' AS outcome FROM index_saved WHERE date NOT IN (SELECT date FROM updates)
UNION ALL SELECT *, 'index' FROM updates WHERE date IN (SELECT date FROM index_saved)
UNION ALL SELECT *, 'missing' FROM updates WHERE date NOT IN (SELECT date FROM index_saved)"""

ROW_HASH = "sha256(CAST(json_array(date, label_ko, label_en, headline_ko, headline_en, storyCount, moveCount, tags) AS VARCHAR))"

ORACLE["versioned_upsert"] = UPD + f""",
tokens AS (SELECT date, {ROW_HASH} AS tok FROM index_saved),
upd AS (SELECT u.*, CASE WHEN t.tok IS NULL THEN NULL WHEN date_diff('day', DATE '1970-01-01', CAST(u.date AS DATE)) % 2 = 0 THEN t.tok ELSE 'stale' END AS base_sha,
               t.tok AS cur
        FROM (SELECT * FROM updates UNION ALL
              SELECT * REPLACE (headline_ko || ' (rev 2)' AS headline_ko, headline_en || ' (rev 2)' AS headline_en) FROM index
              WHERE date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) % 3 = 0) u LEFT JOIN tokens t ON u.date = t.date),
valid AS (SELECT *, CASE WHEN cur IS NULL THEN (base_sha IS NULL OR base_sha = '') ELSE base_sha = cur END AS holds FROM upd),
judged AS (SELECT *, holds AND row_number() OVER (PARTITION BY date, holds ORDER BY headline_en) = 1 AS ok FROM valid)
SELECT *, 'index' AS outcome FROM index_saved WHERE date NOT IN (SELECT date FROM judged WHERE ok)
UNION ALL SELECT date, label_ko, label_en, headline_ko, headline_en, storyCount, moveCount, tags, 'index' FROM judged WHERE ok
UNION ALL SELECT date, label_ko, label_en, headline_ko, headline_en, storyCount, moveCount, tags, 'rejected' FROM judged WHERE NOT ok"""

# --- archive queries ---------------------------------------------------------------------

ARCHIVE = """archive AS (
  SELECT doc_id, strftime(DATE '2024-01-01' + CAST(doc_id % 1000 AS INTEGER), '%Y-%m-%d') AS date,
         text AS headline, [upper(lang), upper(source)] AS tags FROM documents)"""

ORACLE["archive_by_tags"] = with_(ARCHIVE) + "SELECT doc_id, date FROM archive WHERE list_has_any(tags, ['DE', 'SRC3'])"
ORACLE["archive_by_all_tags"] = with_(ARCHIVE) + "SELECT doc_id, date FROM archive WHERE list_has_all(tags, ['EN', 'SRC1'])"
ORACLE["archive_search"] = with_(ARCHIVE) + """SELECT doc_id, date FROM archive
WHERE contains(lower(headline || ' ' || array_to_string(tags, ' ')), 'ment')"""

ORACLE["archive_search_indexed"] = with_(ARCHIVE) + """SELECT keyword, doc_id, date FROM archive,
  (SELECT unnest(['Ment', 'EN', 'ünd', 'the ', 'SRC1', 'no such text', 'ción', 'e', chr(10), 'zzz']) AS keyword)
WHERE trim(keyword, ' ' || chr(10)) = '' OR contains(lower(headline || ' ' || array_to_string(tags, ' ')), lower(keyword))"""

SELECTED = with_(ARCHIVE) + """, pairs AS (
  SELECT DISTINCT tags[1] AS a, tags[2] AS b FROM archive UNION SELECT tags[1], tags[1] FROM archive UNION SELECT tags[1], 'NONE' FROM archive),
chosen AS (
  SELECT 'any ' || a || ' ' || b AS selection, doc_id FROM pairs JOIN archive ON list_has_any(tags, [a, b])
  UNION ALL SELECT 'all ' || a || ' ' || b, doc_id FROM pairs JOIN archive ON list_has_all(tags, [a, b]))
"""
ORACLE["archive_tags_bitmap"] = SELECTED + "SELECT selection, doc_id FROM chosen"
ORACLE["archive_tag_counts"] = SELECTED + "SELECT selection, CAST(count(*) AS BIGINT) AS n FROM chosen GROUP BY selection"

ORACLE["archive_by_month"] = with_(FULL) + """SELECT substring(date, 1, 7) AS month, CAST(count(*) AS BIGINT) AS n_days,
  CAST(sum(storyCount) AS BIGINT) AS n_stories, min(date) AS first_date, max(date) AS last_date FROM index GROUP BY 1"""

STORY_TAGS = """story_tags AS (
  SELECT date, l_orderkey, l_linenumber, l_partkey, l_suppkey, tag0, tag1, tag2, [tag0, tag1, tag2] AS tags FROM stories)"""

ORACLE["tag_vocabulary"] = with_(FULL) + """SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT tag0 AS tag FROM stories UNION ALL SELECT tag1 FROM stories UNION ALL SELECT tag2 FROM stories) GROUP BY tag"""

ORACLE["stories_by_tag"] = with_(FULL, STORY_TAGS) + """SELECT date, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM story_tags WHERE list_contains(tags, 'FLAG_R')"""

ORACLE["stories_by_tag_substring"] = with_(FULL, STORY_TAGS) + """SELECT date, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM story_tags WHERE contains(array_to_string(tags, ','), 'K,FLAG_R')"""

ORACLE["day_lookup"] = with_(FULL) + """SELECT date, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM stories WHERE date = '1997-05-28'"""

ORACLE["day_lookup_store"] = ORACLE["day_lookup"]

ORACLE["linked_stories"] = with_(FULL) + f"""SELECT date, CAST(count(*) AS BIGINT) AS n_linked FROM stories
WHERE (l_orderkey + l_linenumber + l_partkey) % 8 <> 0 AND (l_orderkey + l_linenumber + l_partkey) % 4 = 0
GROUP BY date"""

ORACLE["first_seen"] = with_(FULL) + """SELECT date, tag, CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(tp AS BIGINT) AS tag_pos
FROM tagpos"""

DEL = day_store("", None).replace(
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE TRUE",
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT contains('부품 ' || l_partkey, '부품 1')").replace(
    "WHERE o_orderstatus = 'F' AND TRUE", "WHERE o_orderstatus = 'F' AND NOT contains('주문 ' || o_orderkey || ' 완료', '주문 2')")
ORACLE["delete_stories"] = with_(DEL, day_store("_old", None)) + """
SELECT o.date, o.label_ko, o.label_en, o.headline_ko, o.headline_en,
       CASE WHEN n.storyCount > 0 THEN n.storyCount ELSE o.storyCount END AS storyCount,
       CASE WHEN n.storyCount > 0 THEN n.moveCount ELSE o.moveCount END AS moveCount,
       CASE WHEN n.storyCount > 0 THEN n.tags ELSE o.tags END AS tags,
       CASE WHEN n.storyCount > 0 THEN 'edited' ELSE 'refused' END AS outcome
FROM index_old o LEFT JOIN index n ON n.date = o.date"""


# --- schedule ---------------------------------------------------------------------------


GAMES = """g0 AS (
  SELECT CASE WHEN o_custkey % 2 = 0 THEN 'GB' ELSE 'MIN' END AS team, o_orderkey AS pos,
         CASE WHEN o_orderkey % 7 = 0 THEN 'pre' ELSE 'reg' END AS phase,
         CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 3 + 1 ELSE o_orderkey % 18 + 1 END AS INTEGER) AS week,
         make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), o_orderkey % 10 + 12,
                        [0, 15, 25][o_orderkey % 3 + 1], 0) AS et,
         o_orderkey, o_custkey, o_orderstatus, o_orderpriority, c_name
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
g1 AS (
  SELECT *, (phase = 'reg' AND o_orderpriority = '5-LOW' AND o_orderkey % 5 = 0) AS is_bye FROM g0),
g2 AS (
  SELECT *, (phase = 'reg' AND NOT is_bye AND o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 5 = 1) AS is_tbd FROM g1),
g3 AS (
  SELECT *, (phase = 'reg' AND NOT is_bye AND NOT is_tbd AND o_orderpriority = '1-URGENT') AS is_riv,
         NOT is_bye AND NOT is_tbd AS playable FROM g2),
gbase AS (
  SELECT team, pos, phase, week,
         CASE WHEN NOT is_bye THEN c_name END AS opponent,
         CASE WHEN NOT is_bye THEN o_orderstatus = 'O' END AS home,
         CASE WHEN playable THEN strftime(timezone('Asia/Seoul', timezone('America/New_York', et)), '%Y-%m-%dT%H:%M:%S') || '+09:00' END AS dateKST,
         CASE WHEN playable THEN strftime(et, '%-m/%-d (%a) %-I:%M %p') || ' ET' END AS etLabel,
         CASE WHEN playable THEN CASE o_orderkey % 4 WHEN 0 THEN 'FOX' WHEN 1 THEN 'CBS' WHEN 2 THEN '' END END AS bcast,
         CASE WHEN playable AND o_orderstatus = 'F' THEN '종료 ' || (o_orderkey % 40) || '-' || (o_orderkey % 31) END AS final_ko,
         CASE WHEN playable AND o_orderstatus = 'F' THEN 'Final: ' || (o_orderkey % 40) || '-' || (o_orderkey % 31) END AS final_en,
         CASE WHEN is_riv THEN true END AS rivalry, CASE WHEN is_bye THEN true END AS bye, CASE WHEN is_tbd THEN true END AS tbd,
         o_custkey AS season
  FROM g3),
games AS (
  SELECT * FROM gbase
  UNION ALL
  SELECT CASE WHEN team = 'GB' THEN 'MIN' ELSE 'GB' END, pos, phase, week, opponent, NOT home, dateKST, etLabel,
         bcast, final_ko, final_en, rivalry, bye, tbd, season
  FROM gbase WHERE rivalry)"""


def wall_clock(x: str, lang: str) -> str:
    dp, tp = f"split_part({x}, 'T', 1)", f"split_part({x}, 'T', 2)"
    mo, da = f"CAST(split_part({dp}, '-', 2) AS INTEGER)", f"CAST(split_part({dp}, '-', 3) AS INTEGER)"
    days = ["일", "월", "화", "수", "목", "금", "토"] if lang == "ko" else ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
    dow = f"{sql_list(days)}[dayofweek(CAST({dp} AS DATE)) + 1]"
    clock = f"split_part({tp}, ':', 1) || ':' || split_part({tp}, ':', 2)"
    md = f"CAST({mo} AS VARCHAR) || '/' || CAST({da} AS VARCHAR)"
    if lang == "ko":
        return f"({md} || '(' || {dow} || ') ' || {clock})"
    return f"({dow} || ' ' || {md} || ' ' || {clock})"


def week_sql(lang: str, pre: bool) -> str:
    u = LABELS[lang]
    word = f"CASE WHEN phase = 'pre' THEN {q(u['week_pre'])} ELSE {q(u['week_reg'])} END" if pre else q(u["week_reg"])
    return f"({word} || ' ' || CAST(week AS VARCHAR) || {q(u['week_suffix'])})"


def game_cols(lang: str, team: str = "team") -> str:
    u = LABELS[lang]
    return f"""{team} AS team_label, 'game' AS kind, {week_sql(lang, True)} AS week_label,
  CASE WHEN coalesce(tbd, false) THEN {q(u['tbd_date'])} ELSE {wall_clock('dateKST', lang)} END AS when_text,
  CASE WHEN coalesce(tbd, false) THEN {q(u['tbd_note'])} ELSE etLabel END AS sub_text,
  CASE WHEN coalesce(home, false) THEN 'vs' ELSE '@' END || ' ' || coalesce(opponent, '') AS matchup,
  CASE WHEN coalesce(home, false) THEN {q(u['home'])} ELSE {q(u['away'])} END AS home_away,
  CASE WHEN coalesce(bcast, '') <> '' THEN bcast WHEN final_{lang} IS NOT NULL THEN final_{lang} ELSE '' END AS right_text,
  CASE WHEN coalesce(rivalry, false) THEN {q(u['rivalry'])} ELSE '' END AS tag_text"""


def bye_cols(lang: str) -> str:
    u = LABELS[lang]
    return f"""team AS team_label, 'bye' AS kind, {week_sql(lang, False)} AS week_label, {q(u['bye'])} AS when_text,
  '' AS sub_text, '' AS matchup, '' AS home_away, '' AS right_text, '' AS tag_text"""


def rivalry_cols(lang: str) -> str:
    u = LABELS[lang]
    return f"""'' AS team_label, 'rivalry' AS kind, {week_sql(lang, False)} AS week_label,
  {wall_clock('dateKST', lang)} AS when_text, etLabel AS sub_text,
  CASE WHEN coalesce(home, false) THEN 'MIN @ GB' ELSE 'GB @ MIN' END AS matchup,
  {q(u['home_site'][0])} || CASE WHEN coalesce(home, false) THEN {q(HOME_SITES['GB'])} ELSE {q(HOME_SITES['MIN'])} END
    || {q(u['home_site'][1])} AS home_away,
  coalesce(bcast, '') AS right_text, {q(u['rivalry'])} AS tag_text"""


def team_sql(team: str, lang: str) -> str:
    return with_(GAMES) + f"""
SELECT CASE WHEN phase = 'pre' THEN 0 ELSE 1 END AS section, pos, {game_cols(lang)}
FROM games WHERE team = '{team}' AND phase IN ('pre', 'reg') AND NOT coalesce(bye, false)
UNION ALL
SELECT 1, pos, {bye_cols(lang)} FROM games WHERE team = '{team}' AND phase = 'reg' AND coalesce(bye, false)"""


def union_sql(lang: str) -> str:
    rank = "CASE WHEN team = 'GB' THEN 1 ELSE 2 END"
    return with_(GAMES) + f"""
SELECT 0 AS section, dateKST AS date_key, {rank} AS kind_rank, pos, {game_cols(lang)} FROM games WHERE phase = 'pre'
UNION ALL
SELECT 1, dateKST, 0, pos, {rivalry_cols(lang)} FROM games
  WHERE phase = 'reg' AND NOT coalesce(bye, false) AND coalesce(rivalry, false) AND team = 'GB'
UNION ALL
SELECT 1, dateKST, {rank}, pos, {game_cols(lang)} FROM games
  WHERE phase = 'reg' AND NOT coalesce(bye, false) AND NOT coalesce(rivalry, false) AND NOT coalesce(tbd, false)
UNION ALL
SELECT 2, CAST(NULL AS VARCHAR), {rank}, pos, {game_cols(lang)} FROM games
  WHERE phase = 'reg' AND NOT coalesce(bye, false) AND NOT coalesce(rivalry, false) AND coalesce(tbd, false)"""


ORACLE["scan_games"] = with_(GAMES) + "SELECT * EXCLUDE (season) FROM games"
ORACLE["convert_kickoff"] = with_(GAMES) + "SELECT team, pos, dateKST FROM games"
ORACLE["format_wall_clock"] = with_(GAMES) + f"""SELECT team, pos, {wall_clock('dateKST', 'ko')} AS ko,
  {wall_clock('dateKST', 'en')} AS en FROM games"""
ORACLE["pick_language"] = with_(GAMES) + "SELECT team, pos, final_ko AS ko, final_en AS en FROM games"
ORACLE["schedule_team"] = team_sql("GB", "en")
ORACLE["schedule_team_ko"] = team_sql("MIN", "ko")
ORACLE["schedule_union"] = union_sql("en")
ORACLE["schedule_union_ko"] = union_sql("ko")
ORACLE["schedule_union_ordered"] = "SELECT *, CAST(row_number() OVER (ORDER BY section, date_key NULLS FIRST, kind_rank, pos) - 1 AS BIGINT) AS row_no FROM (" + union_sql("en") + ")"
ORACLE["matchup_check"] = with_(GAMES) + """, a AS (SELECT phase, week, dateKST, pos, home AS home_a FROM games WHERE coalesce(rivalry, false) AND team = 'GB'),
b AS (SELECT phase, week, dateKST, pos, home AS home_b FROM games WHERE coalesce(rivalry, false) AND team = 'MIN')
SELECT coalesce(a.phase, b.phase) AS phase, coalesce(a.week, b.week) AS week, coalesce(a.dateKST, b.dateKST) AS dateKST,
       coalesce(a.pos, b.pos) AS pos,
       coalesce(a.pos IS NOT NULL AND b.pos IS NOT NULL AND home_a <> home_b, false) AS consistent
FROM a FULL OUTER JOIN b ON a.phase = b.phase AND a.week = b.week AND a.dateKST = b.dateKST AND a.pos = b.pos"""


# --- interaction events -------------------------------------------------------------------


_NAME_MAP = "CASE event_type WHEN 'view' THEN 'nav_tab' WHEN 'click' THEN 'archive_search' " \
            "WHEN 'signup' THEN 'lang_toggle' WHEN 'purchase' THEN 'schedule_team_tab' ELSE event_type END"
INTERACTIONS = f"""ev0 AS (SELECT *, {_NAME_MAP} AS name FROM events),
interactions AS (
  SELECT CAST(user_id AS VARCHAR) AS "user", event_id AS seq, ts, name,
    CASE WHEN event_id % 20 = 0 THEN NULL
         WHEN event_id % 20 = 1 THEN 3
         ELSE 1 END AS n_keys,
    CASE name WHEN 'nav_tab' THEN 'page' WHEN 'archive_search' THEN 'chars' WHEN 'lang_toggle' THEN 'lang'
              WHEN 'schedule_team_tab' THEN 'team' ELSE 'k' END AS data_key,
    CAST(trunc(value) AS BIGINT) % 20 AS chars, event_id % 2 = 1 AS is_cancel
  FROM ev0)"""

ORACLE["event_usage"] = with_(INTERACTIONS) + """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, name,
  CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT "user") AS BIGINT) AS n_users
FROM interactions GROUP BY 1, 2"""

_ALLOWED = "CASE name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_CATALOGUE.items()) + " END"
ORACLE["event_contract"] = with_(INTERACTIONS) + f""", judged AS (
  SELECT "user", seq, name, {_ALLOWED} AS allowed, n_keys, data_key FROM interactions)
SELECT "user", seq, name, concat_ws(',',
    CASE WHEN allowed IS NULL THEN 'unknown_name' END,
    CASE WHEN allowed IS NOT NULL AND coalesce(n_keys, 0) > 0 AND (data_key <> allowed OR n_keys > 1) THEN 'unknown_key' END,
    CASE WHEN coalesce(n_keys, 0) > 2 THEN 'too_many_keys' END) AS reasons
FROM judged
WHERE allowed IS NULL OR (coalesce(n_keys, 0) > 0 AND (data_key <> allowed OR n_keys > 1)) OR coalesce(n_keys, 0) > 2"""

ORACLE["debounce_search"] = with_(INTERACTIONS) + """, s AS (
  SELECT "user", seq, ts, chars,
         lead(ts) OVER (PARTITION BY "user" ORDER BY ts, seq) AS next_ts
  FROM interactions WHERE name = 'archive_search')
SELECT "user", seq, chars, strftime(ts + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS fire_ts
FROM s WHERE chars > 0 AND (next_ts IS NULL OR next_ts >= ts + INTERVAL 30 MINUTE)"""

ORACLE["hold_detect"] = with_(INTERACTIONS) + """, s AS (
  SELECT "user", seq, ts, is_cancel,
         lead(ts) OVER w AS next_ts,
         first_value(CASE WHEN is_cancel THEN seq END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nc_seq,
         first_value(CASE WHEN is_cancel THEN ts END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nc_ts
  FROM interactions WINDOW w AS (PARTITION BY "user" ORDER BY ts, seq)),
fired AS (SELECT * FROM s WHERE NOT is_cancel AND (next_ts IS NULL OR next_ts >= ts + INTERVAL 10 MINUTE))
SELECT "user", seq, 'start' AS kind, strftime(ts + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS at FROM fired
UNION ALL
SELECT DISTINCT "user", nc_seq, 'end', strftime(nc_ts, '%Y-%m-%d %H:%M:%S.%f') FROM fired WHERE nc_seq IS NOT NULL"""


# --- sources and sinks ------------------------------------------------------------------

ORACLE["scan_day_documents"] = with_(RAW_DAYS, PARSED_DAYS) + f""", v AS (SELECT doc_id, {j_day('doc')} AS e FROM docs)
SELECT i.doc_id, '2026-' || lpad(CAST(i.doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(i.doc_id % 28 + 1 AS VARCHAR), 2, '0') AS date,
       json_valid(i.inner_text) AS ok, CAST(len(v.e) AS BIGINT) AS n_errors
FROM inner_days i LEFT JOIN v ON v.doc_id = i.doc_id"""

ORACLE["write_days"] = with_(FULL) + """SELECT date,
  CAST(CASE WHEN substring(date, 9, 2) = '01' AND sum(keep) > 0 THEN sum(keep) ELSE count(*) END AS BIGINT) AS n_stories
FROM (SELECT date, CASE WHEN contains('부품 ' || l_partkey, '부품 1') THEN 0 ELSE 1 END AS keep FROM stories)
GROUP BY date"""

ORACLE["list_day_files"] = with_(FULL) + "SELECT DISTINCT date FROM stories"

ORACLE["index_roundtrip"] = with_(FULL) + "SELECT * FROM index"

ORACLE["index_array_roundtrip"] = ORACLE["index_roundtrip"]

ORACLE["scan_season"] = with_(GAMES) + """SELECT team, season,
  CAST(row_number() OVER (PARTITION BY team, season ORDER BY pos) - 1 AS BIGINT) AS i,
  phase, week, opponent, home, dateKST, bcast, final_en, rivalry, bye, tbd FROM games"""


# --- ingest job (stub model: one story per article; a failed fetch fails its day) -----------

# the answer of the stub, spelled out: stories joined by ", " inside the day
_URL_JSON = "substring(CAST(to_json(url) AS VARCHAR), 2, length(CAST(to_json(url) AS VARCHAR)) - 2)"
_STORY = f"""'{{{{"icon": "📰", "status": "NEW", "tags": ["NEWS", "' || CASE WHEN starts_with(url, 'http') THEN 'WEB' ELSE 'LOCAL' END
  || '"], "title": {{{{"ko": "기사 ' || {_URL_JSON} || '", "en": "Article ' || {_URL_JSON} || '"}}}}, "facts": {{{{"ko": ["본문 ' || length(text) || '"], "en": ['
  || CASE WHEN contains(text, '[Could not fetch full article body:') THEN '' ELSE '"Body ' || length(text) || '"' END
  || ']}}}}, "interp": {{{{"ko": "요약", "en": "Summary"}}}}, "url": "' || {_URL_JSON} || '"}}}}'""".replace("{{", "{").replace("}}", "}")
_ANSWERS = with_(FEED, BODIES) + f"""SELECT date, CAST(pos // 64 AS BIGINT) AS part,
  CAST(length('```json' || chr(10) || '{{"headline": {{"ko": "' || date || ' 소식", "en": "News of ' || date || '"}}, "stories": ['
    || string_agg({_STORY}, ', ' ORDER BY ordinal) || '], "injuries": [], "moves": [], "schedule": []}}' || chr(10) || '```') AS BIGINT) AS response_chars,
  CAST(NULL AS VARCHAR) AS model_error{{more}}
FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ordinal) - 1 AS pos FROM bodies) GROUP BY date, pos // 64"""
ORACLE["apply_model"] = _ANSWERS.replace("{more}", "")
ORACLE["model_resumed"] = _ANSWERS.replace("{more}", ", CAST(1 AS BIGINT) AS attempt")

ORACLE["run_report"] = with_(FEED) + """SELECT date,
  CASE WHEN sum(CASE WHEN ordinal % 9 = 0 AND ordinal % 28 % 4 = 0 THEN 1 ELSE 0 END) = 0 THEN 'added' ELSE 'error' END AS outcome,
  CAST(sum(CASE WHEN ordinal % 9 = 0 AND ordinal % 28 % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_errors,
  (SELECT CAST(count(*) AS BIGINT) FROM feed) AS checked_articles
FROM feed GROUP BY date"""

# positions count the articles of the date in list order, whatever the part size
ORACLE["ingest_errors"] = with_(FEED) + f"""SELECT date, 'stories[' || pos || ']' AS place,
  'stories[' || pos || ']: ' || {q(Dm.MSG_STORY_FACTS)} AS message
FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ordinal) - 1 AS pos FROM feed) WHERE ordinal % 9 = 0 AND ordinal % 28 % 4 = 0"""

ORACLE["ingest_days"] = with_(FEED, BODIES) + """, good AS (
  SELECT date FROM feed GROUP BY date HAVING sum(CASE WHEN ordinal % 9 = 0 AND ordinal % 28 % 4 = 0 THEN 1 ELSE 0 END) = 0)
SELECT b.date, CAST(row_number() OVER (PARTITION BY b.date ORDER BY ordinal) - 1 AS BIGINT) AS ordinal, '📰' AS icon, 'NEW' AS status,
  CASE WHEN starts_with(url, 'http') THEN 'NEWS,WEB' ELSE 'NEWS,LOCAL' END AS tags, 'Article ' || url AS title_en,
  'Body ' || length(text) AS facts_en, '요약' AS interp_ko, url
FROM bodies b JOIN good ON good.date = b.date"""

ORACLE["ingest_index"] = with_(SAVED, FEED) + """, good AS (
  SELECT date FROM feed GROUP BY date HAVING sum(CASE WHEN ordinal % 9 = 0 AND ordinal % 28 % 4 = 0 THEN 1 ELSE 0 END) = 0),
new AS (
  SELECT f.date, f.date || ' (현지)' AS label_ko, f.date AS label_en,
         f.date || ' 소식' AS headline_ko, 'News of ' || f.date AS headline_en,
         CAST(count(*) AS BIGINT) AS storyCount, CAST(0 AS BIGINT) AS moveCount,
         CASE WHEN bool_or(NOT starts_with(f.url, 'http')) AND bool_or(starts_with(f.url, 'http'))
              THEN 'NEWS,' || CASE WHEN arg_min(starts_with(f.url, 'http'), f.ordinal) THEN 'WEB,LOCAL' ELSE 'LOCAL,WEB' END
              WHEN bool_or(starts_with(f.url, 'http')) THEN 'NEWS,WEB' ELSE 'NEWS,LOCAL' END AS tags
  FROM feed f JOIN good g ON f.date = g.date GROUP BY f.date)
SELECT * FROM index_saved WHERE date NOT IN (SELECT date FROM new) UNION ALL SELECT * FROM new"""


# --- streaming forms (same results as the batch forms) --------------------------------

ORACLE["stream_ingest"] = ORACLE["incremental_index"]
ORACLE["stream_ingest_days"] = ORACLE["ingest_days"]
ORACLE["stream_ingest_index"] = ORACLE["ingest_index"]
ORACLE["stream_debounce"] = ORACLE["debounce_search"]
ORACLE["stream_usage"] = ORACLE["event_usage"]
ORACLE["stream_hold"] = ORACLE["hold_detect"]


ORACLE["detail_checks"] = with_(RAW_DAYS, PARSED_DAYS) + """, files AS (
  SELECT i.doc_id, '2026-' || lpad(CAST(i.doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(i.doc_id % 28 + 1 AS VARCHAR), 2, '0') AS fdate,
         CASE WHEN json_valid(i.inner_text) THEN CAST(i.inner_text AS JSON) END AS doc
  FROM inner_days i)
SELECT 'detail_parse' AS rule, fdate AS date, '' AS detail FROM files WHERE doc IS NULL
""" + "".join(f"""UNION ALL SELECT 'detail_missing_key', fdate, '{k}' FROM files
  WHERE doc IS NOT NULL AND json_type(doc) <> 'NULL' AND NOT json_exists(doc, '$.{k}')
""" for k in Dm.DAY_KEYS) + """UNION ALL SELECT 'detail_date', fdate, '' FROM files
  WHERE doc IS NOT NULL AND json_type(doc) <> 'NULL' AND json_type(doc, '$.date') = 'VARCHAR'
    AND length(json_extract_string(doc, '$.date')) > 0 AND json_extract_string(doc, '$.date') <> fdate"""


ORACLE["usage_sketches"] = with_(INTERACTIONS) + """, spans AS (
  SELECT 'week' AS kind, date_trunc('week', ts) AS start, name, "user" FROM interactions UNION ALL SELECT 'month', date_trunc('month', ts), name, "user" FROM interactions)
SELECT kind, strftime(start, '%Y-%m-%d') AS start, name, CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT "user") AS BIGINT) AS n_users, TRUE AS in_bound
FROM spans GROUP BY kind, start, name"""


# --- maintained summaries: the store as the changes left it, derived at once ----------

_EDITED = day_store("", None)
_EDITED = _EDITED.replace("JOIN orders ON l_orderkey = o_orderkey WHERE TRUE",
                          "JOIN orders ON l_orderkey = o_orderkey WHERE day(o_orderdate) <> 31 AND NOT (day(o_orderdate) = 15 AND l_returnflag = 'R')")
_EDITED = _EDITED.replace("o_orderstatus = 'F' AND TRUE", "o_orderstatus = 'F' AND day(o_orderdate) <> 31")
_EDITED = _EDITED.replace("FROM orders WHERE TRUE GROUP BY 1", "FROM orders WHERE day(o_orderdate) <> 31 GROUP BY 1")
ORACLE["maintained_index"] = with_(_EDITED) + "SELECT * FROM index"
ORACLE["maintained_summaries"] = with_(_EDITED) + """
SELECT 'month' AS kind, substring(date, 1, 7) AS name, CAST(count(*) AS BIGINT) AS n_days, CAST(sum(storyCount) AS BIGINT) AS n_stories,
       min(date) AS first_date, max(date) AS last_date FROM index GROUP BY 2
UNION ALL SELECT 'tag', tag, NULL, CAST(count(*) AS BIGINT), NULL, NULL FROM (
  SELECT tag0 AS tag FROM stories UNION ALL SELECT tag1 FROM stories UNION ALL SELECT tag2 FROM stories) GROUP BY tag"""


# --- flat store of JSON files: the faults follow from the keys -----------------------

STORE = f"""dated AS (SELECT doc_id AS i, text, lang, strftime(DATE '1970-01-01' + CAST(doc_id AS INTEGER), '%Y-%m-%d') AS d,
    strftime(DATE '1970-01-01' + CAST(doc_id + CASE WHEN doc_id % 19 = 6 THEN 1 ELSE 0 END AS INTEGER), '%Y-%m-%d') AS inside FROM documents),
bodies AS (
  SELECT *, '{{"date":"' || inside || '","dateLabel":{{"ko":"' || inside || '","en":"' || inside || '"}},"headline":{{"ko":' || {jstr('lang')}
    || ',"en":' || {jstr('text')} || '}},"stories":' || CASE WHEN i % 23 = 7 THEN '"none"' ELSE '[' || left('{{}},{{}},{{}}', greatest(3 * (i % 4) - 1, 0)::INT) || ']' END
    || CASE WHEN i % 31 = 9 THEN '' ELSE ',"injuries":[]' END || ',"moves":[' || left('0,0', greatest(2 * (i % 3) - 1, 0)::INT) || '],"schedule":[]}}' AS b
  FROM dated),
files AS (
  SELECT *, CASE WHEN i % 53 = 17 THEN 'null' WHEN i % 37 = 10 THEN substring(b, 1, length(b) - 1) ELSE b END AS content
  FROM bodies WHERE i % 41 <> 11)"""

ORACLE["scan_json_store"] = with_(STORE) + """SELECT d || '.json' AS file, d AS stem, CAST(strlen(content) AS BIGINT) AS size,
  i % 53 = 17 OR i % 37 <> 10 AS parses, CASE WHEN i % 53 <> 17 AND i % 37 <> 10 THEN inside END AS label_en, CAST(NULL AS VARCHAR) AS error FROM files"""

ORACLE["list_json_store"] = with_(STORE) + "SELECT d || '.json' AS file, d AS stem, CAST(strlen(content) AS BIGINT) AS size FROM files"

ORACLE["integrity_report"] = with_(STORE) + """, entries AS (
  SELECT *, i % 61 <> 14 AND i % 47 <> 13 AS refers, CASE WHEN i % 61 = 14 THEN NULL WHEN i % 47 = 13 THEN '' ELSE d END AS shown,
         CASE WHEN i % 71 = 15 THEN 2 ELSE 1 END AS n, i % 4 + CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END AS story_count,
         i % 3 + CASE WHEN i % 29 = 4 THEN 1 ELSE 0 END AS move_count FROM dated WHERE i % 43 <> 12),
joined AS (SELECT *, i % 53 <> 17 AND i % 37 <> 10 AS judged FROM entries WHERE refers AND i % 41 <> 11),
faults AS (
  SELECT 'missing_key' AS rule, shown AS date, 'headline' AS detail, n FROM entries WHERE i % 17 = 3
  UNION ALL SELECT 'missing_key', shown, 'date', n FROM entries WHERE i % 61 = 14
  UNION ALL SELECT 'missing_detail', d, '', n FROM entries WHERE refers AND i % 41 = 11
  UNION ALL SELECT 'detail_parse', d, '', n FROM joined WHERE i % 37 = 10 AND i % 53 <> 17
  UNION ALL SELECT 'detail_missing_key', d, 'injuries', n FROM joined WHERE judged AND i % 31 = 9
  UNION ALL SELECT 'detail_date', d, inside, n FROM joined WHERE judged AND i % 19 = 6
  UNION ALL SELECT 'story_count', d, 'index ' || story_count || ' vs day ' || (i % 4), n FROM joined WHERE judged AND i % 23 <> 7 AND story_count <> i % 4
  UNION ALL SELECT 'move_count', d, 'index ' || move_count || ' vs day ' || (i % 3), n FROM joined WHERE judged AND i % 13 <> 0 AND move_count <> i % 3
  UNION ALL SELECT 'orphan', d, '', 1 FROM dated WHERE i % 41 <> 11 AND (i % 43 = 12 OR i % 61 = 14 OR i % 47 = 13))
SELECT rule, date, detail, CAST(sum(n) AS BIGINT) AS n FROM faults GROUP BY ALL"""


# --- commits ------------------------------------------------------------------------

ORACLE["commit_log"] = f"""SELECT {iso('o_orderdate')} AS date, count(*) AS n_orders,
  sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS total_cents FROM orders GROUP BY 1"""

ORACLE["commit_history"] = f"""WITH given AS (
  SELECT {iso('o_orderdate')} AS date, CASE WHEN o_custkey % 2 = 1 THEN 'A' ELSE 'B' END AS writer, o_orderkey % 3 AS k,
         month(o_orderdate) % 2 = 1 AS odd FROM orders),
steps AS (SELECT date, writer, CASE WHEN k = 0 THEN 0 WHEN k = 1 AND odd = (writer = 'A') THEN 1 ELSE 2 END AS step FROM given)
SELECT CAST(2 * step + CASE writer WHEN 'A' THEN 1 ELSE 2 END AS BIGINT) AS version, writer, CAST(step AS BIGINT) AS step,
       CAST(CASE WHEN writer = 'B' AND step <> 1 THEN 2 ELSE 1 END AS BIGINT) AS attempts,
       writer = 'B' AND step = 1 AS moved_up, count(DISTINCT date) AS n_dates
FROM steps GROUP BY writer, step"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
