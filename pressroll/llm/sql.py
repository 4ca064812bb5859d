"""The training-data queries restated in SQL (DuckDB), where SQL can say them."""

from __future__ import annotations

#: Words of a text (white space: the space and the characters 9 to 13), and A-Z to lower case.
_BLANK = r"'[\x20\x09-\x0D]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), {_BLANK}), lambda x: x <> '')"


#: Distinct shingles of five words; fewer words are one shingle.
_SHINGLES = """
  SELECT DISTINCT id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle
  FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM {split} WHERE len(words) > 0)
"""

OP1 = f"""
WITH RECURSIVE split AS (SELECT doc_id AS id, {_words(_LOWER)} AS words FROM documents),
shingles AS ({_SHINGLES.format(split="split")}),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
shared AS (
  SELECT a.id AS a, b.id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.id <> b.id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.id JOIN sizes y ON b = y.id WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes ON sizes.id = doc_id JOIN least ON least.id = doc_id
"""

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
OP5 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
placed AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
sized AS (
  SELECT *, length({_ESCAPED.format("text")}) + CASE WHEN k = 1 OR role <> before
    THEN length('<|turn|>') + length({_ESCAPED.format("role")}) + length('<|text|>') + length('<|end|>') ELSE length('<|next|>') END AS chars
  FROM placed)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP6 = f"""
WITH docs AS (SELECT doc_id AS id, {_words("lower(text)")} AS words FROM documents),
items AS (SELECT item_id AS id, {_words("lower(text)")} AS words FROM benchmark),
lengths AS (SELECT DISTINCT least(len(words), 5) AS k FROM items WHERE len(words) > 0),
a AS (
  SELECT DISTINCT id, array_to_string(list_slice(words, i, i + k - 1), ' ') AS shingle
  FROM (SELECT id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM docs JOIN lengths ON len(words) >= k)),
b AS ({_SHINGLES.format(split="items")}),
sizes AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT a.id AS doc_id, b.id AS item_id, count(*)::BIGINT AS n_shared, any_value(sizes.n)::BIGINT AS n_item
FROM a JOIN b ON a.shingle = b.shingle JOIN sizes ON sizes.id = b.id
GROUP BY a.id, b.id HAVING 100 * count(*) >= 75 * any_value(sizes.n)
"""

OP10 = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, {_words("text")} AS words FROM documents),
repeats AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM docs)) WHERE n > 1) GROUP BY doc_id),
cut AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM docs),
lines AS (SELECT doc_id, source, line, {_words("line")} AS lw,
  array_to_string({_words(_LOWER.replace("text", "line"))}, ' ') AS norm FROM cut),
full_lines AS (SELECT * FROM lines WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
frequent AS (SELECT source, norm FROM full_lines GROUP BY source, norm HAVING count(DISTINCT doc_id) > 10),
removed AS (SELECT l.doc_id, sum(len(lw)) AS n FROM full_lines l JOIN frequent f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY l.doc_id),
figures AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS removed_words
  FROM docs LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - removed_words >= 50 AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words
FROM judged
"""

#: Bytes as hex digits, so that a string of 50 bytes is a substring of 100.
OP7 = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM docs)),
first AS (SELECT s, min(doc_id) AS m FROM strings GROUP BY s),
hits AS (SELECT doc_id, p FROM strings JOIN first USING (s) WHERE m < doc_id),
marked AS (SELECT *, CASE WHEN p <= lag(p) OVER w + 50 THEN 0 ELSE 1 END AS new FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, k),
edges AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n, n FROM docs),
gaps AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS from_ FROM edges),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS h FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
totals AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(kept.h)) AS kept_sha256
FROM docs JOIN kept USING (doc_id) LEFT JOIN totals USING (doc_id)
"""

def _crc32(text: str) -> str:
    """Unsigned crc32 of a text's bytes; the query joins ``crc_table``."""
    code = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    step = "xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce([4294967295::BIGINT] || {code}, lambda c, b: {step}), 4294967295::BIGINT)"


_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || list_transform(range(8), lambda k: 0::BIGINT),
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc_t)"""

#: Base32 by the 160 bits of a SHA-1.
OP11 = """
WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, min(page_id) AS m FROM rows GROUP BY h),
bits AS (SELECT h, m, unhex(h)::BIT::VARCHAR AS b FROM first),
digests AS (
  SELECT h, m, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT
    + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest FROM bits)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to
FROM rows JOIN digests USING (h)
"""

OP12 = f"""
WITH {_CRC_TABLE},
docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
items AS (SELECT list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
a AS (SELECT doc_id, unnest(words) AS w FROM docs), b AS (SELECT unnest(words) AS w FROM items),
vocabulary AS (SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT w FROM a UNION SELECT w FROM b), crc_table),
s AS (SELECT bucket, count(*) AS s FROM a JOIN vocabulary USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN vocabulary USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
sums AS (SELECT doc_id, sum(gain) AS g FROM a JOIN vocabulary USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
weighed AS (
  SELECT doc_id, len(words)::BIGINT AS n_features,
    CASE WHEN len(words) = 0 THEN 0 ELSE floor(g::DOUBLE / len(words)) END::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM docs LEFT JOIN sums USING (doc_id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
  count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""

#: Windows of nine words that come again q words later, as islands for each q:
#: the run of that period spans an island, the window and the period.
OP13 = f"""
WITH {_CRC_TABLE},
given AS (SELECT doc_id, {_words("text")} AS ws, {_crc32("doc_id::VARCHAR")} AS h FROM documents, crc_table),
cut AS (SELECT doc_id, ws, h, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM given),
planted AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN ws
    ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) END AS ws
  FROM cut),
windows AS (SELECT doc_id, n, i, hash(list_slice(ws, i + 1, i + 9)) AS g FROM (SELECT doc_id, n, ws, unnest(range(0, n - 8)) AS i FROM planted)),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k, i FROM pairs),
stretch AS (SELECT doc_id, q AS period, min(i) AS start, max(i) - min(i) + 9 + q AS length FROM islands GROUP BY doc_id, q, k),
long AS (SELECT * FROM stretch WHERE length >= 24 AND length >= 3 * period),
runs AS (
  SELECT * FROM long l WHERE NOT EXISTS (
    SELECT 1 FROM long o WHERE o.doc_id = l.doc_id AND o.period < l.period AND o.start <= l.start AND o.start + o.length >= l.start + l.length)),
digests AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM runs GROUP BY doc_id),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM runs),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(0, n)) AS i FROM planted WHERE doc_id IN (SELECT doc_id FROM runs)) w
  ANTI JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i GROUP BY w.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
  sha256(CASE WHEN n_runs IS NULL THEN array_to_string(ws, ' ') ELSE kept.text END) AS collapsed_sha256
FROM planted p LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT * FROM ordered WHERE place = 1) best USING (doc_id)
"""

SQL = {"op7_repeated_strings": OP7, "op1_minhash_dedup": OP1, "op5_chat_format": OP5, "op6_decontamination": OP6, "op10_quality_rules": OP10,
       "op11_warc_zip": OP11, "op12_resampling": OP12, "op13_periodic_runs": OP13}
