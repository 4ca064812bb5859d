"""HTML stripping, cuts, base64, put records, fenced JSON, text blocks, prompts."""

import json

from pyspark.sql import functions as F

from pressroll.functions import strings as S


def single(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("o")).first()["o"]


def test_strip_html_drops_script_style_comments_keeps_tags(spark):
    html = ("<html><HEAD><Script type='x'>var a = '</p>';\n</SCRIPT><style>p{}</style></head>"
            "<body><!-- hidden\n comment --><p>Hello\n\t  <b>world</b></p>  </body></html>")
    assert single(spark, S.strip_html, html) == "<html><HEAD> </head><body> <p>Hello <b>world</b></p> </body></html>"


def test_strip_html_large_script(spark):
    html = "<p>a</p><script>" + ("x" * 2_000_000) + "</script><p>b</p>"
    assert single(spark, S.strip_html, html) == "<p>a</p> <p>b</p>"


def test_truncate_counts_code_points(spark):
    assert single(spark, lambda c: S.truncate(c, 3), "😀é漢字") == "😀é漢"


def test_base64_round_trip(spark):
    for text in ["hello", "안녕하세요 🏈 " * 40]:
        enc = single(spark, S.b64encode, text)
        assert "\n" not in enc and "\r" not in enc
        assert single(spark, S.b64decode, enc) == text


def test_put_record_sha_only_when_given(spark):
    df = spark.createDataFrame([("x", "m", None), ("x", "m", ""), ("x", "m", "abc")], "c string, m string, s string")
    bodies = [json.loads(r[0]) for r in df.select(S.put_record(F.col("c"), F.col("m"), F.col("s"))).collect()]
    assert [sorted(b) for b in bodies] == [["content", "message"], ["content", "message"],
                                          ["content", "message", "sha"]]
    assert bodies[2]["sha"] == "abc" and bodies[0]["content"] == "eA=="


def parse(spark, text):
    r = spark.createDataFrame([(text,)], "v string").select(S.parse_fenced_json(F.col("v")).alias("p")).first()["p"]
    return (None if r["value"] is None else json.loads(r["value"].toJson())), r["error"]


def test_fenced_json_forms(spark):
    assert parse(spark, '{"a": 1}') == ({"a": 1}, None)
    assert parse(spark, '```json\n{"a": 1}\n```') == ({"a": 1}, None)
    assert parse(spark, '```\n[1, 2]\n```') == ([1, 2], None)
    assert parse(spark, '  \n {"a": [true]} \n ') == ({"a": [True]}, None)


def test_fenced_json_errors(spark):
    value, err = parse(spark, "not json at all")
    assert value is None and "not json at all" in err
    value, err = parse(spark, None)
    assert value is None and "expected a string" in err
    value, err = parse(spark, "x" * 500)
    assert err.endswith("x" * 200) and not err.endswith("x" * 201)


def test_duplicate_keys_last_wins(spark):
    assert parse(spark, '{"a": 1, "a": 2}') == ({"a": 2}, None)


def test_concat_text_blocks(spark):
    df = spark.createDataFrame(
        [([("text", "hello "), ("tool_use", "x"), ("text", "world")],), (None,), ([],)],
        "c array<struct<type:string,text:string>>")
    assert [r[0] for r in df.select(S.concat_text_blocks(F.col("c"))).collect()] == ["hello world", "", ""]


def test_day_prompt_asks_for_english_first_and_known_statuses(spark):
    text = spark.range(1).select(S.organize_prompt(F.lit("2026-01-01"), F.lit("x")).alias("p")).first()["p"]
    assert all(status in text for status in ("NEW", "UPDATE", "CONFIRMED", "RUMOR", "UPCOMING"))
    assert "en text first" in text


def test_prompts_carry_text_and_contract(spark):
    df = spark.createDataFrame([("2031-05-06", "URL: /a\nTitle\n\nBody")], "d string, t string")
    r = df.select(S.extract_prompt(F.col("t")).alias("e"), S.organize_prompt(F.col("d"), F.col("t")).alias("o")).first()
    assert "URL: /a" in r["e"] and "publishedRaw" in r["e"]
    assert "2031-05-06" in r["o"] and "URL: /a" in r["o"]
    for section in S.ORGANIZE_SECTIONS:
        assert f'"{section}"' in r["o"]


def test_literal_replace_is_literal(spark):
    out = single(spark, lambda c: S.literal_replace(c, [("a.c", "X"), ("$1 fee", "\\\\ fee")]), "abc a.c $1 fee")
    assert out == "abc X \\\\ fee"
