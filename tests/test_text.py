import string
import unicodedata
import urllib.parse

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from echoscore import constants as K
from echoscore.functions import text as T



@pytest.mark.parametrize(
    "raw, expected",
    [
        ("  Hello,   World! ", "hello world"),
        ("10-60", "1060"),
        ("a\nb", "a\nb"),
        ("a \n b", "a b"),
        ("\t x 　", "x"),
        ("...", ""),
        (None, ""),
        ("ΟΔΟΣ", "οδος".replace("σ", "σ")[:-1] + "ς"),
        ("क़", "क़"),
        ("क़", "क़"),
        ("你好,世界。", "你好世界"),
        ("𝒳 — y", "𝒳  y"),
        ("a؝⹓b", "ab"),
    ],
)
def test_normalize(one, raw, expected):
    assert one(T.normalize(F.col("s").cast("string")), s=raw) == expected


def test_white_space_is_the_one_of_str_strip(spark):
    spaces = [chr(i) for i in range(1, 0x10000) if chr(i).isspace()]
    others = [c for c in ("a", "​", "﻿", "\x08") ]
    rows = spark.createDataFrame([(c, c + "x" + c) for c in spaces + others], "c string, s string")
    got = {r.c: r.x for r in rows.select("c", T.strip(F.col("s")).alias("x")).collect()}
    assert all(got[c] == "x" for c in spaces)
    assert all(got[c] == c + "x" + c for c in others)
    runs = rows.select("c", T.collapse_spaces(F.concat(F.lit("a"), "c", "c", F.lit("b"))).alias("x")).collect()
    assert all((r.x == "a b") == (r.c in spaces) for r in runs)


def test_punctuation_is_unicode_category_p(spark):
    marks = [chr(i) for i in range(1, 0x110000) if unicodedata.category(chr(i)).startswith("P")]
    kept = list(string.ascii_letters + string.digits + "+$^~|<>=` ")
    rows = spark.createDataFrame([(c,) for c in marks + kept], "c string")
    got = {r.c: r.x for r in rows.select("c", T.remove_punctuation(F.col("c")).alias("x")).collect()}
    assert [c for c in marks if got[c]] == []
    assert [c for c in kept if got[c] != c] == []


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("hi [EOT]", "hi"), ("[EOT]", ""), ("a[EOT]b [EOT]", "ab"), (None, ""), (" x ", "x"),
    ],
)
def test_remove_end_mark(one, raw, expected):
    assert one(T.remove_end_mark(F.col("s").cast("string")), s=raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("```json\n[1]\n```", "[1]"), ("```[1]```", "[1]"), (" [1] ", "[1]"), ("```json\n[1]", "[1]"),
        ("[1]\n```", "[1]"), ("```", ""), ("`````", "``"), ("```\njson```", "json"),
    ],
)
def test_strip_fence(one, raw, expected):
    assert one(T.strip_fence(F.col("s")), s=raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("a ```text\nold\n``` b ```prompt\n new \nline\n``` c", "new \nline"),
        ("x\n```\nplain\n```", "plain"),
        ("1. no\n3. **Optimized Prompt Proposal**\n body text ", "body text"),
        ("3. **Optimized Prompt Proposal** x\n```python\ncode\n```\n", "code"),
        ("  just text ", "just text"),
        ("```prompt\nunclosed", "```prompt\nunclosed"),
    ],
)
def test_extract_prompt(one, raw, expected):
    assert one(T.extract_prompt(F.col("s")), s=raw) == expected


@pytest.mark.parametrize(
    "raw, expected", [("prompt_v2.txt", 2), ("prompt_v13_en_us.txt", 13), ("none", 0), (None, 0), ("", 0), ("v", 0)]
)
def test_version_number(one, raw, expected):
    assert one(T.version_number(F.col("s").cast("string")), s=raw) == expected


@pytest.mark.parametrize(
    "raw, expected", [("prompt_v2.txt", "prompt_v2"), ("", "default"), (None, "default"), ("x", "x")]
)
def test_version_label(one, raw, expected):
    assert one(T.version_label(F.col("s").cast("string")), s=raw) == expected


@pytest.mark.parametrize(
    "path, version, expected",
    [
        ("/r/e_prompt_v2.csv", "prompt_v2.txt", "/r/e_prompt_v2.csv"),
        ("/r/e_prompt_v3_en_silence.csv", "prompt_v3_en.txt", "/r/e_prompt_v3_en.csv"),
        ("/r/e.csv", "prompt_v2.txt", "/r/e_prompt_v2.csv"),
        ("/r/e_mine.csv", "mine.txt", "/r/e_mine.csv"),
        ("/r/e.csv", None, "/r/e.csv"),
        ("/r/e.csv", "", "/r/e.csv"),
        ("/r/e.json", "prompt_v2.txt", "/r/e.json"),
        (None, "prompt_v2.txt", None),
    ],
)
def test_result_path(one, path, version, expected):
    got = one(T.result_path(F.col("p").cast("string"), F.col("v").cast("string")), p=path, v=version)
    assert got == expected


def test_fill_template_is_sequential_and_leaves_other_braces(one):
    filled = T.fill_template(F.lit("{a} {b} {x}"), {"{a}": F.lit("<{b}>"), "{b}": F.lit("2"), "{c}": F.lit("3")})
    assert one(filled) == "<2> 2 {x}"


def test_numbers(one):
    assert one(T.number_or_zero(F.col("s")), s="0.5") == 0.5
    assert one(T.number_or_zero(F.col("s")), s="n/a") == 0.0
    assert one(T.number_or_null(F.col("s")), s="NaN") is None
    assert one(T.number_or_null(F.col("s")), s="") is None


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab /+%~*.-_(é世'\"&=", max_size=12))
def test_url_quote_and_back(one, path):
    quoted = urllib.parse.quote(path)
    assert one(T.url_quote(F.col("s")), s=path) == quoted
    assert one(T.url_unquote(F.col("s")), s=quoted) == path


def test_url_unquote_keeps_plus_and_loose_percent(one):
    assert one(T.url_unquote(F.col("s")), s="a+b%20c%zz%") == "a+b c%zz%"


def test_html_escape_takes_the_ampersand_first(one):
    assert one(T.html_escape(F.col("s")), s="<a&b> &lt;") == "&lt;a&amp;b&gt; &amp;lt;"


def test_paths(one):
    assert one(T.basename(F.col("s")), s="/a/b.c/d.txt") == "d.txt"
    assert one(T.drop_extension(F.col("s")), s="prompt_v3.1.txt") == "prompt_v3.1"
    assert one(T.drop_extension(F.col("s")), s="noext") == "noext"
    assert one(T.absolute_path(F.col("s"), "/base/"), s="x/y") == "/base/x/y"
    assert one(T.absolute_path(F.col("s"), "/base"), s="/x/y") == "/x/y"
    assert one(T.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("z"))) == "z"
    assert one(T.percent(F.lit(0.12345))) == "12.35%"


def test_words(one):
    assert one(T.words(F.col("s")), s=" a  b\n\nc ") == ["a", "b", "c"]
    assert one(T.words(F.col("s")), s="") == []
    assert one(T.words(F.col("s"), "|"), s="a|b||c") == ["a", "b", "c"]


def test_constants_are_consistent():
    assert len(K.LANGUAGES) == 9 and len(K.CONFIGS) == 3
    assert K.CRITIC_PROMPT.count("{error_cases_text}") == 1
