"""Scalars, against the values that each has to give."""

import hashlib

import pytest
from pyspark.sql import functions as F

from folioforge.functions import cost, hashing, payload
from folioforge.functions import text as T


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return row.select(column().alias("x")).first().x


@pytest.mark.parametrize(("text", "tokens"), [("", 0), ("abc", 2), ("漢字", 2), ("漢字abcde", 4), ("한글ｱ", 3), ("𠮷", 1)])
def test_est_tokens(spark, text, tokens):
    assert one(spark, lambda: T.est_tokens(F.col("a")), a=text) == tokens


@pytest.mark.parametrize(
    ("text", "plain", "tokens"),
    [("a ⟦1⟧b⟦/1⟧ ⟦C2⟧", "a b ", ["1", "/1", "C2"]), ("一⟦1⟧紅⟦/1⟧車⟦C2⟧", "一紅車", ["1", "/1", "C2"]), ("x⟦unclosed", "x", []), ("a⟧b", "ab", []), ("⟦⟧", "", [""])],
)
def test_placeholders(spark, text, plain, tokens):
    assert one(spark, lambda: T.strip_tokens(F.col("a")), a=text) == plain
    assert one(spark, lambda: T.placeholder_tokens(F.col("a")), a=text) == tokens


def test_same_placeholders(spark):
    same = lambda a, b: one(spark, lambda: T.same_placeholders(F.col("a"), F.col("b")), a=a, b=b)
    assert same("⟦1⟧x⟦/1⟧", "y⟦/1⟧z⟦1⟧") and not same("⟦1⟧", "⟦1⟧⟦1⟧")


def test_restore(spark):
    m = F.create_map(F.lit("1"), F.lit("<b>"), F.lit("/1"), F.lit("</b>"))
    assert one(spark, lambda: T.restore(F.col("a"), m), a="一⟦1⟧紅⟦/1⟧車") == "一<b>紅</b>車"
    assert one(spark, lambda: T.restore(F.col("a"), m), a="⟦9⟧x⟦tail") == "⟦9⟧x"


def test_visible(spark):
    assert not one(spark, lambda: T.has_visible_text(F.col("a")), a=" ⟦C1⟧　⟧") and one(spark, lambda: T.has_visible_text(F.col("a")), a="⟦1⟧x⟦/1⟧")


def test_trim_is_unicode(spark):
    assert one(spark, lambda: T.utrim(F.col("a")), a="　\u0085a \n") == "a"


def test_css(spark):
    assert one(spark, lambda: T.with_css(F.col("a"), "S"), a="<HEAD></HEAD>x</head>") == "<HEAD>S</HEAD>x</head>"
    assert one(spark, lambda: T.with_css(F.col("a"), "S"), a="none") == "none"


@pytest.mark.parametrize(("label", "slug"), [("繁體中文", "繁體中文"), ("a/b ..c", "ab-c"), (" - x_ ", "x"), ("!!", "translated"), ("en US", "en-US"), ("a - b", "a--b")])
def test_slug(spark, label, slug):
    assert one(spark, lambda: T.file_slug(F.col("a")), a=label) == slug


def test_signature_and_keys(spark):
    assert hashing.cache_signature("繁體中文", "Sentence", "", "mock", "Mock").startswith("3cc51ff0")
    assert one(spark, lambda: hashing.cache_key(F.col("a"), F.lit("sig")), a="ü") == hashlib.sha256("sig\0ü".encode()).hexdigest()
    assert one(spark, lambda: hashing.note_key(F.lit("h"), F.lit(3), F.col("a"), F.lit("s")), a="x") == hashlib.sha256(b"s\0note\0h\x003\0x").hexdigest()
    assert hashing.meta_key("anno_plan", "s") == "anno_plan_s"
    with pytest.raises(ValueError):
        hashing.meta_key("other", "s")


def test_note_values(spark):
    assert one(spark, lambda: hashing.encoded_note(F.lit("before"), F.col("a")), a="x") == '{"pos":"before","text":"x"}'
    assert one(spark, lambda: hashing.encoded_note(F.lit("before"), F.col("a")), a=" ") == ""


@pytest.mark.parametrize(("density", "n", "cap"), [("sparse", 5, 1), ("sparse", 48, 2), ("medium", 5, 1), ("medium", 24, 2), ("rich", 5, 2), ("rich", 30, 5), ("rich", 500, 12)])
def test_note_cap(spark, density, n, cap):
    assert one(spark, lambda: cost.note_cap(density, F.col("a")), a=n) == cap


def test_quota(spark):
    q = lambda c, w, t: one(spark, lambda: cost.window_quota(F.col("c"), F.col("w"), F.col("t")), c=c, w=w, t=t)
    assert (q(5, 10, 30), q(0, 5, 10), q(3, 0, 0), q(2, 30, 30)) == (2, 1, 0, 2)


def test_prices(spark):
    usd = lambda m: one(spark, lambda: cost.cost_usd(F.col("m"), F.lit(10**6), F.lit(10**6)), m=m)
    assert usd("gpt-4o-mini") == 0.75 and usd("gpt-4o-2024") == 12.5 and usd("unknown") == 0 and usd("gpt-5.4-nano") == 1.45


@pytest.mark.parametrize(("text", "found"), [("x [1, [2]] y]", "[1, [2]]"), ('["]"]', '["]"]'), (r'["\"]"] z', r'["\"]"]'), ("[", None), ("none", None), (None, None)])
def test_first_array(text, found):
    assert payload.first_array(text) == found


def test_json_object(spark):
    assert one(spark, lambda: payload.json_object(F.col("a")), a='x {"a":{}} } y') == '{"a":{}} }'
    assert one(spark, lambda: payload.json_object(F.col("a")), a="none") is None


def test_plan_sample(spark):
    assert one(spark, lambda: T.plan_sample(F.col("a")), a="x" * 500) == "x" * 500
    got = one(spark, lambda: T.plan_sample(F.col("a")), a="h" * 900 + "m" * 1100)
    assert got == "h" * 900 + T.SAMPLE_JOIN + "m" * 400


def test_busy(spark):
    assert one(spark, lambda: T.is_busy(F.col("a")), a="HTTP 429 Too Many Requests") and not one(spark, lambda: T.is_busy(F.col("a")), a="used 429 tokens")
