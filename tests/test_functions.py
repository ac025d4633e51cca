import hashlib

import pytest
from pyspark.sql import functions as F

from queuelens import functions as fn
from queuelens.functions import sqltext

C = F.col


def one(spark, value, expression, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression(C("x"))).first()[0]


@pytest.mark.parametrize("json_value, expected", [
    ("true", True), ('"true"', True), ('"True"', True), ('"1"', True), ("1", True), ('"yes"', True),
    ('"sim"', True), ('" S "', True), ("false", False), ('"false"', False), ('"0"', False), ("0", False),
    ("null", False), ('""', False), ('"random"', False), ("2.5", True), ("{}", False), ('{"a":1}', True), ("[]", False)])
def test_truthy_variant(spark, json_value, expected):
    df = spark.createDataFrame([(json_value,)], "j string").select(F.try_parse_json("j").alias("v"))
    assert df.select(F.expr(sqltext.truthy_variant("v"))).first()[0] is expected


@pytest.mark.parametrize("value, expected", [
    ("1700000000000", "14/11/2023 22:13:20"), (None, ""), ("", ""), ("invalid", ""), ("{}", ""), ("0", ""),
    ("99999999999999999", "")])
def test_epoch_text_forms_agree(spark, value, expected):
    df = spark.createDataFrame([(value,)], "x string")
    row = df.select(fn.epoch_text(C("x")), F.expr(sqltext.epoch_text("x"))).first()
    assert tuple(row) == (expected, expected)


def test_identity_hash(spark):
    want = hashlib.sha256("maria silvasalt".encode()).hexdigest()
    df = spark.createDataFrame([("  Maria Silva\t", "salt"), (None, "salt"), ("", "salt")], "x string, s string")
    rows = df.select(fn.hash_identity(C("x"), "salt"), F.expr(sqltext.hash_identity("x", "s"))).collect()
    assert [tuple(r) for r in rows] == [(want, want), ("", ""), ("", "")]


def test_raw_hash_keeps_missing(spark):
    assert one(spark, "", lambda c: fn.hash_raw(c, "s")) is None
    assert one(spark, "a", lambda c: fn.hash_raw(c, "s")) == hashlib.sha256(b"as").hexdigest()


@pytest.mark.parametrize("term, pattern", [
    ("cardio*", "cardio%"), ("*urgia", "%urgia"), ("clínica*médica", "clínica%médica"), ("", ""), ("   ", ""),
    (None, ""), ("pediatria", "%pediatria%")])
def test_like_pattern(term, pattern):
    assert fn.like_pattern(term) == pattern


@pytest.mark.parametrize("text, number", [
    ("12.5", 13), ("-12.5", -13), (" 12 ", 12), ("1e3", 1000), ("abc", None), ("", None), ("99999999999", None)])
def test_lenient_int_text(spark, text, number):
    assert one(spark, text, fn.lenient_int) == number


@pytest.mark.parametrize("value, number", [(12.5, 12), (13.5, 14), (12.7, 13)])
def test_lenient_int_number(spark, value, number):
    assert one(spark, value, lambda c: fn.lenient_int(c, from_text=False), "double") == number


@pytest.mark.parametrize("value", [0.25, 0.35, 1.005, 2.675, -0.25, 1234567.25])
def test_python_round(spark, value):
    assert one(spark, value, lambda c: fn.python_round(c, 1), "double") == round(value, 1)
    assert one(spark, value, lambda c: fn.python_round(c, 2), "double") == round(value, 2)


def test_accents(spark):
    assert one(spark, "ção ÉÅ øßªﬁ 가", fn.fold_accents) == "cao EA øßªﬁ 가"
    assert one(spark, "ção ªﬁ é", fn.fold_compat) == "cao afi e"


def test_line_breaks(spark):
    assert one(spark, "123\r\n456\n789", fn.normalise_breaks) == "123 456  789"
    assert one(spark, "123\r\n456\n789", lambda _: F.expr(sqltext.normalise_breaks("x"))) == "123 456  789"
    assert one(spark, "a\r\nb\rc", fn.unify_breaks) == "a\nb\nc"


def test_labels_and_keys(spark):
    assert one(spark, "x" * 46, fn.truncate_label) == "x" * 45 + "..."
    assert one(spark, None, fn.blank_label) == "Não Informado"
    assert one(spark, "123456789012", fn.format_key) == "12-34-5678901-2"
    assert one(spark, "123", fn.format_key) == "123"
    assert one(spark, None, fn.format_key) == ""


def test_age_text(spark):
    df = spark.createDataFrame([("2000-06-15",)], "b string")
    got = df.select(fn.age_text(C("b"), F.lit("2020-06-14")), fn.age_text(C("b"), F.lit("2020-06-15"))).first()
    assert tuple(got) == ("19 anos e 0 meses", "20 anos e 0 meses")


def test_key_value_lines(spark):
    text = "A: 1\nno pair\nB : x:y\nA: 2"
    assert one(spark, text, fn.key_value_lines) == {"A": "2", "B": "x:y"}


def test_formats_and_bands(spark):
    assert one(spark, 1234567, fn.locale_int, "bigint") == "1.234.567"
    assert one(spark, 1.5, fn.locale_decimal, "double") == "1,5"
    assert one(spark, 0.44, fn.signed_text, "double") == "+0.4"
    assert [one(spark, v, lambda c: fn.rate_band(c, 15, 30), "double") for v in (14.9, 15.0, 30.0, 30.1)] == [
        "low", "mid", "mid", "high"]


def test_day_difference_counts_calendar_days(spark):
    df = spark.createDataFrame([("2024-01-01 23:59:00", "2024-01-02 00:01:00")], "a string, b string")
    assert df.select(fn.day_diff(C("b").cast("timestamp"), C("a").cast("timestamp"))).first()[0] == 1


def test_sql_text_forms_equal_the_column_forms(spark):
    from queuelens.functions import dates, numbers, privacy, sqltext as q, text
    texts = ["", " ", None, "Ab ç", "\u00a0x\t", "123456789012", "1", "0", "-5", "1.5e3", "abc", "a\r\nb\rc\nd", "999999999999999999",
             "253402300799999", "1700000000000"]
    df = spark.createDataFrame([(k, t, float(k) / 8 + 0.005) for k, t in enumerate(texts)], "k int, v string, d double").withColumn(
        "salt", F.lit("s"))
    v, d = F.col("v"), F.col("d")
    pairs = {"strip": (text.strip(v), q.strip("v")), "breaks": (text.normalise_breaks(v), q.normalise_breaks("v")),
             "unified": (text.unify_breaks(v), q.unify_breaks("v")), "key": (text.format_key(v), q.format_key("v")),
             "epoch": (dates.epoch_text(v), q.epoch_text("v")), "hash": (privacy.hash_identity(v, "s"), q.hash_identity("v", "salt")),
             "round": (numbers.python_round(d, 2), q.python_round("d", 2))}
    for row in df.select("k", *[F.struct(a.alias("a"), F.expr(b).alias("b")).alias(n) for n, (a, b) in pairs.items()]).collect():
        for name in pairs:
            assert row[name].a == row[name].b, (name, texts[row.k])
