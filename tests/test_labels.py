from pyspark.sql import functions as F

from warung.functions import scalars as S


def _one(spark, col, values, schema="x double"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col(F.col("x"))).collect()]


def test_money_half_even_and_negative(spark):
    assert _one(spark, S.money_text, [0.5, 1.5, 2.5, -1234.5]) == ["$0", "$2", "$2", "$-1,234"]


def test_percent_text_half_even(spark):
    # 0.25 is an exact tie (to even: 0.2); 0.35 and 12.345 sit just below
    assert _one(spark, S.percent_text, [0.25, 0.35, 12.345]) == ["0.2%", "0.3%", "12.3%"]


def test_signed_text(spark):
    assert _one(spark, S.signed_text, [1234.4, -3.0, 0.0, -0.4, -0.0]) == ["+1,234", "-3", "+0", "-0", "-0"]


def test_short_label(spark):
    cases = {
        "x" * 50: "x" * 38 + "…",                                 # no space: keep 38
        "word " * 9: "word word word word word word word…",        # cut at a word edge
        "y" * 38: "y" * 38,                                         # exactly 38: unchanged
        "a b": "a b",
        "abc  def " * 6: "abc  def abc  def abc  def abc  def…",
        "ends with space " * 3: "ends with space ends with space ends…",
    }
    got = _one(spark, S.short_label, list(cases), "x string")
    assert got == list(cases.values())


def test_key_label_and_dash(spark):
    df = spark.createDataFrame([(None, 7), ("n", 8)], "name string, k bigint")
    assert [r[0] for r in df.select(S.key_label(F.col("name"), F.col("k"))).collect()] == ["7", "n"]
    assert [r[0] for r in df.select(S.dash_if_missing(F.col("name"))).collect()] == ["—", "n"]


def test_percent_and_plain_texts_do_not_group(spark):
    assert _one(spark, S.percent_text, [1234.56, -0.04]) == ["1234.6%", "-0.0%"]
    assert _one(spark, lambda c: S.plain_text(c, 3), [-1234.5678]) == ["-1234.568"]
    assert _one(spark, lambda c: S.fixed_text(c, 3), [1234.5]) == ["1,234.500"]
