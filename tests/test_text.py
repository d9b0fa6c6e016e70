import pytest
from pyspark.sql import functions as F

from tidemark.functions import coerce, pay, text


def apply(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v")).alias("x")).collect()]


NORMALIZED = [
    ("&nbsp;<br>", ""), ("Ａ１", "A1"), ("※※※※", ""), ("1. foo\n2) bar", "foo bar"), ("a​b﻿c", "abc"),
    (None, ""), ("", ""), ("<p>hi</p> there", "hi there"), ("&lt;b&gt;x", "x"), ("a\u0007b", "ab"), ("go 🚀 now", "go now"),
    ("★☆ sale", "sale"), ("a--b ---c", "a--b c"), ("  12、第一\n：第二  ", "第一 第二"), ("全形　空白", "全形 空白"),
    ("<" + "x" * 201 + ">", "<" + "x" * 201 + ">"), ("<" + "x" * 200 + ">", ""), ("①", "1"), ("ｶﾞ", "ガ"), ("été", "été"),
    ("a &amp;lt; b", "a &lt; b"), ("line one\nline two", "line one line two"), ("＜b＞x", "<b>x"), ("&am x &amp y", "&am x & y"),
]


def test_normalize_text(spark):
    got = apply(spark, [a for a, _ in NORMALIZED], text.normalize_text)
    assert got == [b for _, b in NORMALIZED]


PAY = [
    ("月薪 40,000元以上", ("月薪", 40000, None, 40000)), ("月薪 30,000~45,000元", ("月薪", 30000, 45000, 30000)),
    ("年薪 600,000元", ("年薪", 600000, None, 50000)), ("時薪 190元", ("時薪", 190, None, 33440)),
    ("日薪 1,500元", ("日薪", 1500, None, 33000)), ("待遇面議", ("面議", None, None, None)),
    ("面議 50,000", ("面議", None, None, None)), ("論件計酬 500", ("論件計酬", 500, None, None)),
    ("月薪 99元", ("月薪", None, None, None)), ("", (None,) * 4), ("   ", (None,) * 4), (None, (None,) * 4),
    ("月薪 ４０，０００", ("月薪", 40000, None, 40000)), ("500~500", (None, 500, 500, None)), ("月薪 ,,, 200", ("月薪", 200, None, 200)),
    ("年薪 30元或月薪 25,000", ("年薪", 25000, None, 2083)), ("時薪 200 月薪 30,000", ("時薪", 200, 30000, 35200)),
    ("年薪 100,006", ("年薪", 100006, None, 8334)), ("⽉薪 30000", ("月薪", 30000, None, 30000)),
]


def test_parse_pay(spark):
    got = [tuple(r) for r in apply(spark, [a for a, _ in PAY], pay.parse_pay)]
    assert got == [b for _, b in PAY]


def test_monthly_pay_rounds_half_to_even(spark):
    # 150 / 12 = 12.5 and 162 / 12 = 13.5
    assert [r.month_min for r in apply(spark, ["年薪 150", "年薪 162"], pay.parse_pay)] == [12.0, 14.0]


TITLES = [
    ("【急徵】★軟體工程師/免打卡", "軟體工程師"), ("會計 - 台北", "會計 - 台北"), ("會計-台北", "會計"), ("A/業務", "業務"),
    (None, ""), ("★★★", ""), ("(兼職)店員", "店員"), ("資深後端工程師Python資料平台組遠端", "資深後端工程師Python資料平"),
    ("護理師～月休八天", "護理師"), ("司機!!", "司機"), ("/", ""), ("X", "X"),
]


def test_clean_title(spark):
    assert apply(spark, [a for a, _ in TITLES], text.clean_title) == [b for _, b in TITLES]


def test_blank_titles(spark):
    values = ["", "TEST", "測試職缺", "測試", "  test ", "tester", "工程師", None, "　"]
    assert apply(spark, values, text.is_blank_title) == [True, True, True, True, True, False, False, True, True]


def test_embedding_text(spark):
    rows = spark.createDataFrame([("工程師", "軟體", "x" * 1500), (None, None, None)], "t string, i string, d string")
    got = [r[0] for r in rows.select(text.embedding_text(F.col("t"), F.col("i"), F.col("d"), 1000)).collect()]
    assert got == ["工程師。工程師。軟體。" + "x" * 1000, "。。。"]


def test_text_or_blank(spark):
    values = [" a ", "None", "nan", None, " None ", "　b\u001f", "NaN"]
    assert apply(spark, values, coerce.text_or_blank) == ["a", "", "", "", "None", "b", "NaN"]


@pytest.mark.parametrize("value,expected", [
    ("2026-05-19", "2026-05-19 00:00:00"), ("2026/05/19 08:30:00", "2026-05-19 08:30:00"),
    ("2026-05-19T08:30:00", "2026-05-19 08:30:00"), ("2026/5/1x", None), ("", None), (None, None)])
def test_to_timestamp(spark, value, expected):
    got = apply(spark, [value], lambda c: F.date_format(coerce.to_timestamp(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == [expected]


def test_to_boolean_and_finite(spark):
    assert apply(spark, ["True", "1", "false", "", None, "TRUE", "yes"], coerce.to_boolean) == [
        True, True, False, False, False, True, False]
    got = apply(spark, ["NaN", "Infinity", "-Infinity", "1.5", None], lambda c: coerce.finite_or_null(c.cast("double")))
    assert got == [None, None, None, 1.5, None]
