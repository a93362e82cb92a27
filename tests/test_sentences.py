"""Amounts, changes and questions at their edges."""

from pyspark.sql import functions as F

from relatrix.functions import sentences as T


def one(spark, kind, value, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_amounts(spark):
    cases = {None: "(공시되지 않음)", 0: "0원", 9999: "9,999원", 10_000: "10,000원 (약 1.0만원)", -12_500: "-12,500원 (약 -1.2만원)", 123_450_000: "123,450,000원 (약 1.2억원)", 7_654_000_000_000: "7,654,000,000,000원 (약 7.7조원)"}
    for won, shown in cases.items():
        assert one(spark, "long", won, T.amount_text) == shown


def test_enrichment(spark):
    cases = {
        None: None, "": "", "없음": "없음", "12,345원": "12,345원 (약 1.2만원)", "x +20000원, -30,000원": "x +20000원 (약 2.0만원), -30,000원 (약 -3.0만원)",
        "1234원": "1234원", "50000원(약 5만원)": "50000원(약 5만원)", "9" * 60 + "원": "9" * 60 + "원", "10000원10000원": "10000원 (약 1.0만원)10000원 (약 1.0만원)",
    }
    for text, shown in cases.items():
        assert one(spark, "string", text, T.enrich_amounts) == shown


def test_changes(spark):
    rows = spark.createDataFrame([(3, 2), (1, 2), (2, -4), (1, 0), (None, 1), (1, None)], "a int, b int")
    assert [r.y for r in rows.select(T.change_text(F.col("a"), F.col("b")).alias("y")).collect()] == ["50.0% 증가", "50.0% 감소", "150.0% 증가"] + ["전년 자료 없음"] * 3


def test_questions(spark):
    q = one(spark, "string", " A vs B  C 2024년 영업 이익", T.comparison_question)
    assert (q.first, q.second, q.year, q.indicator) == ("A", "B  C", 2024, "영업 이익")
    assert all(one(spark, "string", t, T.comparison_question) is None for t in (None, "", "A vs B", "A and B 2024년 x"))
