"""Scalar functions: the traps of dates, white space and numbers."""

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeloom.functions import dates, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def day(x):
    return F.lit(x).cast("date")


def plain_full_months(a, b):
    if a > b:
        return None
    months = (b.year - a.year) * 12 + b.month - a.month
    year, month = divmod(a.month - 1 + months, 12)
    last = [31, 29 if (a.year + year) % 4 == 0 and ((a.year + year) % 100 or (a.year + year) % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month]
    return months - (b < date(a.year + year, month + 1, min(a.day, last)))


def test_months_and_ages_against_plain_python(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.tuples(st.dates(date(1950, 1, 1), date(2030, 1, 1)), st.dates(date(1950, 1, 1), date(2030, 1, 1))), min_size=300, max_size=300))
    def check(pairs):
        pairs += [(date(2023, 1, 30), date(2023, 2, 28)), (date(2024, 2, 29), date(2025, 2, 28)), (date(2023, 1, 31), date(2023, 3, 30))]
        rows = spark.createDataFrame(pairs, "a date, b date")
        for r in rows.select("a", "b", dates.full_months(F.col("a"), F.col("b")).alias("m"), dates.age_at(F.col("a"), F.col("b")).alias("y")).collect():
            assert r.m == plain_full_months(r.a, r.b)
            assert r.y == (None if r.a > r.b else r.b.year - r.a.year - ((r.b.month, r.b.day) < (r.a.month, r.a.day)))

    check()


@pytest.mark.parametrize("given_, want", [("20260930", date(2026, 9, 30)), ("2026.9.3", date(2026, 9, 3)), ("2026/09/30 10:00", date(2026, 9, 30)), ("2026-09-30T01:00:00Z", date(2026, 9, 30)), ("2026-02-30", None), ("9/3", None), ("", None)])
def test_lenient_date(spark, given_, want):
    assert one(spark, dates.lenient_date(F.lit(given_))) == want


def test_other_dates(spark):
    assert one(spark, dates.strict_date(F.lit("2026-02-30"))) is None
    assert one(spark, dates.strict_date(F.lit("2026-2-3"))) is None
    assert one(spark, dates.short_year_date(F.lit(" 26.01.05 "))) == date(2026, 1, 5)
    assert one(spark, dates.korean_dates(F.lit("2026년 1월 5일 ~ 2026년1월 32일, 2027년 12월 1일"))) == [date(2026, 1, 5), date(2027, 12, 1)]
    assert one(spark, dates.contract_day(F.lit("range"), day("2026-01-10"), day("2026-01-20"), F.lit("official"), day("2026-01-12"))) == date(2026, 1, 12)
    assert one(spark, dates.contract_day(F.lit("range"), day("2026-01-10"), day("2026-01-20"), F.lit("official"), day("2026-02-12"))) is None
    assert one(spark, dates.contract_day(F.lit("fixed"), day("2026-01-10"), F.lit(None).cast("date"), F.lit("unknown"), day("2026-02-12"))) is None
    assert one(spark, dates.recognised_months(day("2030-01-01"), day("2000-01-01"), day("2026-01-01"))) is None


def test_white_space_is_unicode(spark):
    assert one(spark, text.compact(F.lit("1순위 마감　(끝) \n"))) == "1순위마감(끝)"
    assert one(spark, text.normal(F.lit("　a   b\n"))) in ("a b", " a b ".strip())
    assert one(spark, text.unit_key(F.lit(" 084.9500 a"))) == "0849500A"


@pytest.mark.parametrize("raw, feed, profile", [("1,234", 1234, 1234), ("12,34", 1234, None), ("1,2,3", 123, None), ("-5", None, None), ("3.50", None, None), ("", None, None), ("9007199254740992", 9007199254740992, None)])
def test_two_number_grammars(spark, raw, feed, profile):
    assert one(spark, text.integer(F.lit(raw))) == feed
    assert one(spark, text.profile_number(F.lit(raw))) == profile


def test_money_and_labels(spark):
    assert one(spark, text.manwon_to_krw(F.lit("1,234.5"))) == 12_345_000
    assert one(spark, text.manwon_to_krw(F.lit("0.00001"))) is None
    assert [one(spark, text.won_label(F.lit(x).cast("long"))) for x in (None, 0, 123_456_789, 200_000_000, 90_000, 3)] == ["가격 미공개", "0원", "1억 2,346만원", "2억원", "9만원", "3원"]
    assert [one(spark, text.rate_label(F.lit(x))) for x in (None, "-", "(△57)", "12.5")] == ["미공개", "미공개", "미달 57세대", "12.5"]
    assert [one(spark, text.result_status(F.lit(x))) for x in ("1순위 해당지역 마감(청약 접수 종료)", "1순위 마감(청약접수종료)", "청약접수중", "250.3", None)] == ["local_first_closed", "first_closed", "open", "unknown", "unknown"]


def test_keys_and_urls(spark):
    assert one(spark, text.canonical_unit(F.lit("84.9500A형"))) == "084.9500A"
    assert one(spark, text.base_title(F.lit(" [정정공고] 어느 주택"))) == "어느 주택"
    assert one(spark, text.fingerprint(F.lit("가 나!"), F.lit(" "), day("2026-01-01"))) is None
    assert one(spark, text.fingerprint(F.lit("가 나!"), F.lit("서울"), day("2026-01-01"))) == one(spark, text.fingerprint(F.lit("가나"), F.lit("서 울"), day("2026-01-01")))
    assert one(spark, text.trusted_url(F.lit("https://a.lh.or.kr/x"), ("lh.or.kr",))) is True
    assert one(spark, text.trusted_url(F.lit("https://evil-lh.or.kr/x"), ("lh.or.kr",))) is False
    assert one(spark, text.canonical_json(F.lit('{"b": 1, "a": null}'))) == '{"a":null,"b":1}'
    assert one(spark, text.first_usable(F.lit(None).cast("string"), F.lit(" - "), F.lit("null"), F.lit(" x "))) == "x"
    assert [one(spark, text.yes_no(F.lit(x))) for x in ("y", "N ", "?")] == [True, False, None]
