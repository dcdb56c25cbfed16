"""Scalar readers against literal values."""

import pytest
from pyspark.sql import functions as F

from gyeol.functions import dates, numbers, readers, text, units

DATES = [
    ("2024년 03월 12일", "20240312", "20240312", "20240312"),
    ("2023-01-27", "20230127", "20230127", "20230127"),
    ("2022.06.28", "20220628", "20220628", "20220628"),
    ("20250726", "20250726", None, None),
    ("2025년 08년 28일", None, None, "20250828"),
    ("2043-05-31", "20430531", "20430531", None),
    ("2025-13-01", None, None, None),
    ("", None, None, None),
    (None, None, None, None),
]


def test_dates(spark):
    df = spark.createDataFrame([(d[0],) for d in DATES], "v string")
    got = df.select(dates.loose_date(F.col("v")), dates.strict_date(F.col("v")), dates.pointer_date(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [d[1:] for d in DATES]


def column(spark, values, f):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_numbers(spark):
    vals = ["1,234", " -5 ", "1.5", "-", "–", "", None, "12a", "99999999999999999999", "1e3", "7.6%"]
    assert column(spark, vals, numbers.to_int) == [1234, -5, None, None, None, None, None, None, None, None, None]
    assert column(spark, vals, numbers.to_float)[:3] == [1234.0, -5.0, 1.5] and column(spark, vals, numbers.to_float)[-2:] == [1000.0, 7.6]
    assert column(spark, vals, numbers.to_num)[-2:] == [None, None]


def test_value_like(spark):
    assert column(spark, ["-", "해당", "1,000", "(5.0)%", "2024-1-2", "2024년 1월 2일", "금액", "Y", "Yes"], numbers.value_like) == [True] * 6 + [False, True, False]


@pytest.mark.parametrize("kind,values,want", [
    ("number", ["22,764원", "３，０００", "3억 2,000만원", "1조 2억", "5명", "0", "-", "원", "1.5", None, "12주"], [22764, 3000, 320000000, 1000200000000, 5, 0, None, None, None, None, 12]),
    ("ratio", ["7.6", "７．６０%", "12 %", "-", "5.005", None, "x"], ["7.60", "7.60", "12.00", None, "5.01", None, None]),
    ("date", ["2024-03-12", "'24.3.1", "2024년 02월 31일", "2024. 03. 05.", "2026년 2월 2일(월)", "20240229", "2023.02.29", "0000-00-00", "24/12/31", None], ["2024-03-12", "2024-03-01", None, "2024-03-05", "2026-02-02", "2024-02-29", None, None, "2024-12-31", None]),
    ("flag", ["해당", " 미해당", "O", "n", "참석 ", "해당사항 없음", "", None], [1, 0, 1, 0, 1, None, None, None]),
])
def test_readers(spark, kind, values, want):
    assert [None if v is None else v if kind in ("number", "flag") else str(v) for v in column(spark, values, readers.READERS[kind])] == want


def test_text(spark):
    assert column(spark, ["차륜형장갑차 4차양산", "차륜형장갑차 4차 양산사업", "ＡＢ 사업", "공사 (Tobelo)", "사업", "", None], text.title_key) == ["차륜형장갑차4차양산", "차륜형장갑차4차양산", "AB사업", "공사(Tobelo)", "사업", None, None]
    assert column(spark, ["[첨부추가]주요사항보고서(유상증자결정)", "유상증자결정", "[정정] ", None], text.major_kind) == ["유상증자결정", "유상증자결정", None, None]
    assert column(spark, ["<style>x</style><TABLE><TR><TD>a</TD><TD>b&nbsp;c</TD></TR><TR><TD></TD></TR></TABLE>", "", None], text.html_to_text) == ["a | b c", "", None]
    assert column(spark, ["x 1. 투자구분 a 1. 투자구분 b", "1. 제목 only", "none"], lambda c: text.from_last_mark(c, ["1. 판매ㆍ공급계약 구분", "1. 투자구분", "1. 제목"])) == ["1. 투자구분 b", "1. 제목 only", "none"]


def test_units(spark):
    said = ["금액(백만원)", "금액 [단위: 천 원]", "금액, 억", "금액 - 단위 : KRW bn", "금액(원, 백만원 미만 절사)", "금액 (1,000원)", "금액", "금액（억원）", None]
    assert column(spark, said, units.stated_won_scale) == [1e6, 1e3, 1e8, 1e9, 1.0, 1e3, None, 1e8, None]
    assert column(spark, ["본문 > ※ 금액 단위 = 십억 원", "[단위: 억]", "단위 1,000원", "매출액 (단위: 억원)", "전환가액 (원/주)"], units.unit_line_scale) == [1e9, 1e8, 1e3, None, None]
    assert column(spark, ["KRW KRW mn", "원화 천원", "백만", "USD", "원"], units.bare_won_scale) == [1e6, 1e3, 1e6, None, 1.0]
    df = spark.createDataFrame([(v,) for v in ["USDm", "백만 달러", "€(천)", "usd", "¥(JPY) k", "U.S. dollar mn", "???", None]], "v string")
    iso, factor = units.currency_of(F.col("v"))
    assert [tuple(r) for r in df.select(iso, factor).collect()][:6] == [("USD", 1e6), ("USD", 1e6), ("EUR", 1e3), ("USD", 1.0), ("JPY", 1e3), ("USD", 1e6)]
    assert [r[0] for r in df.select(iso).collect()][6:] == [None, None]


def test_checks(spark):
    r = spark.range(1).select(
        numbers.bond_check(F.lit(400), F.lit(400)), numbers.rights_check(F.lit(1000000), F.lit(10000), F.lit(9900000000)), numbers.rights_check(F.lit(1000000), F.lit(10000), F.lit(9600000000)),
        numbers.treasury_check(F.lit(1000), F.lit(5000), F.lit(5000000)), numbers.treasury_check(F.lit(None).cast("int"), F.lit(5000), F.lit(5000000)),
        numbers.holding_ratio_check(F.lit(150.0), F.lit(100.0), F.lit(100.0), F.lit(75.0)), numbers.holding_ratio_check(F.lit(0.0), F.lit(100.0), F.lit(0.0), F.lit(0.0)),
        numbers.ratio_verdict(F.lit(7.5663), F.lit(7.6)), numbers.sum_or_null([F.lit(None).cast("long"), F.lit(0).cast("long")])).first()
    assert list(r) == [1, 1, 0, 1, None, 1, None, 1, None]
