"""Units written in text: won and currency scales, ISO currencies. Column expressions only."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale words with their factors.
SCALES = {
    "천억": 1e11, "백억": 1e10, "십억": 1e9, "억": 1e8, "천만": 1e7, "백만": 1e6, "십만": 1e5, "만": 1e4, "천": 1e3, "조": 1e12,
    "1,000": 1e3, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12,
    "mn": 1e6, "bn": 1e9, "tn": 1e12, "k": 1e3, "m": 1e6,
}
#: Scales that a won amount is tried in when nothing states one.
WON_SCALES = sorted({1.0, *SCALES.values()})
#: Names and signs of currencies, lower case and without blanks.
CURRENCIES = {
    "USD": ["usd", "us$", "$", "미국달러", "미국달러화", "미달러", "미달러화", "미화", "달러", "달러화", "u.s.dollar", "u.s.dollars", "usdollar", "dollar"],
    "EUR": ["eur", "euro", "€", "유로", "유로화"],
    "JPY": ["jpy", "¥", "¥(jpy)", "엔", "엔화", "일본엔", "일본엔화", "yen"],
    "CNY": ["cny", "rmb", "위안", "위안화", "중국위안", "중국위안화", "인민폐", "yuan", "¥(cny)"],
    "HKD": ["hkd", "hk$", "홍콩달러", "홍콩달러화"],
    "SGD": ["sgd", "s$", "싱가포르달러", "싱가포르달러화", "싱가폴달러"],
    "GBP": ["gbp", "£", "파운드", "영국파운드"],
    "AUD": ["aud", "a$", "호주달러"],
    "CAD": ["cad", "c$", "캐나다달러"],
    "CHF": ["chf", "스위스프랑"],
    "TWD": ["twd", "nt$", "대만달러"],
    "VND": ["vnd", "베트남동"],
    "INR": ["inr", "₹", "루피", "인도루피"],
    "KRW": ["krw", "원", "원화", "₩", "won"],
}
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "
_KO = "천억|백억|십억|억|천만|백만|십만|만|천|조"
_EN = "thousand|million|billion|trillion|mn|bn|tn"
#: A unit of won: a scale, the won, or both. Matched against lower-case text.
WON_UNIT = rf"(?:(?:krw|원화|₩)\s*)*(?:1,000\s*원|(?:{_KO})\s*원?|(?:{_EN}|(?<=krw) ?[km])\b(?:\s*won)?|won|원)|krw|원화|₩"
#: Remarks on rounding, which name units that aren't the amount's.
_ROUNDING = r"[,;]?\s*[^,;()\[\]]*(?:미만|이하|절사|반올림|절상|버림)[^,;()\[\]]*"


@lru_cache(maxsize=1)
def _names_of_all() -> dict[str, str]:
    """Every ISO 4217 code, and each name and sign that the JVM's Unicode data gives to one currency only, in Korean and English."""
    from pyspark.sql import SparkSession

    jvm = SparkSession.active()._jvm
    own, locales = jvm.com.ibm.icu.util.Currency, [jvm.com.ibm.icu.util.ULocale(x) for x in ("ko", "en")]
    out: dict[str, set[str]] = {}
    for c in jvm.java.util.Currency.getAvailableCurrencies().toArray():
        code = c.getCurrencyCode()
        money = own.getInstance(code)
        names = [code, *(money.getName(x, style, None) for x in locales for style in (own.LONG_NAME, own.SYMBOL_NAME))]
        for n in names:
            out.setdefault("".join(n.lower().split()), set()).add(code)
    return {n: next(iter(codes)) for n, codes in out.items() if len(codes) == 1}


def _lookup(pairs: dict[str, float | str], key: Column) -> Column:
    """Value of ``key`` in a fixed table, which is one constant of the plan; null for any other text."""
    kind = "string" if isinstance(next(iter(pairs.values())), str) else "double"
    return F.try_element_at(F.from_json(F.lit(json.dumps(pairs)), f"map<string,{kind}>"), key)


def half_width(c: Column) -> Column:
    """Full-width ASCII and blanks in their plain form."""
    return F.translate(c, _FULL, _HALF)


def scale_of(unit: Column) -> Column:
    """Factor of a lower-case unit of won; null for null, empty or other text."""
    bare = F.regexp_replace(unit, r"(?:krw|원화|₩)\s*(?=\S)", "")
    word = F.regexp_extract(bare, rf"^\s*({_KO}|1,000|{_EN}|[km]\b|won|원화|원|krw|₩)", 1)
    return _lookup(SCALES | {"won": 1.0, "원": 1.0, "krw": 1.0, "원화": 1.0, "₩": 1.0}, word)


def stated_won_scale(text: Column) -> Column:
    """Factor of the won unit that follows a label: in brackets, after a comma or after 단위. Null if none is stated."""
    t = F.regexp_replace(F.lower(half_width(text)), _ROUNDING, "")
    return scale_of(F.regexp_extract(t, rf"(?:[(\[,]|단위)\s*(?:단위)?\s*[:=]?\s*({WON_UNIT})\s*[)\]]*\s*$", 1))


def unit_line_scale(text: Column) -> Column:
    """Factor of a line that states nothing but a unit of won; null for other text."""
    return scale_of(F.regexp_extract(F.lower(half_width(text)), rf"^(?:.*>)?[\s(\[※*]*(?:금액)?\s*단위\s*[:=]?\s*({WON_UNIT})\s*[)\]]*\s*$", 1))


def bare_won_scale(text: Column) -> Column:
    """Factor of a text that is as a whole a unit of won; null for other text."""
    return scale_of(F.regexp_extract(F.lower(half_width(text)), rf"^\s*({WON_UNIT})\s*$", 1))


def currency_of(text: Column) -> tuple[Column, Column]:
    """(ISO code, factor) of a free-form currency: any ISO 4217 code or name of one. The code is null where it isn't known, the factor 1 without a scale."""
    t = F.regexp_replace(F.lower(half_width(text)), r"\s+", "")
    common = {n: iso for iso, xs in CURRENCIES.items() for n in xs}
    rest = _names_of_all()
    name = F.regexp_extract(t, rf"^(?:{_KO}|{_EN})?(.*?)[(\[]?(?:{_KO}|{_EN}|m|k)?[)\]]?$", 1)
    whole = F.regexp_extract(t, rf"^(?:{_KO}|{_EN})?(.*?)$", 1)
    first = F.regexp_extract(t, rf"^({_KO}|{_EN})", 1)
    last = F.regexp_extract(t, rf"({_KO}|{_EN}|m|k)[)\]]?$", 1)
    # the usual spellings first; the long table is looked at only for what is none of them
    iso = F.coalesce(*[_lookup(x, y) for x in (common, {n: c for n, c in rest.items() if n not in common}) for y in (whole, name)])
    return iso, F.coalesce(_lookup(SCALES, first), _lookup(SCALES, last), F.lit(1.0))
