"""Values written in text read as typed values: numbers, ratios, dates, flags. Column expressions only.

Each reader takes the raw text and gives null where it can't be read as the type: absent, a mark of
absence, words, an impossible day. Full-width forms and surrounding blanks don't matter.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from gyeol.functions.units import half_width

YES = ["해당", "예", "네", "Y", "YES", "O", "참석", "있음", "TRUE", "1"]
NO = ["미해당", "아니오", "아니요", "N", "NO", "X", "불참", "없음", "FALSE", "0"]
_UNIT = r"(?:원|주|명|개|건|회)?"


def _tight(c: Column) -> Column:
    return F.regexp_replace(half_width(c), r"[\s,]+", "")


def read_number(c: Column) -> Column:
    """Whole numbers, grouped or not, with a unit or in 조·억·만 parts, as LONG."""
    t = _tight(c)
    plain = F.regexp_extract(t, rf"^(\d+){_UNIT}$", 1)
    shape = rf"^(?:(\d+)조)?(?:(\d+)억)?(?:(\d+)만)?(\d+)?{_UNIT}$"
    # a missing part is 0; one that is too long for a number makes the whole unreadable
    part = lambda k: F.concat(F.lit("0"), F.regexp_extract(t, shape, k)).try_cast("decimal(20,0)")
    total = part(1) * F.lit(Decimal(10**12)) + part(2) * F.lit(Decimal(10**8)) + part(3) * F.lit(Decimal(10**4)) + part(4)
    return F.coalesce(plain.try_cast("long"), F.when(t.rlike(shape) & t.rlike(r"\d"), total.try_cast("long")))


def read_ratio(c: Column) -> Column:
    """Percentages as DECIMAL(18,2), rounded half up."""
    t = F.regexp_extract(_tight(c), r"^([-+]?\d+(?:\.\d+)?)%?$", 1)
    return F.round(t.try_cast("decimal(30,10)"), 2).try_cast("decimal(18,2)")


def read_date(c: Column) -> Column:
    """Calendar days as DATE; two-digit years are 20xx."""
    t = F.regexp_replace(half_width(c), r"\s+", "")
    parts = F.regexp_extract(t, r"^['’‘`]?((?:\d{2})?\d{2}[-./년]\d{1,2}[-./월]\d{1,2})[.일]?(?:\([월화수목금토일]\))?$", 1)
    spelled = F.regexp_replace(parts, r"[./년월]", "-")
    dated = F.concat(F.when(F.length(F.split(spelled, "-")[0]) == 2, F.lit("20")).otherwise(F.lit("")), spelled)
    packed = F.regexp_replace(F.regexp_extract(t, r"^(\d{8})$", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.try_to_date(F.nullif(F.when(parts != "", dated).otherwise(packed), F.lit("")), "yyyy-M-d")


def read_flag(c: Column) -> Column:
    """Yes and no in their many spellings as INT 1 and 0."""
    t = F.upper(_tight(c))
    return F.when(t.isin(YES), F.lit(1)).when(t.isin(NO), F.lit(0))


def read_text(c: Column) -> Column:
    """Text that isn't a mark of absence, trimmed."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(~t.isin("", "-", "–", "—", "―", "N/A", "해당사항 없음"), t)


READERS = {"number": read_number, "ratio": read_ratio, "date": read_date, "flag": read_flag, "text": read_text}
SQL_TYPES = {"number": "bigint", "ratio": "decimal(18,2)", "date": "date", "flag": "int", "text": "string"}
