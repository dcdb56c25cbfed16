"""The date readers of the filings: one reader, told what may stand between the parts and whether it must.

All give ``YYYYMMDD`` text, check only month 1-12 and day 1-31, and take the first match in the text. The three uses differ on
purpose and aren't to be merged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_pattern(after_year: str, after_month: str, required: bool) -> str:
    """Regular expression of a date, its parts as groups: blanks and one mark between them, or any number of both or none."""
    gap = (lambda marks: rf"\s*[{marks}]\s*") if required else (lambda marks: rf"[{marks}\s]*")
    return rf"(\d{{4}}){gap(after_year)}(\d{{1,2}}){gap(after_month)}(\d{{1,2}})"


LOOSE = day_pattern("-.년", "-.월", required=False)
STRICT = day_pattern("-.년", "-.월", required=True)
#: Filings mix the marks up.
MIXED = day_pattern("-.년월", "-.년월", required=True)
#: Years that a pointer to a filing may name.
POINTER_YEARS = (2000, 2030)


def ymd(text: Column, pattern: str, years: tuple[int, int] | None = None) -> Column:
    """The first match as YYYYMMDD; null outside the ranges or without a match."""
    y, m, d = (F.regexp_extract(text, "(?U)" + pattern, k) for k in (1, 2, 3))
    ok = m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
    if years is not None:
        ok = ok & y.try_cast("int").between(*years)
    return F.when(ok, F.concat(y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def loose_date(c: Column) -> Column:
    """Contract fields: separators may be missing."""
    return ymd(c, LOOSE)


def strict_date(c: Column) -> Column:
    """Items of decisions and holdings: separators are required."""
    return ymd(c, STRICT)


def pointer_date(c: Column) -> Column:
    """Pointers of corrections: mixed-up separators, years 2000 to 2030."""
    return ymd(c, MIXED, POINTER_YEARS)
