"""Text expressions on the JVM: tag stripping, keys, body cuts. ``(?U)`` makes classes Unicode-aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags whose end breaks a line or closes a cell in the filings' markup, and blocks that aren't text.
LINE_TAGS = ["TR", "tr", "P", "p", "TITLE"]
CELL_TAGS = ["TD", "TH", "TE", "TU", "td", "th"]
BLOCKS = ["STYLE", "style", "script"]
#: Stand for the end of a line and of a cell until lines are made.
_LINE, _CELL = "\ue000", "\ue001"


def squeeze(c: Column) -> Column:
    """All white space removed; null becomes ''."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def strip(c: Column) -> Column:
    """Unicode white space removed at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def html_to_text(raw: Column, keep_cells: bool = True) -> Column:
    """Readable lines of marked-up text; cells are joined by `` | `` or a blank. Only ``&nbsp;`` is decoded.

    The text is taken apart into blocks, tags and what is between them; each tag says whether it ends a line, a cell or nothing.
    Lines are the texts between line ends, their cells those between cell ends; empty cells and empty lines vanish.
    """
    pieces = F.regexp_extract_all(raw, F.lit(rf"(?s)<({'|'.join(BLOCKS)}).*?</\1>|<[^>]+>|[^<]+|<"), F.lit(0))

    def said(x: Column) -> Column:
        name = F.regexp_extract(x, r"^</([A-Za-z]+(?:-\d)?)>$", 1)
        tag = F.when(name.isin(LINE_TAGS) | name.rlike(r"^SECTION-\d$"), _LINE).when(name.isin(CELL_TAGS), _CELL if keep_cells else " ")
        block = x.rlike(rf"(?s)^<(?:{'|'.join(BLOCKS)}).*</")
        return F.when(~x.startswith("<") | (x == "<"), x).when(block, " ").otherwise(F.coalesce(tag, F.lit("")))

    whole = F.regexp_replace(F.array_join(F.transform(pieces, said), ""), "&nbsp;?", " ")
    cell = lambda c: F.btrim(F.regexp_replace(c, r"[ \t]{2,}", " "), F.lit(" |\t"))
    row = lambda line: strip(F.array_join(F.filter(F.transform(F.split(line, _CELL), cell), lambda c: c != ""), " | "))
    lines = F.transform(F.split(whole, f"[\n{_LINE}]"), row)
    return F.when(raw.isNotNull(), F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def major_kind(report_nm: Column) -> Column:
    """Kind of a major-decision report: inside of its wrapper, or the whole name; leading [tags] dropped."""
    bare = strip(F.regexp_replace(report_nm, r"(?U)^\s*(\[[^\]]*\]\s*)+", ""))
    inside = F.regexp_extract(bare, r"(?U)^주요사항보고서\((.+)\)\s*$", 1)
    return F.nullif(strip(F.when(inside != "", inside).otherwise(bare)), F.lit(""))


def nfkc(c: Column) -> Column:
    """Compatibility composition, by the ICU that Spark ships with for its collations; null stays null."""
    return F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(True)))


def title_key(title: Column) -> Column:
    """Key that equal contracts share: compatibility form, no white space, one trailing 사업 dropped. '' is null."""
    t = F.regexp_replace(nfkc(title), r"(?U)\s+", "")
    return F.nullif(F.regexp_replace(t, r"^(.{3,})사업$", "$1"), F.lit(""))


def from_last_mark(text: Column, marks: list[str]) -> Column:
    """Text from the last place of the first mark (in order of priority) that stands anywhere but at the very start."""
    out = text
    for m in reversed(marks):
        at = F.length(text) - F.locate(m[::-1], F.reverse(text)) - len(m) + 2
        out = F.when((F.instr(text, m) > 0) & (at > 1), F.substring(text, at, F.length(text))).otherwise(out)
    return out
