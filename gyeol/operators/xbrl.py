"""Tagged cells of periodic reports: values placed by their attributes, without reading the table around them."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyeol.operators.grids import CELLS
from gyeol.session import busy, ship_package

ATTRIBUTES = ["acode", "acontext", "adecimal", "aunit", "aunitvalue"]
SCHEMA = "doc_id string, title string, pos int, " + ", ".join(f"{a} string" for a in ATTRIBUTES) + ", text string"


class CellReader(HTMLParser):
    """Cells with at least one of the attributes, with the last title before them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.in_title, self.open, self.cells = "", False, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title":
            self.title, self.in_title = "", True
        elif tag in CELLS:
            a = dict(attrs)
            cell = [self.title, *[a.get(k) for k in ATTRIBUTES], []]
            self.open.append(cell)
            if any(cell[1:-1]):
                self.cells.append(cell)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        elif tag in CELLS and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        for c in self.open:
            c[-1].append(data)


def tagged_cells(docs: DataFrame, doc_id: str, raw: str) -> DataFrame:
    """(doc_id, title, pos, acode, acontext, adecimal, aunit, aunitvalue, text) of all tagged cells in order."""
    ship_package(docs.sparkSession)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["raw"], strict=True):
                reader = CellReader()
                reader.feed(text)
                rows += [(i, c[0].strip(), k, *c[1:-1], " ".join("".join(c[-1]).split())) for k, c in enumerate(reader.cells)]
            yield pd.DataFrame(rows, columns=["doc_id", "title", "pos", *ATTRIBUTES, "text"])

    source = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(raw).alias("raw")).where("doc_id is not null and raw is not null")
    return busy(source).mapInPandas(run, SCHEMA)


def context_parts(context: Column) -> dict[str, Column]:
    """year, which (C current, P prior, BP before), instant, basis and number of axes of a context."""
    part = lambda k: F.nullif(F.regexp_extract(context, r"^(C|P|BP)FY(\d{4})([de])", k), F.lit(""))
    basis = F.when(context.contains("ConsolidatedMember"), "consolidated").when(context.contains("SeparateMember"), "separate")
    return {"which": part(1), "year": part(2).try_cast("int"), "instant": part(3) == "e", "basis": basis, "axes": F.size(F.regexp_extract_all(context, F.lit("[A-Za-z]Axis"), F.lit(0)))}


def scaled(text: Column, decimal: Column) -> Column:
    """Value in single units: the number times 10 to the power of minus ADECIMAL; brackets mean below zero."""
    plain = F.regexp_replace(text, r"[,()\s△]", "").try_cast("decimal(28,6)")
    sign = F.when(text.rlike(r"^\s*[(△]"), -1).otherwise(1)
    return F.round(plain * sign * F.pow(F.lit(10.0), -decimal.try_cast("int")).cast("decimal(19,0)"), 0).try_cast("long")


def statement_values(cells: DataFrame, title: str = "손익계산서|재무상태표") -> DataFrame:
    """(doc_id, acode, year, instant, basis, value): cells with the basis axis only, in a statement by title; the first counts."""
    parts = context_parts(F.col("acontext"))
    rows = cells.select("doc_id", "title", "pos", "acode", *[v.alias(k) for k, v in parts.items()], scaled(F.col("text"), F.col("adecimal")).alias("value"))
    rows = rows.where((F.col("axes") == 1) & F.col("year").isNotNull() & F.col("value").isNotNull() & F.col("title").rlike(title))
    w = Window.partitionBy("doc_id", "acode", "year", "instant", "basis").orderBy("pos")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doc_id", "acode", "year", "instant", "basis", "value")


def tag_labels(cells: DataFrame, label: str, least: int = 5) -> DataFrame:
    """(acode, label, n): which labels stand beside which tag, at least ``least`` times, without note numbers."""
    clean = F.trim(F.regexp_replace(F.col(label), r"\s*\((?:주석|note)[^)]*\)", ""))
    return cells.groupBy("acode", clean.alias("label")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


# ---- the same values read from the tables around them ----------------------------------------------
#: Names of the year columns, by how many years they lie back.
PERIODS = ["당기", "전기", "전전기"]


def table_values(grids: DataFrame, years: DataFrame) -> DataFrame:
    """(doc_id, table_no, label, year, value) of statement tables from their grids: a unit line, year columns, labels.

    ``grids`` has doc_id, table_no, row_no, cells; ``years`` has doc_id and year, the year that 당기 stands for. A table without a unit line is
    in single units; columns are found by 당기, 전기, 전전기 or a four-digit year in the first row that has one.
    """
    from gyeol.functions.numbers import to_num
    from gyeol.functions.units import unit_line_scale

    key = ["doc_id", "table_no"]
    bare = F.regexp_replace("cell", r"(?U)\s+", "")
    cells = grids.select(*key, "row_no", F.get("cells", F.lit(0)).alias("first"), F.posexplode("cells").alias("col", "cell"))
    back = F.when(bare == PERIODS[0], 0).when(bare == PERIODS[1], 1).when(bare == PERIODS[2], 2)
    stated = F.nullif(F.regexp_extract("cell", r"^\D*(20\d{2})\D*$", 1), F.lit("")).cast("int")
    heads = cells.where(F.col("col") > 0).select(*key, "row_no", "col", back.alias("back"), stated.alias("stated")).where("back is not null or stated is not null")
    top = heads.groupBy(*key).agg(F.min("row_no").alias("head_row"))
    heads = heads.join(top, key).where("row_no = head_row").select(*key, "col", "head_row", "back", "stated")
    scale = cells.groupBy(*key).agg(F.max(unit_line_scale(F.col("cell"))).alias("scale"))
    body = cells.where(F.col("col") > 0).select(*key, "row_no", "col", "first", to_num(F.regexp_replace("cell", r"^\s*[(△](.*?)\)?\s*$", "-$1")).alias("number")).where("number is not null")
    got = body.join(heads, [*key, "col"]).where("row_no > head_row").join(scale, key, "left").join(years, "doc_id", "left")
    value = F.round(F.col("number") * F.coalesce("scale", F.lit(1.0))).cast("long")
    return got.select("doc_id", "table_no", clean_label(F.col("first")).alias("label"), F.coalesce("stated", F.col("year") - F.col("back")).alias("year"), value.alias("value")).where("year is not null")


def clean_label(c: Column) -> Column:
    """An account name without blanks at its ends and without its note."""
    return F.trim(F.regexp_replace(c, r"\s*\((?:주석|note)[^)]*\)", ""))


def score_tables(tables: DataFrame, tagged: DataFrame, labels: DataFrame) -> DataFrame:
    """(acode, n, agree, missing): values read from tables against the tagged ones of the same documents, by tag.

    ``tables`` is of ``table_values``, ``tagged`` of ``statement_values``, ``labels`` of ``tag_labels``.
    """
    found = tables.join(labels.select("acode", "label"), "label").groupBy("doc_id", "acode", "year").agg(F.collect_set("value").alias("read"))
    both = tagged.join(found, ["doc_id", "acode", "year"], "left")
    return both.groupBy("acode").agg(F.count("*").alias("n"), F.count_if(F.array_contains("read", F.col("value"))).alias("agree"), F.count_if(F.col("read").isNull()).alias("missing"))
