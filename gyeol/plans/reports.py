"""Reports built as markup from the tables and read again: tagged cells, statement tables, sections and chunks, funding scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.operators import grids, sections, xbrl
from gyeol.plans.base import query
from gyeol.session import table

_AXIS = "ifrs-full_ConsolidatedAndSeparateFinancialStatementsAxis_ifrs-full_"
_LINES = {"own_Amount": ("계약금액 (주석 3)", "amount_krw"), "own_Base": ("기준금액", "base_amount")}
_TAGGED_SQL = "SELECT id::VARCHAR AS doc_id, '{}' AS acode, 2000 + (id % 20)::INT AS year, round(abs({}) / 1e6)::BIGINT * 1000000 * sign({})::BIGINT AS value FROM event_contract WHERE {} IS NOT NULL"
TAGGED = " UNION ALL ".join(_TAGGED_SQL.format(code, c, c, c) for code, (_, c) in _LINES.items())


def statement_reports(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, year, raw): a statement of each contract in millions, its cells tagged, the year before left blank, and a table of no statement."""
    ec = table(spark, d, "event_contract")
    year = F.lit(2000) + (F.col("id") % 20).cast("int")

    def row(code: str, label: str, c: str) -> F.Column:
        n = F.round(F.abs(F.col(c)) / 1e6).cast("long")
        shown = F.when(F.col(c) < 0, F.concat(F.lit("("), F.format_number(n, 0), F.lit(")"))).otherwise(F.format_number(n, 0))
        context = F.concat(F.lit("CFY"), year.cast("string"), F.lit(f"dFY_{_AXIS}ConsolidatedMember"))
        cell = F.concat(F.lit(f"<TR><TD>{label}</TD><TE ACODE='{code}' ACONTEXT='"), context, F.lit("' ADECIMAL='-6'>"), shown, F.lit("</TE><TE></TE></TR>"))
        return F.when(F.col(c).isNotNull(), cell).otherwise("")

    head = "<DOCUMENT><TITLE>연결 손익계산서</TITLE><TABLE><TR><TD COLSPAN='3'>(단위 : 백만원)</TD></TR><TR><TD>과목</TD><TD>당기</TD><TD>전기</TD></TR>"
    tail = "</TABLE><TITLE>부문 정보</TITLE><TABLE><TR><TD>부문</TD><TE ACODE='own_Amount' ACONTEXT='CFY2024dFY_a_SegmentsAxis_b_OtherAxis_c' ADECIMAL='-6'>7</TE></TR></TABLE></DOCUMENT>"
    return ec.select(F.col("id").cast("string").alias("doc_id"), year.alias("year"), F.concat(F.lit(head), *[row(code, label, c) for code, (label, c) in _LINES.items()], F.lit(tail)).alias("raw"))


@query("tagged_values", TAGGED)
def tagged_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of tagged cells: context read, scaled, cells with other axes or outside a statement left out."""
    return xbrl.statement_values(xbrl.tagged_cells(statement_reports(spark, d), "doc_id", "raw")).select("doc_id", "acode", "year", "value")


def _tag_labels(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """Labels beside tags: the first cell of the row that a tagged cell's text stands in."""
    rows = grids.grid_rows(docs, "doc_id", "raw")
    beside = rows.select("doc_id", F.get("cells", F.lit(0)).alias("label"), F.explode("cells").alias("text")).where("text <> '' and text <> label").distinct()
    own = cells.where(xbrl.context_parts(F.col("acontext"))["axes"] == 1).select("doc_id", "acode", "text")
    return xbrl.tag_labels(own.join(beside, ["doc_id", "text"]), "label")


@query("account_names", " UNION ALL ".join(f"SELECT '{code}' AS acode, '{label.split(' (')[0]}' AS label, count({c}) AS n FROM event_contract" for code, (label, c) in _LINES.items()))
def account_names(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of account names: labels that stand beside a tag often enough, without their notes. Rows with equal numbers aren't told apart."""
    docs = statement_reports(spark, d)
    named = _tag_labels(docs, xbrl.tagged_cells(docs, "doc_id", "raw"))
    top = named.groupBy("acode").agg(F.max_by("label", "n").alias("label"), F.max("n").alias("n"))
    return top


@query("statement_scores", " UNION ALL ".join(f"SELECT '{code}' AS acode, count({c}) AS n, count({c}) AS agree, 0::BIGINT AS missing FROM event_contract" for code, (_, c) in _LINES.items()))
def statement_scores(spark: SparkSession, d: str) -> DataFrame:
    """Values read from the tables alone, by unit line and year columns, scored against the tagged ones."""
    docs = statement_reports(spark, d)
    cells = xbrl.tagged_cells(docs, "doc_id", "raw")
    read = xbrl.table_values(grids.grid_rows(docs, "doc_id", "raw"), docs.select("doc_id", "year"))
    return xbrl.score_tables(read, xbrl.statement_values(cells), _tag_labels(docs, cells))


@query("report_chunks")
def report_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as reports of sections, cut into chunks with header lines; tables stay whole."""
    docs = table(spark, d, "documents").where("text is not null")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mark = lambda x: F.when(x.rlike(r"^(?:■|[IVX]+\.|[가-하]\.)\s"), F.concat(F.lit("<SECTION-2><TITLE>"), esc(x), F.lit("</TITLE>"))).when(x.contains("|"), F.concat(F.lit("<TABLE><TR><TD>"), F.replace(esc(x), F.lit("|"), F.lit("</TD><TD>")), F.lit("</TD></TR></TABLE>"))).otherwise(F.concat(F.lit("<P>"), esc(x), F.lit("</P>")))
    raw = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "corp_code", "rcept_dt", "report_nm", F.array_join(F.transform(lines, mark), "").alias("raw"))
    return sections.chunks(raw, ["corp_code", "rcept_dt", "report_nm"]).select("doc_id", "section_no", "chunk_no", "title", "n_chars", "is_table", F.md5("text").alias("text_md5"))


@query(
    "funding_scope",
    """SELECT id, major_kind, CASE WHEN major_kind IN ('유상증자결정', '전환사채권발행결정', '교환사채권발행결정', '상각형조건부자본증권발행결정', '자본으로인정되는채무증권발행결정') THEN 'issue' ELSE 'disposal' END AS scope FROM event_major
WHERE major_kind IN ('유상증자결정', '전환사채권발행결정', '교환사채권발행결정', '상각형조건부자본증권발행결정', '자본으로인정되는채무증권발행결정') OR (major_kind = '자기주식처분결정' AND regexp_matches(disposal_purpose, '자금|재원'))""",
)
def funding_scope(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that bring money in: issues that state the uses of their proceeds, and disposals made for funds."""
    issues = ["유상증자결정", "전환사채권발행결정", "교환사채권발행결정", "상각형조건부자본증권발행결정", "자본으로인정되는채무증권발행결정"]
    em = table(spark, d, "event_major")
    scope = F.when(F.col("major_kind").isin(issues), "issue").when((F.col("major_kind") == "자기주식처분결정") & F.col("disposal_purpose").rlike("자금|재원"), "disposal")
    return em.select("id", "major_kind", scope.alias("scope")).where("scope is not null")
