"""Item lookups, scalar readers and table pairs over the item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyeol.functions import dates, numbers, text, units
from gyeol.operators import eav, facts, grids
from gyeol.plans import oracle_facts
from gyeol.plans.base import query
from gyeol.plans.oracle_units import half
from gyeol.session import table

SQ = r"regexp_replace(item_name, '[\s\x{00a0}\x{2002}\x{2003}\x{2009}\x{202f}\x{3000}]+', '', 'g')"


@query(
    "title_key",
    "SELECT id, title IS NULL AS no_title, title_norm AS stored, CASE WHEN title IS NULL THEN NULL ELSE title_norm IS NOT NULL END AS agrees FROM event_contract",
)
def title_key(spark: SparkSession, d: str) -> DataFrame:
    """The key made anew from each title against the stored one: they agree wherever both are there."""
    key = text.title_key(F.col("title"))
    return table(spark, d, "event_contract").select("id", F.col("title").isNull().alias("no_title"), F.col("title_norm").alias("stored"), F.when(key.isNotNull(), F.coalesce(key == F.col("title_norm"), F.lit(False))).alias("agrees"))


@query(
    "major_kind",
    r"""
SELECT doc_id, loaded_at, CASE WHEN doc_group = 'major' THEN nullif(CASE WHEN regexp_matches(s, '^주요사항보고서\((.+)\)\s*$')
  THEN regexp_extract(s, '^주요사항보고서\((.+)\)\s*$', 1) ELSE s END, '') END AS kind
FROM (SELECT *, trim(regexp_replace(report_nm, '^\s*(\[[^\]]*\]\s*)+', '')) AS s FROM document)
""",
)
def major_kind(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_group") == "major", text.major_kind(F.col("report_nm")))
    return table(spark, d, "document").select("doc_id", "loaded_at", kind.alias("kind"))


@query(
    "html_to_text",
    r"""
SELECT id, array_to_string(list_filter([trim(regexp_replace(regexp_replace(regexp_replace(x, '[ \t]*\|[ \t]*(\|[ \t]*)+', ' | ', 'g'), '[ \t]{2,}', ' ', 'g'), '^[ |]+|[ |]+$', '', 'g'),
   chr(32) || chr(9) || chr(160) || chr(8194) || chr(8195) || chr(8201) || chr(8239) || chr(12288)) FOR x IN string_split(s, chr(10))], lambda x: x <> ''), chr(10)) AS body
FROM (SELECT id, item_name || ' | ' || coalesce(item_value, '') || ' | ' AS s FROM contract_item)
""",
)
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Items wrapped in markup with a style block come back as lines."""
    rows = table(spark, d, "contract_item")
    raw = F.concat(F.lit("<style>td{a:b}</style><TABLE><TR><TD>"), "item_name", F.lit("</TD><TD COLSPAN='2'>"), F.coalesce("item_value", F.lit("")), F.lit("</TD></TR></TABLE>"))
    return rows.select("id", text.html_to_text(raw).alias("body"))


_HALF = half("item_value")
_BLANK = r"[\s\x{00a0}\x{2002}\x{2003}\x{2009}\x{202f}\x{3000}]"
_trim = lambda c: rf"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_FLAGS = ", ".join(f"'{x}'" for x in [*numbers.ABSENT, *numbers.FLAG_WORDS])


@query(
    "amount_parse",
    rf"""
SELECT id, CASE WHEN regexp_matches(t, '^-?[0-9]+$') THEN try_cast(t AS BIGINT) END AS whole, try_cast(f AS DOUBLE) AS real_value,
  CASE WHEN regexp_matches(t, '^-?[0-9]+([.][0-9]+)?$') THEN try_cast(t AS DOUBLE) END AS num,
  v IN ({_FLAGS}) OR regexp_matches(v, '^[(]?-?[0-9,]+([.][0-9]+)?[)]?%?$') OR regexp_matches(v, '^[0-9]{{4}}{_BLANK}*[-.년]{_BLANK}*[0-9]{{1,2}}{_BLANK}*[-.월]{_BLANK}*[0-9]{{1,2}}{_BLANK}*일?$') AS value_like
FROM (SELECT id, {_trim("h")} AS v, {_trim("replace(h, ',', '')")} AS t, {_trim("replace(replace(h, ',', ''), '%', '')")} AS f FROM (SELECT id, {_HALF} AS h FROM major_item))
""",
)
def amount_parse(spark: SparkSession, d: str) -> DataFrame:
    """The three number readers and the value test on every item, full-width characters read as plain ones."""
    v = units.half_width(F.col("item_value"))
    return table(spark, d, "major_item").select("id", numbers.to_int(v).alias("whole"), numbers.to_float(v).alias("real_value"), numbers.to_num(v).alias("num"), numbers.value_like(v).alias("value_like"))


def _day_sql(gap_1: str, gap_2: str, lo: int, hi: int) -> str:
    """A date of the text h: year, month and day by one pattern, checked for their ranges."""
    part = lambda k: f"regexp_extract(h, '([0-9]{{4}}){gap_1}([0-9]{{1,2}}){gap_2}([0-9]{{1,2}})', {k})"
    number = lambda k: f"try_cast({part(k)} AS INT)"
    return f"CASE WHEN {number(1)} BETWEEN {lo} AND {hi} AND {number(2)} BETWEEN 1 AND 12 AND {number(3)} BETWEEN 1 AND 31 THEN {part(1)} || lpad({part(2)}, 2, '0') || lpad({part(3)}, 2, '0') END"


_ANY = lambda marks: rf"[{marks}\s\x{{00a0}}\x{{2002}}\x{{2003}}\x{{2009}}\x{{202f}}\x{{3000}}]*"
_ONE = lambda marks: rf"{_BLANK}*[{marks}]{_BLANK}*"


@query(
    "date_parse",
    f"""
SELECT id, {_day_sql(_ANY("-.년"), _ANY("-.월"), 0, 9999)} AS loose, {_day_sql(_ONE("-.년"), _ONE("-.월"), 0, 9999)} AS strict, {_day_sql(_ONE("-.년월"), _ONE("-.년월"), 2000, 2030)} AS pointer
FROM (SELECT id, {_HALF} AS h FROM contract_item)
""",
)
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    """The three date readers side by side on every item, full-width characters read as plain ones."""
    v = units.half_width(F.col("item_value"))
    return table(spark, d, "contract_item").select("id", dates.loose_date(v).alias("loose"), dates.strict_date(v).alias("strict"), dates.pointer_date(v).alias("pointer"))


@query(
    "ratio_check",
    """
SELECT id, round(c, 3) AS calc, CASE WHEN c IS NOT NULL AND ratio_stated IS NOT NULL THEN (abs(c - ratio_stated) <= greatest(0.05, ratio_stated * 0.005))::INT END AS verdict
FROM (SELECT id, ratio_stated, round(nullif(amount_krw, 0)::DOUBLE / nullif(base_amount, 0)::DOUBLE * 100, 4) AS c FROM event_contract)
""",
)
def ratio_check(spark: SparkSession, d: str) -> DataFrame:
    """Stated ratios of contracts recomputed."""
    ec = table(spark, d, "event_contract").withColumn("calc", numbers.ratio_pct(F.col("amount_krw"), F.col("base_amount")))
    return ec.select("id", F.round("calc", 3).alias("calc"), numbers.ratio_verdict(F.col("calc"), F.col("ratio_stated")).alias("verdict"))


@query(
    "arithmetic_checks",
    """
SELECT id, major_kind, nullif(coalesce(use_facility, 0) + coalesce(use_business, 0) + coalesce(use_operation, 0) + coalesce(use_debt, 0) + coalesce(use_acquire, 0) + coalesce(use_other, 0), 0) AS uses,
 CASE WHEN major_kind IN ('전환사채권발행결정', '교환사채권발행결정', '상각형조건부자본증권발행결정', '자본으로인정되는채무증권발행결정')
   THEN CASE WHEN coalesce(use_total, 0) <> 0 AND coalesce(amount_krw, 0) <> 0 THEN (abs(use_total - amount_krw) < 1)::INT END
  WHEN major_kind = '유상증자결정' THEN CASE WHEN coalesce(shares_common * price_share, 0) <> 0 AND coalesce(use_total, 0) <> 0
   THEN (shares_common * price_share - use_total BETWEEN shares_common * price_share * -0.0001 AND shares_common * price_share * 0.03)::INT END
  WHEN contains(major_kind, '자기주식처분') OR contains(major_kind, '자기주식취득결정') THEN CASE WHEN coalesce(shares_common, 0) <> 0 AND coalesce(price_share, 0) <> 0 AND coalesce(amount_krw, 0) <> 0
   THEN (abs(shares_common * price_share - amount_krw) <= greatest(1, amount_krw * 0.001))::INT END END AS verdict
FROM event_major
""",
)
def arithmetic_checks(spark: SparkSession, d: str) -> DataFrame:
    """The relation that each kind of decision states about itself."""
    c = F.col
    check = (
        F.when(c("major_kind").isin(facts.BOND_KINDS), numbers.bond_check(c("use_total"), c("amount_krw")))
        .when(c("major_kind") == facts.RIGHTS, numbers.rights_check(c("shares_common"), c("price_share"), c("use_total")))
        .when(c("major_kind").contains("자기주식처분") | c("major_kind").contains("자기주식취득결정"), numbers.treasury_check(c("shares_common"), c("price_share"), c("amount_krw")))
    )
    return table(spark, d, "event_major").select("id", "major_kind", numbers.sum_or_null([c(k) for k in facts.USES]).alias("uses"), check.alias("verdict"))


@query(
    "main_amount",
    """
SELECT id, coalesce(stated, gross, nullif(use_total, 0)) AS amount, CASE WHEN stated IS NOT NULL THEN 'stated' WHEN gross IS NOT NULL THEN '신주 수 × 발행가액' WHEN coalesce(use_total, 0) <> 0 THEN '자금조달의 목적 합계' END AS source
FROM (SELECT *, CASE WHEN major_kind <> '유상증자결정' THEN nullif(amount_krw, 0) END AS stated, CASE WHEN major_kind = '유상증자결정' THEN nullif(shares_common, 0) * nullif(price_share, 0) END AS gross FROM event_major)
""",
)
def main_amount(spark: SparkSession, d: str) -> DataFrame:
    """The chain of sources of the main amount, zero counting as missing: a rights issue is taken as one that states no amount."""
    c = F.col
    stated = F.when(c("major_kind") != facts.RIGHTS, numbers.first_nonzero(c("amount_krw")))
    amount, source = facts.main_amount(c("major_kind"), stated, c("shares_common"), c("price_share"), numbers.first_nonzero(c("use_total")))
    return table(spark, d, "event_major").select("id", amount.alias("amount"), source.alias("source"))


@query(
    "flag_map",
    """
SELECT id, CASE trim(item_value) WHEN '해당' THEN 1 WHEN '미해당' THEN 0 END AS flag FROM contract_item WHERE contains(item_name, '대규모법인')
""",
)
def flag_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contract_item").where(F.col("item_name").contains("대규모법인")).select("id", facts.large_corporation(F.col("item_value")).alias("flag"))


@query(
    "currency_code",
    """
SELECT id, CASE WHEN currency IS NOT NULL AND NOT regexp_matches(currency, '^[0-9,. -]*$') THEN nullif(regexp_extract(currency, '[A-Z]{3}', 0), '') END AS code FROM event_major
""",
)
def currency_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_major").select("id", facts.currency_code(F.col("currency")).alias("code"))


@query(
    "pick_items",
    f"""
SELECT doc_id, arg_max(item_value, o) FILTER (WHERE contains(n, '이사회결의일') AND item_value IS NOT NULL) AS last_decided,
 arg_min(item_value, o) FILTER (WHERE contains(n, '이사회결의일') AND item_value IS NOT NULL) AS first_decided,
 arg_max(item_value, o) FILTER (WHERE contains(n, '사채의이율') AND contains(n, '표면이자율') AND item_value IS NOT NULL) AS coupon
FROM (SELECT *, seq::BIGINT * 100000000 + id AS o, {SQ} AS n FROM major_item) GROUP BY doc_id
""",
)
def pick_items(spark: SparkSession, d: str) -> DataFrame:
    """First and last matching items of every decision in one grouped pass."""
    rows = table(spark, d, "major_item").withColumn("o", F.col("seq").cast("long") * F.lit(100000000) + F.col("id"))
    there = F.col("item_value").isNotNull()
    return rows.groupBy("doc_id").agg(
        eav.last_value(eav.named("이사회결의일") & there, order="o").alias("last_decided"),
        eav.first_value(eav.named("이사회결의일") & there, order="o").alias("first_decided"),
        eav.last_value(eav.named("사채의 이율", "표면이자율") & there, order="o").alias("coupon"),
    )


@query(
    "pick_after",
    f"""
WITH live AS (SELECT * FROM holding_item WHERE section = 'summary' QUALIFY row_number() OVER (PARTITION BY doc_id, seq ORDER BY loaded_at DESC, id DESC) = 1),
following AS (SELECT doc_id, seq, {SQ} AS n, lead(item_value) OVER (PARTITION BY doc_id ORDER BY seq) AS nxt FROM live)
SELECT doc_id, arg_min(nxt, seq) AS after_previous FROM following WHERE contains(n, '직전보고서') AND nxt IS NOT NULL GROUP BY doc_id
""",
)
def pick_after(spark: SparkSession, d: str) -> DataFrame:
    """The value of the item that follows the previous report's shares in the summary."""
    from gyeol.operators.wide import latest_copies

    rows = latest_copies(table(spark, d, "holding_item").where("section = 'summary'"), ["doc_id", "seq"], ["loaded_at", "id"])
    nxt = eav.with_next(rows)
    hit = nxt.where(eav.named("직전보고서") & F.col("next_value").isNotNull())
    return hit.groupBy("doc_id").agg(F.min_by("next_value", "seq").alias("after_previous"))


@query(
    "pick_priority",
    f"""
SELECT doc_id, coalesce(min(CASE WHEN false THEN 0 END), arg_min(v, o) FILTER (WHERE contains(n, '이번보고서주식수') AND v IS NOT NULL), arg_min(v, o) FILTER (WHERE contains(n, '직전보고서주식수') AND v IS NOT NULL)) AS shares
FROM (SELECT doc_id, seq::BIGINT * 100000000 + id AS o, {SQ} AS n, CASE WHEN regexp_matches(trim(replace(item_value, ',', '')), '^-?[0-9]+$') THEN try_cast(trim(replace(item_value, ',', '')) AS BIGINT) END AS v FROM holding_item) GROUP BY doc_id
""",
)
def pick_priority(spark: SparkSession, d: str) -> DataFrame:
    """The first number under the first label that has one."""
    rows = table(spark, d, "holding_item").withColumn("seq", F.col("seq").cast("long") * F.lit(100000000) + F.col("id"))
    return rows.groupBy("doc_id").agg(eav.priority_number(eav.named("이번보고서주식수"), eav.named("직전보고서주식수")).alias("shares"))


@query(
    "label_next_line",
    r"""
WITH l AS (SELECT doc_id, [trim(x, chr(32) || chr(9) || chr(160) || chr(8194) || chr(8195) || chr(8201) || chr(8239) || chr(12288) || chr(13)) FOR x IN string_split(text, chr(10))] AS a FROM documents),
r AS (SELECT doc_id, unnest(generate_series(1, len(a))) AS p, a FROM l),
n AS (SELECT doc_id, p, a[p] AS line, a[p + 1] AS nxt FROM r)
SELECT doc_id, arg_min(v, p) FILTER (WHERE line = '요약정보') AS summary, arg_min(v, p) FILTER (WHERE line = '정정신고(보고)') AS correction
FROM (SELECT *, CASE WHEN nxt IN ('요약정보', '정정신고(보고)') THEN '' ELSE coalesce(nxt, '') END AS v FROM n) GROUP BY doc_id
""",
)
def label_next_line(spark: SparkSession, d: str) -> DataFrame:
    """The line after the first occurrence of a label line."""
    labels = {"summary": "요약정보", "correction": "정정신고(보고)"}
    return eav.label_values(eav.numbered_lines(table(spark, d, "documents")), labels, list(labels.values()))


@query(
    "mode_with_ties",
    """
SELECT doc_group, report_nm AS top_name, n FROM (SELECT doc_group, report_nm, count(*) AS n, min(rcept_no || doc_id) AS seen FROM document GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY doc_group ORDER BY n DESC, seen) = 1
""",
)
def mode_with_ties(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "document").withColumn("o", F.concat("rcept_no", "doc_id"))
    return eav.mode_value(docs, ["doc_group"], "report_nm", "o").select("doc_group", F.col("report_nm").alias("top_name"), "n")


@query("correction_reasons", oracle_facts.REASONS)
def correction_reasons(spark: SparkSession, d: str) -> DataFrame:
    from gyeol.operators.wide import latest_copies

    rows = latest_copies(table(spark, d, "major_item"), ["doc_id", "seq"], ["loaded_at", "id"])
    return eav.correction_reasons(rows)


_SECTION_CASES = " ".join(f"WHEN {' OR '.join(f'''contains(k, '{w}')''' for w in words)} THEN '{name}'" for name, words in grids.SECTION_WORDS.items())


@query(
    "section_rules",
    f"""
SELECT id, CASE {_SECTION_CASES} WHEN length(item_name) > 30 THEN 'note' ELSE 'other' END AS section, (contains(k, '생년월일') OR contains(k, '주소(소재지)') OR contains(k, '여권'))::INT AS pii
FROM (SELECT id, item_name, {SQ} AS k FROM holding_item)
""",
)
def section_rules(spark: SparkSession, d: str) -> DataFrame:
    """The section rules on the name of every holding item, as a first row of one cell."""
    cells = F.array("item_name")
    return table(spark, d, "holding_item").select("id", grids.section_of(cells).alias("section"), grids.personal_flag(cells).alias("pii"))


_LABEL = rf"regexp_replace(regexp_replace(regexp_extract({half('item_name')}, '([^>]*)$', 1), '{_BLANK}+', '', 'g'), '^(?:[0-9]{{1,2}}[.．])?[-－ㆍ·]?', '')"


@query(
    "form_decision",
    f"""
SELECT doc_id, CASE WHEN max((k = '투자금액(원)')::INT) = 1 AND max((k = '자기자본(원)')::INT) = 1 THEN '시설투자' WHEN max((k IN ('해지금액(원)', '해지계약명'))::INT) = 1 THEN '해지'
 WHEN max((k IN ('확정계약금액', '계약금액총액(원)', '판매ㆍ공급계약내용'))::INT) = 1 THEN '코스닥' WHEN max((k = '체결계약명')::INT) = 1 THEN '의무' WHEN max((k = '세부내용')::INT) = 1 THEN '자율' ELSE '' END AS form
FROM (SELECT doc_id, {_LABEL} AS k FROM contract_item) GROUP BY doc_id
""",
)
def form_decision(spark: SparkSession, d: str) -> DataFrame:
    """The form of each document by its items' names as label lines; no text is put together."""
    line = F.regexp_extract(units.half_width(F.col("item_name")), "([^>]*)$", 1)
    lines = table(spark, d, "contract_item").select("doc_id", F.col("seq").alias("pos"), line.alias("line"), F.col("item_value").alias("next_line"))
    return facts.contract_forms(lines).select("doc_id", "form")


def _markup(rows: DataFrame) -> DataFrame:
    """Each document's items as one table of two cells a row, values escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tr = F.concat(F.lit("<TR><TD>"), esc(F.col("item_name")), F.lit("</TD><TE>"), esc(F.col("item_value")), F.lit("</TE></TR>\n"))
    lines = rows.select("doc_id", F.struct("seq", "id", tr.alias("tr")).alias("x"))
    body = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["tr"]), "").alias("b"))
    return body.select("doc_id", F.concat(F.lit("<DOCUMENT><TABLE>"), "b", F.lit("</TABLE></DOCUMENT>")).alias("raw"))


_FLAT = r"trim(regexp_replace({}, '[\s\x{{00a0}}\x{{2002}}\x{{2003}}\x{{2009}}\x{{202f}}\x{{3000}}]+', ' ', 'g'))"


@query(
    "table_roundtrip",
    f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, id)::INT AS seq, n AS item_name, v AS item_value
FROM (SELECT doc_id, seq, id, {_FLAT.format("item_name")} AS n, {_FLAT.format("item_value")} AS v FROM contract_item)
WHERE v <> '' AND n <> '' AND length(n) <= 160
""",
)
def table_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Items rendered as tables, parsed again and read row by row, equal the items."""
    rows = table(spark, d, "contract_item").where("item_value is not null")
    return grids.table_items(grids.grid_rows(_markup(rows), "doc_id", "raw")).select("doc_id", "seq", "item_name", "item_value")


@query(
    "rowspan_fill",
    """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY id)::INT AS row_no, 'G' AS kind, item_name AS name FROM (
 SELECT doc_id, id, trim(regexp_replace(item_name, '[\\s\\x{00a0}\\x{2002}\\x{2003}\\x{2009}\\x{202f}\\x{3000}]+', ' ', 'g')) AS item_name FROM major_item)
""",
)
def rowspan_fill(spark: SparkSession, d: str) -> DataFrame:
    """One cell spanning all rows of a document's table is copied down to each."""
    esc = F.replace(F.replace(F.replace(F.col("item_name"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = table(spark, d, "major_item").select("doc_id", F.struct("id", esc.alias("n")).alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    tr = F.transform("xs", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit("<td rowspan='"), F.size("xs").cast("string"), F.lit("'>G</td>"))).otherwise(F.lit("")), F.lit("<td>"), x["n"], F.lit("</td></tr>")))
    raw = rows.select("doc_id", F.concat(F.lit("<html><table>"), F.array_join(tr, ""), F.lit("</table></html>")).alias("raw"))
    grid = grids.grid_rows(raw, "doc_id", "raw")
    return grid.select("doc_id", (F.col("row_no") + 1).alias("row_no"), F.get("cells", F.lit(0)).alias("kind"), F.get("cells", F.lit(1)).alias("name"))


@query(
    "header_merge",
    """
WITH e AS (SELECT id::VARCHAR AS doc_id, corp_code AS c, amount_krw::VARCHAR AS a, base_amount::VARCHAR AS b FROM event_contract WHERE amount_krw IS NOT NULL),
p AS (SELECT doc_id, 1 AS o, c || ' > 계약 금액' AS item_name, a AS item_value FROM e UNION ALL SELECT doc_id, 2, c || ' > 계약 근거', b FROM e WHERE b IS NOT NULL
 UNION ALL SELECT doc_id, 3, '회사 > 계약 > 계약', '비고' FROM e UNION ALL SELECT doc_id, 4, '회사 > 금액 > 근거', '기타' FROM e
 UNION ALL SELECT doc_id, 5, c, a FROM e UNION ALL SELECT doc_id, 6, a, b FROM e WHERE b IS NOT NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o)::INT AS seq, item_name, item_value FROM p
""",
)
def header_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two header rows are merged into column names; the pairs read by column come first, then those read row by row."""
    rows = table(spark, d, "event_contract").where("amount_krw is not null")
    raw = F.concat(
        F.lit("<table><tr><th rowspan='2'>회사</th><th>계약</th><th>계약</th><th>비고</th></tr><tr><th>금액</th><th>근거</th><th>기타</th></tr><tr><td>"), "corp_code", F.lit("</td><td>"),
        F.col("amount_krw").cast("string"), F.lit("</td><td>"), F.coalesce(F.col("base_amount").cast("string"), F.lit("")), F.lit("</td><td></td></tr></table>"))
    items = grids.table_items(grids.grid_rows(rows.select(F.col("id").cast("string").alias("doc_id"), raw.alias("raw")), "doc_id", "raw"))
    return items.select("doc_id", "seq", "item_name", "item_value")


@query(
    "multi_pair_row",
    """
SELECT id, 'R > 주식' AS name, shares_common::VARCHAR AS value FROM event_major WHERE shares_common IS NOT NULL AND price_share IS NOT NULL
UNION ALL SELECT id, 'R > 가격', price_share::VARCHAR FROM event_major WHERE shares_common IS NOT NULL AND price_share IS NOT NULL
""",
)
def multi_pair_row(spark: SparkSession, d: str) -> DataFrame:
    """A row with several name-value pairs under one path gives one pair each."""
    rows = table(spark, d, "event_major").where("shares_common is not null and price_share is not null")
    cells = F.array(F.lit("R"), F.lit("주식"), F.col("shares_common").cast("string"), F.lit("가격"), F.col("price_share").cast("string"))
    return rows.select("id", F.explode(grids.row_pairs(cells)).alias("p")).select("id", "p.name", "p.value")


@query(
    "seq_numbering",
    "SELECT id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, loaded_at DESC, id)::INT AS n FROM contract_item WHERE length(item_name) <= 160",
)
def seq_numbering(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("seq", F.col("loaded_at").desc(), "id")
    return table(spark, d, "contract_item").where(F.length("item_name") <= 160).select("id", F.row_number().over(w).alias("n"))
