"""Relational operators over the filings: joins, aggregates, sets, order, windows, and checks as violation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyeol.functions import text
from gyeol.operators.wide import latest_copies, union_all
from gyeol.plans.base import query, tables
from gyeol.session import cut_lineage, table


def documents_once(spark: SparkSession, d: str) -> DataFrame:
    """document with the last copy of each doc_id."""
    return latest_copies(table(spark, d, "document"), ["doc_id"], ["loaded_at"])


ONCE = "(SELECT * FROM document QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) = 1)"


@query("filter_funnel", f"SELECT doc_id, rcept_dt FROM {ONCE} WHERE corp_code = '09000000' AND doc_group = 'periodic' AND base_year BETWEEN 2023 AND 2025 AND doc_subtype IN ('annual', 'half') AND report_nm NOT LIKE '%정정%'")
def filter_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Company, type and fiscal period narrow the documents before any text is touched."""
    keep = "corp_code = '09000000' AND doc_group = 'periodic' AND base_year BETWEEN 2023 AND 2025 AND doc_subtype IN ('annual', 'half') AND report_nm NOT LIKE '%정정%'"
    return latest_copies(table(spark, d, "document").where(keep), ["doc_id"], ["loaded_at"]).select("doc_id", "rcept_dt")


@query("project_casts", r"SELECT id, coalesce(CASE WHEN regexp_matches(replace(item_value, ',', ''), '^\s*-?[0-9]+\s*$') THEN try_cast(replace(item_value, ',', '') AS BIGINT) END, 0) AS n, length(item_value) AS len, (seq <> 1)::INT AS later FROM major_item")
def project_casts(spark: SparkSession, d: str) -> DataFrame:
    v = F.replace("item_value", F.lit(","))
    plain = F.when(v.rlike(r"^\s*-?[0-9]+\s*$"), v.try_cast("long"))
    return table(spark, d, "major_item").select("id", F.coalesce(plain, F.lit(0)).alias("n"), F.length("item_value").alias("len"), (F.col("seq") != 1).cast("int").alias("later"))


@query("join_master", f"SELECT e.id, d.rcept_dt, c.corp_name, c.market FROM event_contract e JOIN {ONCE} d USING (doc_id) JOIN company c ON c.corp_code = e.corp_code")
def join_master(spark: SparkSession, d: str) -> DataFrame:
    """Facts with their document and company; Spark sends the side that is small by its statistics."""
    ec, co = tables(spark, d, "event_contract", "company")
    docs = documents_once(spark, d).select("doc_id", "rcept_dt")
    return ec.join(docs, "doc_id").join(co.select("corp_code", "corp_name", "market"), "corp_code").select("id", "rcept_dt", "corp_name", "market")


@query("orphan_documents", "SELECT d.doc_id FROM document d LEFT JOIN company c ON c.corp_code = d.corp_code WHERE c.corp_code IS NULL UNION ALL SELECT e.doc_id FROM contract_item e LEFT JOIN document d ON d.doc_id = e.doc_id WHERE d.doc_id IS NULL")
def orphan_documents(spark: SparkSession, d: str) -> DataFrame:
    docs, co, items = tables(spark, d, "document", "company", "contract_item")
    return docs.join(co, "corp_code", "left_anti").select("doc_id").unionByName(items.join(docs, "doc_id", "left_anti").select("doc_id"))


@query("duplicate_keys", "SELECT doc_id, count(*) AS n FROM document GROUP BY doc_id HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")


_EDGES = f"(SELECT e.doc_id AS to_id, lead(e.doc_id) OVER (PARTITION BY e.corp_code, e.title_norm ORDER BY d.rcept_dt, e.id) AS from_id FROM event_contract e JOIN {ONCE} d USING (doc_id))"


def contract_edges(spark: SparkSession, d: str) -> DataFrame:
    """(from_id, to_id): each contract version points at the one before it."""
    ec = table(spark, d, "event_contract").join(documents_once(spark, d).select("doc_id", "rcept_dt"), "doc_id")
    w = Window.partitionBy("corp_code", "title_norm").orderBy("rcept_dt", "id")
    return ec.select(F.col("doc_id").alias("to_id"), F.lead("doc_id").over(w).alias("from_id"))


@query("two_role_edges", f"SELECT x.from_id, x.to_id, b.rcept_dt > a.rcept_dt AS reversed FROM {_EDGES} x JOIN {ONCE} a ON a.doc_id = x.from_id JOIN {ONCE} b ON b.doc_id = x.to_id WHERE b.rcept_dt <> a.rcept_dt")
def two_role_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each end of an edge joins its own document; the residual compares both."""
    e = contract_edges(spark, d).where("from_id is not null")
    docs = documents_once(spark, d)
    a = docs.select(F.col("doc_id").alias("from_id"), F.col("rcept_dt").alias("a_dt"))
    b = docs.select(F.col("doc_id").alias("to_id"), F.col("rcept_dt").alias("b_dt"))
    return e.join(a, "from_id").join(b, "to_id").where("b_dt <> a_dt").select("from_id", "to_id", (F.col("b_dt") > F.col("a_dt")).alias("reversed"))


@query("mutual_refs", f"SELECT DISTINCT a.from_id, a.to_id FROM {_EDGES} a JOIN {_EDGES} b ON a.from_id = b.to_id AND a.to_id = b.from_id WHERE a.from_id <> a.to_id")
def mutual_refs(spark: SparkSession, d: str) -> DataFrame:
    e = contract_edges(spark, d).where("from_id is not null")
    back = e.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("from_id"))
    return e.join(back, ["from_id", "to_id"], "left_semi").where("from_id <> to_id").distinct()


@query(
    "last_item_lookup",
    f"SELECT d.doc_id, (SELECT i.item_value FROM contract_item i WHERE i.doc_id = d.doc_id AND contains(i.item_name, '계약상대') ORDER BY i.seq DESC, i.id DESC LIMIT 1) AS party FROM {ONCE} d WHERE d.doc_group = 'exchange'",
)
def last_item_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The last matching item of each document: an aggregate before the join instead of a lookup a row."""
    items = table(spark, d, "contract_item").where(F.col("item_name").contains("계약상대"))
    last = items.groupBy("doc_id").agg(F.max(F.struct("seq", "id", "item_value")).alias("x")).select("doc_id", F.col("x.item_value").alias("party"))
    return documents_once(spark, d).where("doc_group = 'exchange'").select("doc_id").join(last, "doc_id", "left")


@query("global_aggregates", "SELECT count(*) AS n, count(DISTINCT corp_code) AS corps, sum(amount_krw)::BIGINT AS total, max(rcept) AS last_dt, coalesce(max(ratio_match), 0) AS m FROM (SELECT e.*, start_date AS rcept FROM event_contract e)")
def global_aggregates(spark: SparkSession, d: str) -> DataFrame:
    ec = table(spark, d, "event_contract")
    return ec.agg(F.count("*").alias("n"), F.countDistinct("corp_code").alias("corps"), F.sum("amount_krw").alias("total"), F.max("start_date").alias("last_dt"), F.coalesce(F.max("ratio_match"), F.lit(0)).alias("m"))


@query("kind_distribution", "SELECT doc_group, doc_subtype, count(*) AS n, sum((is_correction = 1)::INT)::BIGINT AS corrections FROM document GROUP BY 1, 2 ORDER BY n DESC, 1, 2")
def kind_distribution(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "document")
    return docs.groupBy("doc_group", "doc_subtype").agg(F.count("*").alias("n"), F.count_if(F.col("is_correction") == 1).alias("corrections")).orderBy(F.col("n").desc(), "doc_group", "doc_subtype")


@query("having_alias", "SELECT corp_code, title_norm, count(*) AS versions FROM event_contract GROUP BY 1, 2 HAVING count(*) >= 3")
def having_alias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_contract").groupBy("corp_code", "title_norm").agg(F.count("*").alias("versions")).where("versions >= 3")


@query("concat_distinct", "SELECT corp_code, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM event_contract GROUP BY 1")
def concat_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_contract").groupBy("corp_code").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("conditional_ratios", "SELECT section, round(avg(has_pii::DOUBLE), 6) AS pii_share, round(avg((item_value IS NULL)::INT), 6) AS missing_share, count(*) AS n FROM holding_item GROUP BY section")
def conditional_ratios(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "holding_item").groupBy("section").agg(
        F.round(F.avg(F.col("has_pii").cast("double")), 6).alias("pii_share"), F.round(F.avg(F.col("item_value").isNull().cast("int")), 6).alias("missing_share"), F.count("*").alias("n"))


@query("rollup_counts", "SELECT doc_group, is_correction, count(*) AS n FROM document GROUP BY ROLLUP (doc_group, is_correction)")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document").rollup("doc_group", "is_correction").agg(F.count("*").alias("n"))


@query("distinct_pairs", "SELECT DISTINCT event_type, form, base_kind FROM event_contract")
def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_contract").select("event_type", "form", "base_kind").distinct()


@query("subset_violations", "SELECT DISTINCT event_type, form FROM event_contract EXCEPT SELECT * FROM (VALUES ('contract', '의무'), ('contract', '자율'), ('contract', '코스닥'), ('termination', '해지'), ('investment', '시설투자')) t(event_type, form)")
def subset_violations(spark: SparkSession, d: str) -> DataFrame:
    """Values outside their vocabulary: the set difference is empty where all fit."""
    allowed = [("contract", "의무"), ("contract", "자율"), ("contract", "코스닥"), ("termination", "해지"), ("investment", "시설투자")]
    return table(spark, d, "event_contract").select("event_type", "form").distinct().subtract(spark.createDataFrame(allowed, "event_type string, form string"))


@query("set_equality", "SELECT 'only_document' AS side, corp_code FROM (SELECT corp_code FROM document EXCEPT SELECT corp_code FROM company) UNION ALL SELECT 'only_company', corp_code FROM (SELECT corp_code FROM company EXCEPT SELECT corp_code FROM document)")
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    docs, co = (x.select("corp_code") for x in tables(spark, d, "document", "company"))
    return docs.subtract(co).select(F.lit("only_document").alias("side"), "corp_code").unionByName(co.subtract(docs).select(F.lit("only_company").alias("side"), "corp_code"))


@query("set_intersection", "SELECT corp_code FROM event_major INTERSECT SELECT corp_code FROM event_contract")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    em, ec = tables(spark, d, "event_major", "event_contract")
    return em.select("corp_code").intersect(ec.select("corp_code"))


@query("keep_first", "SELECT doc_id, item_name, item_value, min(seq) AS seq FROM contract_item WHERE item_value IS NOT NULL GROUP BY 1, 2, 3")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    """Equal pairs of a document count once, at their first place."""
    return table(spark, d, "contract_item").where("item_value is not null").groupBy("doc_id", "item_name", "item_value").agg(F.min("seq").alias("seq"))


@query("top_sectors", "SELECT sector, corp_code, market_cap FROM company WHERE market_cap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sector ORDER BY market_cap DESC, corp_code) <= 3")
def top_sectors(spark: SparkSession, d: str) -> DataFrame:
    """The three largest of each sector: a top-k report."""
    w = Window.partitionBy("sector").orderBy(F.col("market_cap").desc(), "corp_code")
    return table(spark, d, "company").where("market_cap is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("sector", "corp_code", "market_cap")


@query("latest_version", f"SELECT e.corp_code, e.event_type, e.title_norm, e.id, count(*) OVER (PARTITION BY e.corp_code, e.event_type, e.title_norm) AS versions FROM event_contract e JOIN {ONCE} d USING (doc_id) QUALIFY row_number() OVER (PARTITION BY e.corp_code, e.event_type, e.title_norm ORDER BY d.rcept_dt DESC, e.id DESC) = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """The version in force of each contract, with how many there are; reduced on the map side."""
    ec = table(spark, d, "event_contract").join(documents_once(spark, d).select("doc_id", "rcept_dt"), "doc_id")
    out = ec.groupBy("corp_code", "event_type", "title_norm").agg(F.max(F.struct("rcept_dt", "id")).alias("x"), F.count("*").alias("versions"))
    return out.select("corp_code", "event_type", "title_norm", F.col("x.id").alias("id"), "versions")


@query("version_history", f"SELECT e.id, row_number() OVER w AS version, e.amount_krw - lag(e.amount_krw) OVER w AS change FROM event_contract e JOIN {ONCE} d USING (doc_id) WINDOW w AS (PARTITION BY e.corp_code, e.event_type, e.title_norm ORDER BY d.rcept_dt, e.id)")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    ec = table(spark, d, "event_contract").join(documents_once(spark, d).select("doc_id", "rcept_dt"), "doc_id")
    w = Window.partitionBy("corp_code", "event_type", "title_norm").orderBy("rcept_dt", "id")
    return ec.select("id", F.row_number().over(w).cast("long").alias("version"), (F.col("amount_krw") - F.lag("amount_krw").over(w)).alias("change"))


@query("growth_share", f"SELECT corp_code, y, total, round(total / sum(total) OVER (PARTITION BY y), 9) AS share, round((total - lag(total) OVER (PARTITION BY corp_code ORDER BY y)) / lag(total) OVER (PARTITION BY corp_code ORDER BY y), 9) AS growth FROM (SELECT e.corp_code, substr(d.rcept_dt, 1, 4) AS y, sum(e.amount_krw)::DOUBLE AS total FROM event_contract e JOIN {ONCE} d USING (doc_id) WHERE e.amount_krw > 0 GROUP BY 1, 2)")
def growth_share(spark: SparkSession, d: str) -> DataFrame:
    """Yearly totals with growth over the year before on record and share of the year."""
    ec = table(spark, d, "event_contract").where("amount_krw > 0").join(documents_once(spark, d).select("doc_id", "rcept_dt"), "doc_id")
    t = ec.groupBy("corp_code", F.substring("rcept_dt", 1, 4).alias("y")).agg(F.sum("amount_krw").cast("double").alias("total"))
    before = F.lag("total").over(Window.partitionBy("corp_code").orderBy("y"))
    return t.select("corp_code", "y", "total", F.round(F.col("total") / F.sum("total").over(Window.partitionBy("y")), 9).alias("share"), F.round((F.col("total") - before) / before, 9).alias("growth"))


@query("null_order", "SELECT id, row_number() OVER (ORDER BY amount_krw NULLS FIRST, id) AS n FROM event_major")
def null_order(spark: SparkSession, d: str) -> DataFrame:
    """Positions in a total order with missing amounts first, found without one sorting task.

    Range partitions are counted, and each row's place is its place in its partition plus the rows before it.
    """
    rows = table(spark, d, "event_major").select("id", "amount_krw").repartitionByRange(F.col("amount_krw").asc_nulls_first(), "id")
    w = Window.partitionBy("part").orderBy(F.col("amount_krw").asc_nulls_first(), "id")
    placed = cut_lineage(rows.withColumn("part", F.spark_partition_id()).withColumn("rn", F.row_number().over(w)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(sizes, "part").select("id", (F.col("base") + F.col("rn")).alias("n"))


@query("unpivot_items", "SELECT id, 'amount' AS item_name, amount_krw::VARCHAR AS item_value FROM event_contract WHERE amount_krw IS NOT NULL UNION ALL SELECT id, 'start', start_date FROM event_contract WHERE start_date IS NOT NULL UNION ALL SELECT id, 'end', end_date FROM event_contract WHERE end_date IS NOT NULL")
def unpivot_items(spark: SparkSession, d: str) -> DataFrame:
    ec = table(spark, d, "event_contract").select("id", F.col("amount_krw").cast("string").alias("amount"), F.col("start_date").alias("start"), F.col("end_date").alias("end"))
    return ec.unpivot("id", ["amount", "start", "end"], "item_name", "item_value").where("item_value is not null")


@query("random_sample", None)
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """A repeatable sample of 50 contracts for reading: a sampling operator. Top-k by hash, no global sort."""
    return table(spark, d, "event_contract").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(50)


@query(
    "path_join",
    "SELECT DISTINCT r.folder_id, d.doc_id FROM raw_folder r JOIN document d ON nfc_normalize(r.listed_path) = nfc_normalize(d.file_path)",
)
def path_join(spark: SparkSession, d: str) -> DataFrame:
    """Listed folders meet documents on the composed form of both paths."""
    nfc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.col(c), F.lit(False))
    raw = table(spark, d, "raw_folder").where("listed_path is not null").select("folder_id", nfc("listed_path").alias("p"))
    docs = table(spark, d, "document").where("file_path is not null").select("doc_id", nfc("file_path").alias("p"))
    return raw.join(docs, "p").select("folder_id", "doc_id").distinct()


@query("json_props", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


# ---- checks: one row a check with its violations ---------------------------------------------------
#: (check, Spark condition of a violation, the same in SQL), by table. A rate check is listed with its counts instead.
ROW_CHECKS = {
    "document": [
        ("corp_code has 8 digits", "corp_code not rlike '^[0-9]{8}$'", "NOT regexp_matches(corp_code, '^[0-9]{8}$')"),
        ("rcept_no has 14 digits", "rcept_no not rlike '^[0-9]{14}$'", "NOT regexp_matches(rcept_no, '^[0-9]{14}$')"),
        ("doc_id is its group and number", "doc_id <> concat(doc_group, '_', rcept_no)", "doc_id <> doc_group || '_' || rcept_no"),
        ("required columns", "doc_id is null or corp_code is null or doc_group is null or report_nm is null or rcept_dt is null or is_correction is null", None),
        ("category is always null", "category is not null", None),
        ("fiscal period only for periodic", "(base_year is not null) <> (doc_group = 'periodic')", None),
        ("major has no subtype", "doc_group = 'major' and doc_subtype is not null", None),
        ("kind only for major", "(major_kind is not null) <> (doc_group = 'major')", None),
        ("group vocabulary", "doc_group not in ('periodic', 'major', 'exchange', 'holding')", None),
        ("correction flag in the name", "(is_correction = 1) <> (report_nm like '%정정%')", None),
    ],
    "company": [
        ("company code has 8 digits", "corp_code not rlike '^[0-9]{8}$'", "NOT regexp_matches(corp_code, '^[0-9]{8}$')"),
        ("stock code has 6 digits", "stock_code not rlike '^[0-9]{6}$'", "NOT regexp_matches(stock_code, '^[0-9]{6}$')"),
        ("company name", "corp_name is null", None),
    ],
    "event_contract": [
        ("termination has its form", "(event_type = 'termination') <> (form = '해지')", None),
        ("base kind by form", "base_kind <> case when form = '시설투자' then 'equity' else 'revenue' end", None),
        ("ratio matches", "ratio_match = 0", None),
        ("fixed and conditional add up", "amount_fixed + amount_cond <> amount_krw", None),
        ("no negative amount", "amount_krw < 0 or base_amount < 0", None),
        ("start before end", "start_date > end_date", None),
        ("contract dates are days", "start_date not rlike '^20[0-9]{6}$' or end_date not rlike '^20[0-9]{6}$'", "NOT regexp_matches(start_date, '^20[0-9]{6}$') OR NOT regexp_matches(end_date, '^20[0-9]{6}$')"),
        ("one row a version has a document", "doc_id is null", None),
        ("allowed pairs of type and form", "concat(event_type, ' ', form) not in ('contract 의무', 'contract 자율', 'contract 코스닥', 'termination 해지', 'investment 시설투자')", None),
        ("form found", "form is null or form = ''", None),
        ("disclosure type vocabulary", "disclosure_type not in ('mandatory', 'voluntary')", None),
        ("signed within the corpus", "signed_at < '19900101' or signed_at > '20991231'", None),
        ("ratio can be checked where both sides are there", "ratio_match is null and ratio_stated is not null and amount_krw > 0 and base_amount > 0", None),
        ("ratio verdict is 0 or 1", "ratio_match not in (0, 1)", None),
        ("held back with a reason", "hold_until is not null and hold_reason is null", None),
        ("termination has a reason", "event_type = 'termination' and terminate_reason is null", None),
        ("title is there", "title is null", None),
        ("amount is there or held back", "amount_krw is null and hold_until is null", None),
        ("counterparty is there", "counterparty is null", None),
        ("title key wherever a title", "title is not null and title_norm is null", None),
    ],
    "event_major": [
        ("arithmetic holds", "check_ok = 0", None),
        ("uses add up", "use_total <> coalesce(use_facility, 0) + coalesce(use_business, 0) + coalesce(use_operation, 0) + coalesce(use_debt, 0) + coalesce(use_acquire, 0) + coalesce(use_other, 0)", None),
        ("withdrawn means corrected", "is_withdrawn = 1 and is_correction <> 1", None),
        ("no negative number", "amount_krw < 0 or shares_common < 0 or price_share < 0", None),
        ("decided on a day", "decided_at not rlike '^20[0-9]{6}$'", "NOT regexp_matches(decided_at, '^20[0-9]{6}$')"),
        ("one row a decision has a document", "doc_id is null", None),
        ("kind is there", "major_kind is null", None),
        ("verdict is 0 or 1", "check_ok not in (0, 1)", None),
        ("purpose of proceeds for issues", "major_kind in ('유상증자결정', '전환사채권발행결정', '교환사채권발행결정') and use_total is null", None),
        ("disposal methods only for disposals", "method_etc is not null and major_kind <> '자기주식처분결정'", None),
        ("start before end", "start_date > end_date", None),
        ("decided before it starts", "decided_at > start_date", None),
        ("foreign amount has a currency", "amount_foreign is not null and currency is null", None),
        ("disposal has a purpose", "major_kind = '자기주식처분결정' and disposal_purpose is null", None),
    ],
    "holding_item": [
        ("known sections", "section not in ('summary', 'issuer', 'report_type', 'correction', 'reporter', 'related_party', 'fund_list', 'change_detail', 'holding_detail', 'holding_total', 'holding', 'account', 'funding_source', 'loan', 'contract', 'purpose', 'change_method', 'note', 'other')", None),
        ("item has a document", "doc_id is null", None),
        ("item has a name", "item_name is null or item_name = ''", None),
        ("names within 160 characters", "length(item_name) > 160", None),
        ("section is there", "section is null", None),
        ("other is rare", "section = 'other'", None),
        ("personal data", "has_pii = 1", None),
        ("value is there", "item_value is null", None),
        ("seq counts from 1", "seq < 1", None),
        ("personal-data flag is 0 or 1", "has_pii not in (0, 1) or has_pii is null", None),
    ],
}
#: (check, child, parent): every doc_id of the child is in the parent.
KEY_CHECKS = [(f"{c} has its document", c, "document") for c in ("event_contract", "event_major", "contract_item", "major_item", "holding_item")]
_ROW_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS checked, '{name}' AS check_name, count(*) FILTER (WHERE {sql or cond}) AS violations, count(*) AS n FROM {t}" for t, checks in ROW_CHECKS.items() for name, cond, sql in checks
)
_KEY_SQL = " UNION ALL ".join(
    f"SELECT '{c}', '{name}', count(*) FILTER (WHERE p.doc_id IS NULL), count(*) FROM {c} c LEFT JOIN (SELECT DISTINCT doc_id FROM {p}) p ON p.doc_id = c.doc_id" for name, c, p in KEY_CHECKS
)


@query("all_checks", f"{_ROW_SQL} UNION ALL {_KEY_SQL}")
def all_checks(spark: SparkSession, d: str) -> DataFrame:
    """Violations of every check: each table is read once for all of its row checks."""
    parts = []
    for name, checks in ROW_CHECKS.items():
        t = table(spark, d, name)
        sums = t.agg(F.count("*").alias("n"), *[F.count_if(F.expr(cond)).alias(f"v{i}") for i, (_, cond, _) in enumerate(checks)])
        rows = F.array(*[F.struct(F.lit(label).alias("check_name"), F.col(f"v{i}").alias("violations")) for i, (label, _, _) in enumerate(checks)])
        parts.append(sums.select(F.lit(name).alias("checked"), F.explode(rows).alias("x"), "n").select("checked", "x.check_name", "x.violations", "n"))
    for label, child, parent in KEY_CHECKS:
        c, p = tables(spark, d, child, parent)
        hit = c.select("doc_id").join(p.select("doc_id").distinct().withColumn("there", F.lit(1)), "doc_id", "left")
        parts.append(hit.agg(F.count_if(F.col("there").isNull()).alias("violations"), F.count("*").alias("n")).select(F.lit(child).alias("checked"), F.lit(label).alias("check_name"), "violations", "n"))
    return union_all(parts)


@query(
    "column_equals_item",
    """
WITH i AS (SELECT doc_id, arg_max(item_value, seq::BIGINT * 100000000 + id) AS v FROM contract_item WHERE regexp_matches(item_name, '회사와의 관계$') AND item_value IS NOT NULL GROUP BY doc_id)
SELECT e.id, e.counterparty_rel IS NOT DISTINCT FROM i.v AS same FROM event_contract e JOIN i USING (doc_id)
""",
)
def column_equals_item(spark: SparkSession, d: str) -> DataFrame:
    """Two extraction paths compared: the typed column against the document's own item."""
    items = table(spark, d, "contract_item").where(F.col("item_name").rlike("회사와의 관계$") & F.col("item_value").isNotNull())
    last = items.groupBy("doc_id").agg(F.max_by("item_value", F.struct("seq", "id")).alias("v"))
    return table(spark, d, "event_contract").join(last, "doc_id").select("id", F.col("counterparty_rel").eqNullSafe(F.col("v")).alias("same"))


@query("squeezed_names", r"SELECT id, regexp_replace(item_name, '[\s\x{00a0}\x{2002}\x{2003}\x{2009}\x{202f}\x{3000}]+', '', 'g') AS name FROM major_item")
def squeezed_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "major_item").select("id", text.squeeze(F.col("item_name")).alias("name"))
