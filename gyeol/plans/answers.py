"""Lookups that answer questions: entities, documents, values, search, evidence, and whole fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyeol.functions.text import strip
from gyeol.operators import facts, relation, search
from gyeol.operators.wide import label_key, latest_copies
from gyeol.plans import oracle_facts, oracle_units
from gyeol.plans.base import query, tables
from gyeol.plans.relational import ONCE, documents_once
from gyeol.session import table


@query(
    "entity_lookup",
    """
WITH n AS (SELECT DISTINCT flr_nm AS name FROM document WHERE flr_nm IS NOT NULL)
SELECT name, corp_code, min(how) AS how FROM (SELECT n.name, c.corp_code, '1 corp_name' AS how FROM n JOIN company c ON c.corp_name = n.name
 UNION ALL SELECT n.name, c.corp_code, '2 listed_name' FROM n JOIN company c ON c.listed_name = n.name UNION ALL SELECT n.name, c.corp_code, '3 sector' FROM n JOIN company c ON c.sector = n.name) GROUP BY 1, 2
""",
)
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every name resolved by three equi-joins; an ambiguous one gives all its companies."""
    names = table(spark, d, "document").where("flr_nm is not null").select(F.col("flr_nm").alias("name")).distinct()
    co = table(spark, d, "company")
    parts = [names.join(co.select("corp_code", F.col(c).alias("name")), "name").withColumn("how", F.lit(f"{i} {c}")) for i, c in enumerate(("corp_name", "listed_name", "sector"), 1)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("name", "corp_code").agg(F.min("how").alias("how"))


#: Edits up to which two names count as similar.
NAME_EDITS = 4


@query("similar_names")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of company names close in spelling."""
    n = table(spark, d, "company").select(F.col("corp_name").alias("name"))
    return search.similar_pairs(n, n.withColumnRenamed("name", "other"), NAME_EDITS).where("name < other").select("name", "other", F.col("dist").cast("long").alias("dist"))


@query("entity_candidates")
def entity_candidates(spark: SparkSession, d: str) -> DataFrame:
    """For each filer name that entity_lookup leaves open, the companies with a name close in spelling, nearest first."""
    names = table(spark, d, "document").where("flr_nm is not null").select(F.col("flr_nm").alias("name")).distinct()
    names = names.join(entity_lookup(spark, d).select("name").distinct(), "name", "left_anti")
    co = table(spark, d, "company")
    spelled = co.select("corp_code", F.col("corp_name").alias("other")).unionByName(co.select("corp_code", F.col("listed_name").alias("other"))).where("other is not null")
    near = search.similar_pairs(names, spelled, NAME_EDITS).join(spelled.distinct(), "other")
    best = near.groupBy("name", "corp_code").agg(F.min(F.struct("dist", "other")).alias("x")).select("name", "corp_code", "x.other", F.col("x.dist").cast("long").alias("dist"))
    return best.withColumn("rank", F.rank().over(Window.partitionBy("name").orderBy("dist")).cast("long"))


@query(
    "follow_relations",
    f"""
SELECT t.id AS end_id, max(c.id) AS contract_id, count(*) AS versions FROM event_contract t JOIN event_contract c ON c.corp_code = t.corp_code AND c.title_norm = t.title_norm AND c.event_type = 'contract'
 JOIN {ONCE} a ON a.doc_id = t.doc_id JOIN {ONCE} b ON b.doc_id = c.doc_id WHERE t.event_type = 'termination' AND b.rcept_dt <= a.rcept_dt GROUP BY t.id
""",
)
def follow_relations(spark: SparkSession, d: str) -> DataFrame:
    """From each termination to the contract versions before it."""
    ec = table(spark, d, "event_contract").join(documents_once(spark, d).select("doc_id", "rcept_dt"), "doc_id").select("id", "corp_code", "title_norm", "event_type", "rcept_dt")
    ends = ec.where("event_type = 'termination'").select(F.col("id").alias("end_id"), "corp_code", "title_norm", F.col("rcept_dt").alias("end_dt"))
    begins = ec.where("event_type = 'contract'").drop("event_type")
    return ends.join(begins, ["corp_code", "title_norm"]).where("rcept_dt <= end_dt").groupBy("end_id").agg(F.max("id").alias("contract_id"), F.count("*").alias("versions"))


@query(
    "value_lookup",
    """
SELECT corp_code, 'contract_amount' AS item, max(amount_krw) AS value FROM event_contract GROUP BY 1 UNION ALL SELECT corp_code, 'decision_amount', max(amount_krw) FROM event_major GROUP BY 1
UNION ALL SELECT corp_code, 'market_cap', market_cap FROM company
""",
)
def value_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One source for each item: routing, not fallback."""
    ec, em, co = tables(spark, d, "event_contract", "event_major", "company")
    pick = lambda t, item: t.groupBy("corp_code").agg(F.max("amount_krw").alias("value")).select("corp_code", F.lit(item).alias("item"), "value")
    return pick(ec, "contract_amount").unionByName(pick(em, "decision_amount")).unionByName(co.select("corp_code", F.lit("market_cap").alias("item"), F.col("market_cap").alias("value")))


_TOKENS = "list_filter(string_split_regex(lower({}), '[^0-9a-z가-힣]+'), lambda x: x <> '')"
_BM25 = f"""
WITH q AS (SELECT DISTINCT subject AS query_id, unnest({_TOKENS.format("description")}) AS term FROM subject_area),
s AS (SELECT doc_id, {_TOKENS.format("text")} AS ts FROM documents WHERE text IS NOT NULL), z AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM s),
t AS (SELECT term, doc_id, l, count(*) AS tf FROM (SELECT doc_id, len(ts) AS l, unnest(ts) AS term FROM s) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
f AS (SELECT term, ln(1 + ((SELECT n FROM z) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t GROUP BY 1),
r AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / (SELECT al FROM z)))), 6) AS score, count(*) AS shared FROM t JOIN f USING (term) JOIN q USING (term) GROUP BY 1, 2)
"""


@query("bm25_topk", _BM25 + "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for each subject description, over whole texts: a top-k report."""
    docs, areas = tables(spark, d, "documents", "subject_area")
    queries = areas.select(F.col("subject").alias("query_id"), F.col("description").alias("text"))
    return search.top_k(search.bm25(docs.select("doc_id", "text"), queries), 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    "rank_fusion",
    _BM25
    + """, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 50),
b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id) AS rank FROM r QUALIFY rank <= 50)
SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""",
)
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings, by BM25 and by the number of shared terms, fused by reciprocal rank."""
    docs, areas = tables(spark, d, "documents", "subject_area")
    docs, queries = docs.select("doc_id", "text"), areas.select(F.col("subject").alias("query_id"), F.col("description").alias("text"))
    q = queries.select("query_id", F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("term"))
    own = docs.where("text is not null").select("doc_id", F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("term"))
    shared = own.join(q, "term").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))
    fused = search.fuse_ranks([search.top_k(search.bm25(docs, queries), 50), search.top_k(shared, 50)])
    return fused.select("query_id", "doc_id", F.round("score", 9).alias("fused"))


@query(
    "vector_topk",
    """
SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10
""",
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 50, against all rows."""
    e = table(spark, d, "embeddings")
    return search.vector_top_k(e, e.where("vec_id % 50 = 0"), 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    "evidence_json",
    """SELECT id, to_json({'doc_id': doc_id, 'title': coalesce(title, ''), 'amount': coalesce(amount_krw::VARCHAR, 'n/a'), 'period': coalesce(start_date, '') || '~' || coalesce(end_date, '')})::VARCHAR AS evidence FROM event_contract""",
)
def evidence_json(spark: SparkSession, d: str) -> DataFrame:
    """Traceable evidence of each contract as one JSON object."""
    period = F.concat(F.coalesce("start_date", F.lit("")), F.lit("~"), F.coalesce("end_date", F.lit("")))
    obj = F.struct("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.col("amount_krw").cast("string"), F.lit("n/a")).alias("amount"), period.alias("period"))
    return table(spark, d, "event_contract").select("id", F.to_json(obj).alias("evidence"))


@query(
    "answer_lines",
    "SELECT id, concat_ws(chr(10), CASE WHEN amount_krw IS NULL THEN '한계: 금액 미공개' END, '답: ' || coalesce(title, '(제목 없음)'), '근거: ' || doc_id) AS answer FROM event_contract",
)
def answer_lines(spark: SparkSession, d: str) -> DataFrame:
    """An answer block of each contract: limits first and only where there are some, then the answer, then its evidence."""
    limit = F.when(F.col("amount_krw").isNull(), "한계: 금액 미공개")
    parts = [limit, F.concat(F.lit("답: "), F.coalesce("title", F.lit("(제목 없음)"))), F.concat(F.lit("근거: "), "doc_id")]
    return table(spark, d, "event_contract").select("id", F.concat_ws("\n", *parts).alias("answer"))


@query(
    "grounding_check",
    r"""
WITH n AS (SELECT doc_id, list_distinct(flatten(list(regexp_extract_all(replace(item_value, ',', ''), '\d+')))) AS nums FROM contract_item WHERE item_value IS NOT NULL GROUP BY doc_id)
SELECT e.id, list_contains(nums, e.amount_krw::VARCHAR) AS amount_grounded, list_contains(nums, e.base_amount::VARCHAR) AS base_grounded FROM event_contract e JOIN n USING (doc_id)
""",
)
def grounding_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the amounts of a record stand in the items of its own document."""
    nums = F.explode(F.regexp_extract_all(F.replace("item_value", F.lit(",")), F.lit(r"\d+"), F.lit(0)))
    items = table(spark, d, "contract_item").where("item_value is not null")
    there = items.select("doc_id").distinct()
    ec = table(spark, d, "event_contract").select("id", "doc_id", F.col("amount_krw").cast("string").alias("a"), F.col("base_amount").cast("string").alias("b")).join(there, "doc_id")
    own = items.select("doc_id", nums.alias("n")).distinct()
    hit = lambda c, to: own.select("doc_id", F.col("n").alias(c), F.lit(True).alias(to))
    out = ec.join(hit("a", "ga"), ["doc_id", "a"], "left").join(hit("b", "gb"), ["doc_id", "b"], "left")
    say = lambda c, g: F.when(F.col(c).isNotNull(), F.coalesce(g, F.lit(False)))
    return out.select("id", say("a", "ga").alias("amount_grounded"), say("b", "gb").alias("base_grounded"))


@query(
    "missing_reasons",
    """
WITH i AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE item_value IS NOT NULL AND regexp_matches(replace(item_value, ',', ''), '^[0-9]+$')) AS readable,
 count(*) FILTER (WHERE item_value IN ('-', '–', '—', '', 'N/A', '해당사항 없음') OR item_value IS NULL) AS absent FROM contract_item WHERE contains(item_name, '계약금액') GROUP BY 1)
SELECT d.doc_id, CASE WHEN i.n IS NULL THEN 'no_item' WHEN readable > 0 THEN 'stated' WHEN absent = n THEN 'not_disclosed' ELSE 'extract_failed' END AS reason FROM (SELECT DISTINCT doc_id FROM document WHERE doc_group = 'exchange') d LEFT JOIN i USING (doc_id)
""",
)
def missing_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a document has no amount: no such item, marked as absent, or there but not readable."""
    v = F.col("item_value")
    items = table(spark, d, "contract_item").where(F.col("item_name").contains("계약금액")).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.replace(v, F.lit(",")).rlike("^[0-9]+$")).alias("readable"), F.count_if(v.isNull() | v.isin("-", "–", "—", "", "N/A", "해당사항 없음")).alias("absent"))
    docs = table(spark, d, "document").where("doc_group = 'exchange'").select("doc_id").distinct().join(items, "doc_id", "left")
    reason = F.when(F.col("n").isNull(), "no_item").when(F.col("readable") > 0, "stated").when(F.col("absent") == F.col("n"), "not_disclosed").otherwise("extract_failed")
    return docs.select("doc_id", reason.alias("reason"))


@query(
    "question_slots",
    r"""
SELECT item_id, nullif(regexp_extract(text, '(\d{4})년', 1), '') AS year, nullif(regexp_extract(text, '(\d{1,2})월', 1), '') AS month, len(regexp_extract_all(text, '\d[\d,]*백만원')) AS amounts,
 CASE WHEN contains(text, '비율') OR contains(text, '퍼센트') OR contains(text, 'percent') THEN 'ratio' WHEN contains(text, '백만원') THEN 'amount' WHEN contains(text, '착수일') THEN 'date' ELSE 'other' END AS intent FROM eval_item
""",
)
def question_slots(spark: SparkSession, d: str) -> DataFrame:
    """A rule-based reading of questions: period, amounts asked about, intent."""
    t = F.col("text")
    pick = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    intent = F.when(t.contains("비율") | t.contains("퍼센트") | t.contains("percent"), "ratio").when(t.contains("백만원"), "amount").when(t.contains("착수일"), "date").otherwise("other")
    return table(spark, d, "eval_item").select("item_id", pick(r"(\d{4})년").alias("year"), pick(r"(\d{1,2})월").alias("month"), F.size(F.regexp_extract_all(t, F.lit(r"\d[\d,]*백만원"), F.lit(0))).cast("long").alias("amounts"), intent.alias("intent"))


@query(
    "input_guard",
    r"""
SELECT item_id, CASE WHEN regexp_matches(text, '지시를? 무시|ignore (all|previous)') THEN 'instruction' WHEN regexp_matches(text, '시스템 프롬프트|system prompt') THEN 'prompt'
 WHEN regexp_matches(text, '매수|매도|추천|투자 의견') THEN 'advice' WHEN regexp_matches(text, '공시|보고서|계약|지분|예산|정정|memo|filer|annex') THEN 'filing' ELSE 'other' END AS kind FROM eval_item
""",
)
def input_guard(spark: SparkSession, d: str) -> DataFrame:
    """What a question is before anything is looked up: an attack, advice asked for, about filings, or other."""
    t = F.col("text")
    kind = (
        F.when(t.rlike("지시를? 무시|ignore (all|previous)"), "instruction").when(t.rlike("시스템 프롬프트|system prompt"), "prompt").when(t.rlike("매수|매도|추천|투자 의견"), "advice")
        .when(t.rlike("공시|보고서|계약|지분|예산|정정|memo|filer|annex"), "filing").otherwise("other")
    )
    return table(spark, d, "eval_item").select("item_id", kind.alias("kind"))


@query("label_dictionary", f"SELECT {oracle_units.label_key_sql()} AS label, item_name, count(*) AS n FROM contract_item WHERE item_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5")
def label_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of each attribute with their frequency, those seen at least five times."""
    items = table(spark, d, "contract_item").where("item_name is not null")
    return items.groupBy(label_key(F.col("item_name")).alias("label"), "item_name").agg(F.count("*").alias("n")).where("n >= 5")


@query("facts_major", oracle_facts.major())
def facts_major(spark: SparkSession, d: str) -> DataFrame:
    """Wide rows of all decisions extracted from their items."""
    items = latest_copies(table(spark, d, "major_item"), ["doc_id", "seq"], ["loaded_at", "id"]).select("doc_id", "seq", "item_name", "item_value")
    kinds = documents_once(spark, d).where("doc_group = 'major'").select("doc_id", "major_kind")
    return facts.major_facts(items, kinds)


@query("facts_holding", oracle_facts.holding())
def facts_holding(spark: SparkSession, d: str) -> DataFrame:
    """Wide rows of all holding reports extracted from their items."""
    items = latest_copies(table(spark, d, "holding_item"), ["doc_id", "seq"], ["loaded_at", "id"]).select("doc_id", "seq", "section", "item_name", "item_value")
    forms = documents_once(spark, d).where("doc_group = 'holding'").select("doc_id", facts.holding_form(F.col("report_nm")).alias("form"))
    return facts.holding_facts(items, forms).withColumn("ratio_calc", F.round("ratio_calc", 3))


@query("facts_contract", oracle_facts.contract())
def facts_contract(spark: SparkSession, d: str) -> DataFrame:
    """Contract rows from items as lines of label and value, each document named by its id; no text is put together."""
    items = latest_copies(table(spark, d, "contract_item"), ["doc_id", "seq"], ["loaded_at", "id"])
    label = F.trim(F.regexp_replace(F.regexp_extract("item_name", "([^>]*)$", 1), r"(?U)\s+", " "))
    value, at = F.coalesce("item_value", F.lit("-")), F.col("seq") * 2
    line = lambda pos, text, after: F.struct(pos.cast("int").alias("pos"), text.alias("line"), after.alias("next_line"))
    lines = items.select("doc_id", F.explode(F.array(line(at, label, value), line(at + 1, strip(value), F.lit(None).cast("string")))).alias("x")).select("doc_id", "x.*")
    names = items.select("doc_id").distinct().select("doc_id", F.lit(-2).alias("pos"), F.lit("- 체결계약명").alias("line"), F.col("doc_id").alias("next_line"))
    got = facts.line_facts(lines.unionByName(names))
    return got.withColumn("ratio_calc", F.round("ratio_calc", 3))


def relation_documents(spark: SparkSession, d: str) -> DataFrame:
    """documents in the shape that relations are built from: a correction says so in its text, the rest is in the report's name.

    Without a name, a correction has that of the filing which it says it corrects, another filing that of its first line.
    """
    docs = table(spark, d, "documents").withColumn("text", relation.one_form(F.col("text")))
    said = [F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in (r"(?U)정정(?:관련|대상)\s*공시서류\s*[:|]?\s*([^\n|]{2,40}?)\s*(?:\n|\||2\.|$)", r"(?U)^\s*([가-힣][^\n|]{1,39}?) - ")]
    docs = docs.withColumn("is_correction", F.coalesce(F.col("text").contains(relation.CORRECTION_MARK), F.lit(False)).cast("int"))
    docs = docs.withColumn("name", F.coalesce(F.nullif(F.trim("report_nm"), F.lit("")), F.when(F.col("is_correction") == 1, said[0]), said[1]))
    group, subtype, kind = relation.filing_kind(F.col("name"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "corp_code", group.alias("doc_group"), subtype.alias("doc_subtype"), kind.alias("major_kind"), "rcept_dt", "is_correction", "text")


@query("document_relations")
def document_relations(spark: SparkSession, d: str) -> DataFrame:
    """Edges from all corrections and terminations among documents to their originals, with the reason where there is none."""
    return relation.document_relations(relation_documents(spark, d))


_TARGET = r"정정관련[\s\x{00a0}\x{2002}\x{2003}\x{2009}\x{202f}\x{3000}]*공시서류[\s\x{00a0}\x{2002}\x{2003}\x{2009}\x{202f}\x{3000}]*제출일[\s\x{00a0}\x{2002}\x{2003}\x{2009}\x{202f}\x{3000}]*[:：]?[\s\x{00a0}\x{2002}\x{2003}\x{2009}\x{202f}\x{3000}]*\|?[\s\x{00a0}\x{2002}\x{2003}\x{2009}\x{202f}\x{3000}]*(\d{4})\s*[-.년월]\s*(\d{1,2})\s*[-.년월]\s*(\d{1,2})"


@query(
    "correction_targets",
    f"""
SELECT doc_id, CASE WHEN y BETWEEN 2000 AND 2030 AND m BETWEEN 1 AND 12 AND dd BETWEEN 1 AND 31 THEN y::VARCHAR || lpad(m::VARCHAR, 2, '0') || lpad(dd::VARCHAR, 2, '0') END AS target FROM (
 SELECT doc_id, try_cast(regexp_extract(h, '{_TARGET}', 1) AS INT) AS y, try_cast(regexp_extract(h, '{_TARGET}', 2) AS INT) AS m, try_cast(regexp_extract(h, '{_TARGET}', 3) AS INT) AS dd FROM (SELECT doc_id, text AS h FROM documents))
""",
)
def correction_targets(spark: SparkSession, d: str) -> DataFrame:
    """The date that each document says its correction is of."""
    return table(spark, d, "documents").select("doc_id", relation.correction_target(F.col("text"))[0].alias("target"))


@query(
    "number_fingerprint",
    r"""
WITH n AS (SELECT doc_id, corp_code, report_nm, list_distinct([replace(x, ',', '') FOR x IN regexp_extract_all(text, '\b\d{1,3}(?:,\d{3}){2,}\b')]) AS nums FROM documents WHERE text IS NOT NULL AND corp_code IS NOT NULL)
SELECT a.doc_id AS a_id, b.doc_id AS b_id, count(*) AS shared FROM (SELECT doc_id, corp_code, unnest(nums) AS x FROM n) a JOIN (SELECT doc_id, corp_code, unnest(nums) AS x FROM n) b ON a.corp_code = b.corp_code AND a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
""",
)
def number_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Filings of one company that share big numbers; the number is part of the join key."""
    docs = table(spark, d, "documents").where("text is not null and corp_code is not null")
    n = docs.select("doc_id", "corp_code", F.explode(relation.big_numbers(F.col("text"))).alias("x"))
    a, b = n.withColumnRenamed("doc_id", "a_id"), n.withColumnRenamed("doc_id", "b_id")
    return a.join(b, ["corp_code", "x"]).where("a_id < b_id").groupBy("a_id", "b_id").agg(F.count("*").alias("shared"))
