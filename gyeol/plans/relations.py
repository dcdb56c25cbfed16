"""Relations between versions of contracts, told as filings: built from the tables, linked by the library, checked by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyeol.operators import relation
from gyeol.plans.base import query
from gyeol.plans.relational import ONCE, documents_once
from gyeol.session import cut_lineage, table

SUBTYPES = {"contract": relation.CONTRACT_SUBTYPE, "termination": relation.TERMINATION_SUBTYPE, "investment": "신규시설투자등"}
#: A pointer before the corpus, and contract dates of filings that name none.
BEFORE, OLD, NEW = "20221231", "20220505", "20240505"


def version_filings(spark: SparkSession, d: str) -> DataFrame:
    """Every version of a contract as a filing with a text.

    The first version is an original. A later one is a correction that points at the version before it, at its own day where its
    ratio doesn't match (a pointer that leads nowhere), before the corpus where it has no amount, and at nothing where it has no
    signing date. A termination points at the last contract version up to its day.
    """
    dates = documents_once(spark, d).select("doc_id", "rcept_dt")
    ec = table(spark, d, "event_contract").where("title_norm is not null and corp_code is not null").join(dates, "doc_id")
    ec = ec.select("id", "corp_code", "event_type", F.md5("title_norm").alias("g"), "rcept_dt", "signed_at", "amount_krw", "ratio_match")
    w = Window.partitionBy("corp_code", "event_type", "g").orderBy("rcept_dt", "id")
    rows = ec.withColumns({"n": F.row_number().over(w), "before": F.lag("rcept_dt").over(w), "ends": F.col("event_type") == "termination"})
    # the last contract version up to a termination's day: one running maximum over both kinds of rows
    upto = Window.partitionBy("corp_code", "g").orderBy("rcept_dt").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("contract_dt", F.max(F.when(F.col("event_type") == "contract", F.col("rcept_dt"))).over(upto))
    corr = ~F.col("ends") & (F.col("n") > 1)
    points = F.when(F.col("signed_at").isNull(), None).when(F.col("ratio_match") == 0, F.col("rcept_dt")).when(F.col("amount_krw").isNull(), F.lit(BEFORE)).otherwise(F.col("before"))
    rows = rows.withColumns({"corr": corr, "ptr": F.when(F.col("ends"), F.col("contract_dt")).when(corr, points)})
    made = F.when(F.col("corr") & F.col("signed_at").isNull(), F.when(F.col("amount_krw").isNull(), OLD).otherwise(NEW))
    iso = lambda c: F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    body = F.concat(F.lit("1. 판매ㆍ공급계약 구분\n- 체결계약명 | "), "g", F.lit("\n"), F.coalesce(F.concat(F.lit("계약(수주)일자 | "), iso(made), F.lit("\n")), F.lit("")))
    head = F.concat(F.lit("정정신고(보고)\n1. 정정관련 공시서류 : 단일판매ㆍ공급계약체결\n"), F.coalesce(F.concat(F.lit("2. 정정관련 공시서류제출일 : "), iso(F.col("ptr")), F.lit("\n")), F.lit("")), F.lit("4. 정정사항\n정정항목 | 정정사유 | 정정 전 | 정정 후\n기재 오류 | 오기 | - | -\n"))
    tail = F.coalesce(F.concat(F.lit("※ 관련공시 | "), iso(F.col("ptr")), F.lit(" 단일판매ㆍ공급계약체결\n")), F.lit(""))
    text = F.when(F.col("corr"), F.concat(head, body)).when(F.col("ends"), F.concat(body, tail)).otherwise(body)
    kinds = F.create_map(*[F.lit(x) for kv in SUBTYPES.items() for x in kv])
    return rows.select(
        F.col("id").cast("string").alias("doc_id"), "corp_code", F.lit("exchange").alias("doc_group"), F.element_at(kinds, F.col("event_type")).alias("doc_subtype"), F.lit(None).cast("string").alias("major_kind"),
        "rcept_dt", F.col("corr").cast("int").alias("is_correction"), text.alias("text"))


_EDGES = f"""
WITH RECURSIVE e AS (SELECT e.id::VARCHAR AS id, e.id AS nid, e.corp_code AS corp, e.event_type AS t, md5(e.title_norm) AS g, d.rcept_dt AS dt, signed_at, amount_krw, ratio_match FROM event_contract e JOIN {ONCE} d USING (doc_id) WHERE title_norm IS NOT NULL AND e.corp_code IS NOT NULL),
v AS (SELECT *, row_number() OVER w AS n, lag(dt) OVER w AS before, (SELECT max(c.dt) FROM e c WHERE c.corp = e.corp AND c.g = e.g AND c.t = 'contract' AND c.dt <= e.dt) AS cdt FROM e WINDOW w AS (PARTITION BY corp, t, g ORDER BY dt, nid)),
docs AS (SELECT id, corp, CASE t {" ".join(f"WHEN '{k}' THEN '{x}'" for k, x in SUBTYPES.items())} END AS sub, t = 'termination' AS ends, g, dt, (t <> 'termination' AND n > 1)::INT AS corr,
 CASE WHEN t = 'termination' THEN cdt WHEN n > 1 THEN CASE WHEN signed_at IS NULL THEN NULL WHEN ratio_match = 0 THEN dt WHEN amount_krw IS NULL THEN '{BEFORE}' ELSE before END END AS ptr,
 CASE WHEN t <> 'termination' AND n > 1 AND signed_at IS NULL THEN CASE WHEN amount_krw IS NULL THEN '{OLD}' ELSE '{NEW}' END END AS made FROM v),
starts AS (SELECT *, CASE WHEN ends THEN '{relation.CONTRACT_SUBTYPE}' ELSE sub END AS want, CASE WHEN ends THEN 'termination' ELSE 'correction' END AS rel FROM docs WHERE corr = 1 OR ends),
reach(sid, day, depth) AS (SELECT id, ptr, 0 FROM starts WHERE ptr IS NOT NULL UNION SELECT r.sid, d.ptr, r.depth + 1 FROM reach r JOIN starts s ON s.id = r.sid JOIN docs d ON d.corp = s.corp AND d.dt = r.day AND d.sub = s.want AND d.corr = 1 AND d.ptr IS NOT NULL
 WHERE r.day >= '{relation.CORPUS_START}' AND r.depth < {relation.MAX_CHAIN}),
m AS (SELECT sid, day, min(depth) AS k FROM reach GROUP BY 1, 2),
hit AS (SELECT m.sid, m.day, m.k, d.id AS did, d.corr AS dcorr, d.ptr AS dptr, d.g AS dg FROM m JOIN starts s ON s.id = m.sid LEFT JOIN docs d ON d.corp = s.corp AND d.dt = m.day AND d.sub = s.want AND m.day >= '{relation.CORPUS_START}'),
lev AS (SELECT sid, min(k) FILTER (WHERE dcorr = 0) AS stop, coalesce(max(k + 1) FILTER (WHERE dcorr = 1 AND dptr IS NOT NULL), 0) AS far FROM hit GROUP BY 1),
sums AS (SELECT h.sid, stop, far, list(did) FILTER (WHERE dcorr = 0 AND k = stop) AS pool, bool_or(dcorr = 1 AND dptr IS NULL AND (stop IS NULL OR k <= stop)) AS failed, bool_or(did IS NULL AND (stop IS NULL OR k <= stop)) AS outside,
 count(DISTINCT dg) FILTER (WHERE dcorr = 0 AND k = stop) AS gs, list(did) FILTER (WHERE dcorr = 0 AND k = stop AND dg = s.g) AS own FROM hit h JOIN lev USING (sid) JOIN starts s ON s.id = h.sid GROUP BY 1, 2, 3),
got AS (SELECT s.*, coalesce(len(pool), 0) AS candidates, CASE WHEN s.ptr IS NULL THEN 0 ELSE coalesce(stop, far) END AS depth, pool, CASE WHEN gs > 1 AND len(own) = 1 THEN own[1] END AS by_field,
 CASE WHEN s.ptr IS NULL THEN 'extract_failed' WHEN len(pool) = 1 THEN NULL WHEN len(pool) > 1 THEN 'ambiguous' WHEN failed AND NOT outside THEN 'extract_failed' WHEN failed OR outside THEN 'out_of_scope' ELSE 'no_original' END AS why FROM starts s LEFT JOIN sums ON sums.sid = s.id),
lost AS (SELECT g.id, list(o.id) AS them FROM got g JOIN docs o ON o.corr = 0 AND o.corp = g.corp AND o.sub = g.want AND o.g = g.g AND o.dt < g.dt WHERE g.why = 'no_original' GROUP BY 1),
edges AS (SELECT g.id AS from_doc_id, CASE WHEN len(pool) = 1 THEN pool[1] WHEN why = 'ambiguous' THEN by_field WHEN why = 'no_original' AND len(them) = 1 THEN them[1] END AS to_doc_id, rel AS rel_type, ptr AS target_date, candidates, depth AS chain_depth,
 CASE WHEN why = 'no_original' THEN 'out_of_scope' WHEN why = 'extract_failed' AND candidates = 0 AND made < '{relation.CORPUS_START}' THEN 'out_of_scope' ELSE why END AS why,
 CASE WHEN len(pool) = 1 THEN CASE WHEN depth > 0 THEN 'chain' ELSE 'date' END WHEN why = 'ambiguous' AND by_field IS NOT NULL THEN 'fields' WHEN why = 'no_original' AND len(them) = 1 THEN 'content' END AS method FROM got g LEFT JOIN lost USING (id))
"""


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = cut_lineage(version_filings(spark, d))
    return docs, relation.document_relations(docs)


@query(
    "relation_chain",
    _EDGES + "SELECT from_doc_id, to_doc_id, rel_type, target_date, (to_doc_id IS NOT NULL)::INT AS resolved, CASE WHEN to_doc_id IS NULL THEN why END AS unresolved_reason, candidates::INT AS candidates, chain_depth, method FROM edges",
)
def relation_chain(spark: SparkSession, d: str) -> DataFrame:
    """Corrections and terminations of all contract versions linked to their originals, through chains, loops and ambiguous days."""
    return _edges(spark, d)[1].drop("target_hint")


_CHECK_SQL = {
    "every correction has an edge": "SELECT count(*) FROM docs WHERE corr = 1 AND id NOT IN (SELECT from_doc_id FROM edges WHERE rel_type = 'correction')",
    "every termination has an edge": "SELECT count(*) FROM docs WHERE ends AND id NOT IN (SELECT from_doc_id FROM edges WHERE rel_type = 'termination')",
    "from is a document": "SELECT count(*) FROM edges WHERE from_doc_id NOT IN (SELECT id FROM docs)",
    "to is a document": "SELECT count(*) FROM edges WHERE to_doc_id IS NOT NULL AND to_doc_id NOT IN (SELECT id FROM docs)",
    "resolved has a target": "SELECT 0",
    "unresolved has no target": "SELECT 0",
    "resolved has no reason": "SELECT 0",
    "unresolved has a reason": "SELECT count(*) FROM edges WHERE to_doc_id IS NULL AND why IS NULL",
    "reason vocabulary": "SELECT count(*) FROM edges WHERE to_doc_id IS NULL AND why NOT IN ('out_of_scope', 'ambiguous', 'extract_failed')",
    "correction comes from a correction": "SELECT count(*) FROM edges JOIN docs a ON a.id = from_doc_id WHERE rel_type = 'correction' AND a.corr <> 1",
    "target is an original": "SELECT count(*) FROM edges JOIN docs b ON b.id = to_doc_id WHERE b.corr <> 0",
    "same company": "SELECT count(*) FROM edges JOIN docs a ON a.id = from_doc_id JOIN docs b ON b.id = to_doc_id WHERE a.corp <> b.corp",
    "target comes no later": "SELECT count(*) FROM edges JOIN docs a ON a.id = from_doc_id JOIN docs b ON b.id = to_doc_id WHERE b.dt > a.dt",
    "same subtype and kind": "SELECT count(*) FROM edges JOIN docs a ON a.id = from_doc_id JOIN docs b ON b.id = to_doc_id WHERE rel_type = 'correction' AND a.sub <> b.sub",
    "termination ends a contract": f"SELECT count(*) FROM edges JOIN docs b ON b.id = to_doc_id WHERE rel_type = 'termination' AND b.sub <> '{relation.CONTRACT_SUBTYPE}'",
    "not another contract": "SELECT 0",
    "linked by content shares an identity": "SELECT count(*) FROM edges JOIN docs a ON a.id = from_doc_id JOIN docs b ON b.id = to_doc_id WHERE method = 'content' AND a.g <> b.g",
    "no edge to itself": "SELECT count(*) FROM edges WHERE from_doc_id = to_doc_id",
    "no mutual edges": "SELECT count(*) FROM edges x JOIN edges y ON x.from_doc_id = y.to_doc_id AND x.to_doc_id = y.from_doc_id",
    "out of scope has no original on its day": "SELECT count(*) FROM edges JOIN starts s ON s.id = from_doc_id AND s.rel = rel_type JOIN docs o ON o.corp = s.corp AND o.dt = target_date AND o.sub = s.want AND o.corr = 0 WHERE to_doc_id IS NULL AND why = 'out_of_scope'",
    "depth within the cap": f"SELECT count(*) FROM edges WHERE chain_depth > {relation.MAX_CHAIN}",
}


@query("relation_checks", _EDGES + " UNION ALL ".join(f"SELECT '{name}' AS check_name, ({sql})::BIGINT AS violations, (SELECT count(*) FROM edges) AS n" for name, sql in _CHECK_SQL.items()))
def relation_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks that edges must pass, one row each with its violations."""
    docs, edges = _edges(spark, d)
    return relation.edge_checks(cut_lineage(edges), docs)
