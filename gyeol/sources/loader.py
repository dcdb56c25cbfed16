"""Loading a corpus as a whole: masters, items, facts and relations read, typed, written and reported in one call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.operators import facts, grids, relation
from gyeol.operators.wide import union_all
from gyeol.sources import corpus, sinks
from gyeol.sources.schemas import TABLES

EVENTS = {"단일판매공급계약체결": "contract", "단일판매공급계약해지": "termination", "신규시설투자등": "investment"}


def _typed(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table's schema in order, each of its type; a number stands for its row by hash of the rest where an id is missing."""
    own = [c.split() for c in TABLES[name].split(", ")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind.lower()).alias(c) for c, kind in own])


def _keyed(df: DataFrame, *by: str) -> DataFrame:
    """A row id that a repeated load gives again: a hash of the key."""
    return df.withColumn("id", F.xxhash64(*by))


def load_corpus(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Read the corpus below ``root`` and write all its tables below ``out``; returns (table, kind, n), what was loaded.

    A repeated load gives the same tables. Documents without files have no items; a contract text without a form has no fact row.
    """
    company = sinks.write_table(corpus.load_companies(spark, root), out, "company")
    manifest = corpus.load_manifest(spark, root)
    document = sinks.write_table(corpus.build_documents(manifest), out, "document")
    raw = corpus.raw_documents(spark, root, manifest).join(document.select("doc_id", "corp_code", "doc_group", "doc_subtype", "major_kind", "report_nm", "rcept_dt", "is_correction"), "doc_id")
    of = lambda group: raw.where(F.col("doc_group") == group)
    written = {"company": (company, None), "document": (document, F.col("doc_group"))}

    def keep(name: str, df: DataFrame, kind: Column | None = None) -> DataFrame:
        back = sinks.write_table(_typed(df, name), out, name)
        written[name] = (back, kind)
        return back

    group = {"contract_item": "exchange", "major_item": "major"}
    items = {name: keep(name, _keyed(grids.table_items(grids.grid_rows(of(g), "doc_id", "raw")), "doc_id", "seq")) for name, g in group.items()}
    held = keep("holding_item", _keyed(grids.holding_items(grids.grid_rows(of("holding"), "doc_id", "raw")), "doc_id", "seq"), F.col("section"))
    own = document.select("doc_id", "corp_code", "doc_subtype", "report_nm", "is_correction")
    kinds = F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])
    contracts = facts.contract_facts(corpus.document_texts(of("exchange"))).where("form <> ''").join(own, "doc_id")
    contracts = contracts.withColumns({"event_type": F.try_element_at(kinds, F.col("doc_subtype")), "disclosure_type": F.when(F.col("report_nm").contains("자율공시"), "voluntary").otherwise("mandatory")})
    keep("event_contract", _keyed(contracts, "doc_id"), F.col("event_type"))
    majors = facts.major_facts(items["major_item"], document.where("doc_group = 'major'").select("doc_id", "major_kind")).join(own.select("doc_id", "corp_code", "is_correction"), "doc_id")
    keep("event_major", _keyed(majors, "doc_id"), F.col("major_kind"))
    forms = document.where("doc_group = 'holding'").select("doc_id", facts.holding_form(F.col("report_nm")).alias("form"))
    keep("event_holding", _keyed(facts.holding_facts(held, forms).join(own.select("doc_id", "corp_code", "is_correction"), "doc_id"), "doc_id"), F.col("form"))
    texts = corpus.document_texts(raw).withColumn("text", relation.one_form(F.col("text"))).join(document.select(*relation.KEYS), "doc_id")
    keep("doc_relation", relation.document_relations(texts.select(*relation.KEYS, "text")), F.coalesce("unresolved_reason", F.lit("resolved")))
    return union_all([sinks.load_report(df.select((F.lit("all") if kind is None else kind).alias("kind")), ["kind"]).select(F.lit(name).alias("table"), F.col("kind").cast("string").alias("kind"), "n") for name, (df, kind) in written.items()])
