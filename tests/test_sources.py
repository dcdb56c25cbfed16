import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from gyeol.sources import corpus, schemas, sinks

COMPANY = dict(corp_code="00126380", stock_code="005930", corp_name="가", listed_name="가", corp_eng_name="A", market="KOSPI", industry="x", sector_no=1, sector="s", listing_date="19750611",
               fiscal_month=12, market_cap=100, n_periodic=1, n_major=1, n_exchange=1, n_holding=1, note="")
DOC = dict(corp_code="00126380", corp_name="가", listed_name="가", stock_code="005930", industry="x", sector="s", flr_nm="가", rcept_dt="20240101", n_files=1)


@pytest.fixture
def root(tmp_path):
    r = tmp_path / "자료" / "corpus"
    (r / unicodedata.normalize("NFD", "raw/주요사항/문서 1")).mkdir(parents=True)
    (r / "raw/b+c").mkdir(parents=True)
    folder = r / unicodedata.normalize("NFD", "raw/주요사항/문서 1")
    (folder / "2.xml").write_bytes("<P>둘</P>".encode())
    (folder / "1.XML").write_bytes("<P>하나</P>".encode() + b"\xff")
    (folder / "3.pdf").write_bytes(b"%PDF")
    (folder / "note.txt").write_text("no")
    (r / "raw/b+c/x.html").write_text("<html><body><table><tr><td>a</td><td>1</td></tr></table></body></html>")
    (r / "universe.csv").write_text("﻿" + ",".join([*COMPANY, "extra"]) + "\n" + ",".join(map(str, [*COMPANY.values(), "e"])) + "\n", encoding="utf-8")
    docs = [
        DOC | dict(doc_id="major_1", doc_group="major", doc_subtype=None, report_nm="[첨부추가]주요사항보고서(유상증자결정)", is_correction=False, rcept_no="20240101000001", base_year=None, base_month=None, file_path="raw/주요사항/문서 1", file_format="xml"),
        DOC | dict(doc_id="periodic_2", doc_group="periodic", doc_subtype="annual", report_nm="사업보고서", is_correction=True, rcept_no="20240101000002", base_year=2025.0, base_month=12.0, file_path="raw/b+c", file_format="xml"),
        DOC | dict(doc_id="periodic_3", doc_group="periodic", doc_subtype="annual", report_nm="사업보고서", is_correction=True, rcept_no="20240101000003", base_year=2025.0, base_month=12.0, file_path="raw/none", file_format="xml"),
    ]
    (r / "manifest.jsonl").write_text("\n".join(json.dumps(d, ensure_ascii=False) for d in docs), encoding="utf-8")
    return r


def test_root(spark, root, tmp_path):
    assert corpus.corpus_root(spark, str(tmp_path)).endswith("corpus")
    (tmp_path / "자료" / "manifest.jsonl").write_text("{}")
    with pytest.raises(RuntimeError):
        corpus.corpus_root(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        corpus.corpus_root(spark, str(root / "raw"))


def test_masters(spark, root):
    c = corpus.load_companies(spark, str(root)).first()
    assert (c.corp_code, c.stock_code, c.market_cap, c.fiscal_month) == ("00126380", "005930", 100, 12)
    d = {r.doc_id: r for r in corpus.build_documents(corpus.load_manifest(spark, str(root))).collect()}
    assert d["major_1"].major_kind == "유상증자결정" and d["periodic_2"].major_kind is None
    assert (d["periodic_2"].base_year, d["periodic_2"].is_correction, d["major_1"].base_year, d["major_1"].category) == (2025, 1, None, None)


def test_missing_column(spark, root):
    (root / "universe.csv").write_text("corp_code\n1\n")
    with pytest.raises(KeyError):
        corpus.load_companies(spark, str(root))


def test_raw_documents(spark, root):
    raw = corpus.raw_documents(spark, str(root), corpus.load_manifest(spark, str(root)))
    got = {r.doc_id: r.raw for r in raw.collect()}
    assert got["major_1"] == "<P>하나</P>�<P>둘</P>" and "<table>" in got["periodic_2"] and got["periodic_3"] == ""
    texts = {r.doc_id: r.text for r in corpus.document_texts(raw).collect()}
    assert texts["periodic_2"] == "a | 1"
    files = corpus.document_files(spark, str(root)).groupBy("suffix").agg(F.count("*").alias("n")).collect()
    assert {r.suffix: r.n for r in files} == {"xml": 2, "pdf": 1, "html": 1}


def test_sinks(spark, root, tmp_path):
    out = str(tmp_path / "db")
    docs = corpus.build_documents(corpus.load_manifest(spark, str(root)))
    for _ in range(2):
        assert sinks.write_table(docs, out, "document").count() == 3
    assert spark.read.parquet(f"{out}/document.parquet").columns == schemas.column_names("document")
    sinks.reset(spark, out)
    assert spark.read.parquet(f"{out}/document.parquet").count() == 0
    assert sinks.load_report(docs, ["doc_group"]).first().n == 2


def test_schemas(spark):
    assert len(schemas.column_names("event_contract")) == 29 and len(schemas.column_names("event_major")) == 31 and len(schemas.column_names("event_holding")) == 18
    schemas.create_tables(spark, ["doc_relation"])
    assert spark.table("doc_relation").columns == schemas.column_names("doc_relation")
    spark.sql("DROP TABLE doc_relation")


def test_load_corpus(spark, root, tmp_path):
    """One call reads, types, writes and reports everything; a second one gives the same."""
    from gyeol.sources.loader import load_corpus

    (root / "raw/e").mkdir()
    body = "<P>단일판매ㆍ공급계약 체결</P><TABLE><TR><TD>- 체결계약명</TD></TR><TR><TD>배터리 공급</TD></TR><TR><TD>계약금액(원)</TD><TD>1,000</TD></TR></TABLE>"
    (root / "raw/e/1.xml").write_text(f"<html>{body}</html>", encoding="utf-8")
    more = DOC | dict(doc_id="exchange_4", doc_group="exchange", doc_subtype="단일판매공급계약체결", report_nm="단일판매ㆍ공급계약체결", is_correction=False, rcept_no="20240101000004", base_year=None, base_month=None, file_path="raw/e", file_format="xml")
    with open(root / "manifest.jsonl", "a", encoding="utf-8") as f:
        f.write("\n" + json.dumps(more, ensure_ascii=False))
    out = str(tmp_path / "db")
    first = {(r.table, r.kind): r.n for r in load_corpus(spark, str(root), out).collect()}
    assert first["document", "periodic"] == 2 and first["company", "all"] == 1 and first["contract_item", "all"] == 1 and first["event_contract", "contract"] == 1
    got = spark.read.parquet(f"{out}/event_contract.parquet").first()
    assert (got.title, got.form, got.disclosure_type, got.corp_code) == ("배터리 공급", "의무", "mandatory", "00126380")
    assert {(r.table, r.kind): r.n for r in load_corpus(spark, str(root), out).collect()} == first
