"""Literal correction graphs, each with the edge it must give."""

import pytest
from pyspark.sql import functions as F

from gyeol.operators import relation

SUB = "단일판매공급계약체결"


def doc(i, corp, dt, corr=0, text="", sub=SUB, group="exchange", kind=None):
    return (i, corp, group, sub, kind, dt, corr, text)


def pointer(date, body="", corrected=""):
    d = f"{date[:4]}-{date[4:6]}-{date[6:]}"
    return f"정정신고(보고)\n1. 정정관련 공시서류 단일판매ㆍ공급계약 체결\n2. 정정관련 공시서류제출일 {d}\n4. 정정사항\n{corrected}\n1. 판매ㆍ공급계약 구분\n{body}"


def body(name=None, order=None, start=None):
    out = "1. 판매ㆍ공급계약 구분\n"
    out += f"- 체결계약명 | {name}\n" if name else ""
    out += f"시작일 | {start}\n" if start else ""
    out += f"계약(수주)일자 | {order}\n" if order else ""
    return out


CASES = {
    "r1": ([doc("r1o", "r1", "20240101", text="본문"), doc("r1c", "r1", "20240201", 1, pointer("20240101"))], ("r1o", 1, None, 1, 0)),
    "r2": ([doc("r2o", "r2", "20240101"), doc("r2m", "r2", "20240110", 1, pointer("20240101")), doc("r2c", "r2", "20240201", 1, pointer("20240110"))], ("r2o", 1, None, 1, 1)),
    "r3": (
        [doc("r3o", "r3", "20240101"), doc("r3a", "r3", "20240110", 1, pointer("20240101")), doc("r3b", "r3", "20240110", 1, pointer("20240101")), doc("r3c", "r3", "20240201", 1, pointer("20240110"))],
        ("r3o", 1, None, 1, 1),
    ),
    "r4": (
        [doc("r4a", "r4", "20240101", text="금액 1,234,567,890"), doc("r4b", "r4", "20240101", text="금액 9,876,543,210"), doc("r4c", "r4", "20240201", 1, pointer("20240101", corrected="정정사유 1,234,567,890"))],
        ("r4a", 1, None, 2, 0),
    ),
    "r5": (
        [doc("r5a", "r5", "20240101", text=body("X", start="2024-01-05")), doc("r5b", "r5", "20240101", text=body("X", start="2024-03-05")), doc("r5c", "r5", "20240201", 1, pointer("20240101", body("X", start="2024-03-05")))],
        ("r5b", 1, None, 2, 0),
    ),
    "r6": ([doc("r6a", "r6", "20240101", text=body("X")), doc("r6b", "r6", "20240101", text=body("X")), doc("r6c", "r6", "20240201", 1, pointer("20240101", body("X")))], (None, 0, "ambiguous", 2, 0)),
    "r7": ([doc("r7c", "r7", "20240201", 1, pointer("20221231"))], (None, 0, "out_of_scope", 0, 0)),
    "r8": ([doc("r8c", "r8", "20240201", 1, pointer("20240105"))], (None, 0, "out_of_scope", 0, 0)),
    "r9": ([doc("r9o", "r9", "20230523", text=body("배터리 공급")), doc("r9c", "r9", "20241022", 1, pointer("20241022", body("배터리 공급")))], ("r9o", 1, None, 0, 1)),
    "r10": ([doc("r10o", "r10", "20230523", text=body("다른 것")), doc("r10c", "r10", "20241022", 1, pointer("20241022", body("배터리 공급")))], (None, 0, "out_of_scope", 0, 1)),
    "r11": ([doc("r11c", "r11", "20240201", 1, "정정신고\n" + body(order="2020-11-19"))], (None, 0, "out_of_scope", 0, 0)),
    "r12": ([doc("r12o", "r12", "20240101", text=body("가", "2023-12-22")), doc("r12c", "r12", "20240201", 1, pointer("20240101", body("나", "2022-01-10")))], (None, 0, "out_of_scope", 0, 0)),
    "r13": ([doc("r13o", "r13", "20240101", text=body("가", "2023-12-22")), doc("r13c", "r13", "20240201", 1, pointer("20240101", body("가 사업", "2023-12-22")))], ("r13o", 1, None, 1, 0)),
    "r15": ([doc("r15o", "r15", "20240101", sub="신규시설투자등"), doc("r15c", "r15", "20240201", 1, pointer("20240101"))], (None, 0, "out_of_scope", 0, 0)),
    "r16": ([doc("r16m", "r16", "20240110", 1, "정정신고\n" + body(order="2023-05-05")), doc("r16c", "r16", "20240201", 1, pointer("20240110", body(order="2023-05-05")))], (None, 0, "extract_failed", 0, 0)),
    "r17": ([doc("r17c", "r17", "20240201", 1, "")], (None, 0, "extract_failed", 0, 0)),
}
ENDS = [
    doc("t1o", "t1", "20240101"), doc("t1m", "t1", "20240301", 1, pointer("20240101")),
    doc("t1c", "t1", "20240601", 0, "※ 관련공시 | 2024-03-01 단일판매ㆍ공급계약체결", sub="단일판매공급계약해지"),
    doc("t2c", "t2", "20240601", 0, "", sub="단일판매공급계약해지"),
    doc("t3c", "t3", "20240601", 0, "본 건은 2022년 10월 15일 공시한 계약의 해지", sub="단일판매공급계약해지"),
]
SCHEMA = "doc_id string, corp_code string, doc_group string, doc_subtype string, major_kind string, rcept_dt string, is_correction int, text string"


@pytest.fixture(scope="module")
def edges(spark):
    docs = [d for rows, _ in CASES.values() for d in rows] + ENDS
    out = relation.document_relations(spark.createDataFrame(docs, SCHEMA)).collect()
    return {(r.rel_type, r.from_doc_id): (r.to_doc_id, r.resolved, r.unresolved_reason, r.candidates, r.chain_depth) for r in out}


@pytest.mark.parametrize("name", CASES)
def test_correction(edges, name):
    assert edges["correction", f"{name}c"] == CASES[name][1]


def test_terminations(edges):
    assert edges["termination", "t1c"] == ("t1o", 1, None, 1, 1)
    assert ("termination", "t2c") not in edges
    assert edges["termination", "t3c"][1:3] == (0, "out_of_scope")


def test_cycle_ends(spark):
    docs = [doc("a", "z", "20240101", 1, pointer("20240201")), doc("b", "z", "20240201", 1, pointer("20240101"))]
    out = relation.document_relations(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.unresolved_reason for r in out} == {"out_of_scope"}


def test_empty(spark):
    assert relation.document_relations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parsers(spark):
    text = "정정대상 공시서류 : 제51기 사업보고서 2.\n정정대상 공시서류의 최초제출일 : 2025년 08년 28일"
    d, h = relation.correction_target(F.lit(text))
    r = spark.range(1).select(d.alias("d"), h.alias("h"), relation.corrected_fields(F.lit("4. 정정사항\n5. 계약기간 | x\n1. 제목")).alias("c")).first()
    assert (r.d, r.h) == ("20250828", "제51기 사업보고서")
    assert set(r.c) == {"시작일", "종료일"}


def relate(spark, folder, docs):
    """Edges of the registered query over a documents table of (doc_id, corp_code, report_nm, rcept_dt, text)."""
    from gyeol.plans import registry

    spark.createDataFrame(docs, "doc_id long, corp_code string, report_nm string, rcept_dt string, text string").write.parquet(f"{folder}/documents.parquet")
    return {(r.rel_type, r.from_doc_id): (r.to_doc_id, r.unresolved_reason, r.target_date) for r in registry.queries()["document_relations"](spark, str(folder)).collect()}


def test_query_reaches_terminations_and_kinds(spark, tmp_path):
    docs = [
        (1, "c", "단일판매ㆍ공급계약체결", "20240101", body("X", "2023-12-30")),
        (2, "c", "신규시설투자등", "20240101", "본문"),
        (3, "c", "[기재정정]단일판매ㆍ공급계약체결(자율공시)", "20240301", pointer("20240101", body("X", "2023-12-30"))),
        (4, "c", "단일판매·공급계약해지", "20240601", "※ 관련공시 | 2024-03-01 단일판매ㆍ공급계약체결"),
        (5, "c", "주요사항보고서(유상증자결정)", "20240201", "본문"), (6, "c", "주요사항보고서(자기주식처분결정)", "20240201", "본문"),
        (7, "c", "[기재정정]주요사항보고서(유상증자결정)", "20240401", "정정신고(보고)\n1. 정정관련 공시서류 : 주요사항보고서\n2. 정정관련 공시서류제출일 : 2024-02-01"),
        (8, "c", None, "20240401", "정정신고(보고)\n1. 정정관련 공시서류 : 신규시설투자등\n2. 정정관련 공시서류제출일 : 2024-01-01"),
    ]
    got = relate(spark, tmp_path, docs)
    assert {k: v[0] for k, v in got.items()} == {("correction", "3"): "1", ("termination", "4"): "1", ("correction", "7"): "5", ("correction", "8"): "2"}


def test_query_reads_texts_in_other_character_forms(spark, tmp_path):
    import unicodedata

    wide = str.maketrans({c: chr(ord(c) + 0xFEE0) for c in "0123456789()-:"})
    text = pointer("20240101", body("X", "2023-12-30"))
    docs = [(1, "c", "단일판매ㆍ공급계약체결", "20240101", body("X", "2023-12-30"))]
    docs += [(k, "c", "단일판매ㆍ공급계약체결", f"2024020{k}", t) for k, t in ((2, unicodedata.normalize("NFD", text)), (3, text.translate(wide)), (4, text.replace("신고", "신\u200b고").replace(" ", "\u2009")))]
    assert relate(spark, tmp_path, docs) == {("correction", str(k)): ("1", None, "20240101") for k in (2, 3, 4)}


def test_whole_texts_are_read(spark, tmp_path):
    from gyeol.plans import registry

    far = "가나다 라마바 " * 20_000
    docs = [(1, "c", "단일판매ㆍ공급계약체결", "20240101", "본문" + far + "금액 1,234,567,890"), (2, "c", "단일판매ㆍ공급계약체결", "20240201", far + "\n" + pointer("20240101") + "\n금액 1,234,567,890")]
    assert relate(spark, tmp_path, docs) == {("correction", "2"): ("1", None, "20240101")}
    run = lambda name: sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert run("correction_targets") == [(1, None), (2, "20240101")]
    assert run("number_fingerprint") == [(1, 2, 1)]
    got = spark.createDataFrame([(far + "계약(수주)일자 | 2020-11-19",)], "t string").select(relation.contract_date(F.col("t"))).first()[0]
    assert got == "20201119"
