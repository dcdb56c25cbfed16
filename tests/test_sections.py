"""Sections and chunks: every character once, tables whole, headers in front."""

from gyeol.operators import sections

RAW = ("<DOCUMENT><TITLE>머리</TITLE><P>앞글</P><SECTION-2><TITLE>I. 개요</TITLE><P>하나</P><TABLE><TR><TD>a</TD><TD>1</TD></TR><TR><TD>b</TD><TD>2</TD></TR></TABLE><P>둘</P></SECTION-2>"
       "<SECTION-2 X='1'><TITLE>II. <b>사업</b></TITLE>" + "".join(f"<P>문단 {i} 내용입니다</P>" for i in range(20)) + "<TABLE>" + "<TR><TD>긴 표</TD></TR>" * 40 + "</TABLE></SECTION-2></DOCUMENT>")  # fmt: skip
SCHEMA = "doc_id string, corp string, raw string"


def run(spark, rows, limit):
    return [r.asDict() for r in sections.chunks(spark.createDataFrame(rows, SCHEMA), ["corp"], limit).orderBy("doc_id", "section_no", "chunk_no").collect()]


def test_chunks(spark):
    got = run(spark, [("d", "가", RAW)], 60)
    assert [r["title"] for r in got if r["chunk_no"] == 0] == [None, "I. 개요", "II. 사업"]
    assert got[1]["text"].split("\n")[0] == "가 | I. 개요" and "a | 1\nb | 2" in got[1]["text"]
    tables = [r for r in got if "긴 표" in r["text"]]
    assert len(tables) == 1 and tables[0]["is_table"] and tables[0]["text"].count("긴 표") == 40
    assert all(r["n_chars"] <= 60 for r in got if not r["is_table"])
    parts = "\n".join(r["text"].split("\n", 1)[1] for r in got if r["section_no"] == 2)
    assert [x for x in parts.split("\n") if x.startswith("문단")] == [f"문단 {i} 내용입니다" for i in range(20)]


def test_cases(spark):
    assert run(spark, [("d", "가", None), ("e", None, ""), ("f", "x", "<P></P>")], 100) == []
    got = run(spark, [("d", None, "plain text only")], 100)
    assert [(r["title"], r["text"]) for r in got] == [(None, "\nplain text only")]
    assert run(spark, [], 100) == []
