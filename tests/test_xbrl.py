from gyeol.operators import xbrl

AXIS = "ifrs-full_ConsolidatedAndSeparateFinancialStatementsAxis_ifrs-full_"
RAW = f"""<TITLE>2-2. 연결 손익계산서</TITLE><TABLE><TR><TD>매출액</TD>
<TE ACODE="ifrs-full_Revenue" ACONTEXT="CFY2024dFY_{AXIS}ConsolidatedMember" ADECIMAL="-6">107,448,752</TE>
<TE ACODE="ifrs-full_Revenue" ACONTEXT="PFY2023dFY_{AXIS}ConsolidatedMember" ADECIMAL="-6">(5)</TE></TR></TABLE>
<TITLE>4. 영업부문</TITLE><TABLE><TR><TE ACODE="ifrs-full_Revenue" ACONTEXT="CFY2024dFY_{AXIS}ConsolidatedMember_ifrs-full_SegmentConsolidationItemsAxis_x" ADECIMAL="-3">1</TE>
<TU AUNIT="PERIODTO" AUNITVALUE="20231231">2023년 12월 31일</TU></TR></TABLE>"""


def test_cells_and_statement(spark):
    docs = spark.createDataFrame([("d", RAW), ("e", None), ("f", "")], "doc_id string, raw string")
    cells = xbrl.tagged_cells(docs, "doc_id", "raw")
    rows = cells.orderBy("pos").collect()
    assert len(rows) == 4 and rows[3].aunitvalue == "20231231" and rows[0].title == "2-2. 연결 손익계산서"
    got = {(r.year, r.basis, r.instant): r.value for r in xbrl.statement_values(cells).collect()}
    assert got == {(2024, "consolidated", False): 107448752000000, (2023, "consolidated", False): -5000000}


def test_labels(spark):
    df = spark.createDataFrame([("t", "매출액 (주석 4)")] * 4 + [("t", "매출액"), ("t", "수익")], "acode string, label string")
    assert [tuple(r) for r in xbrl.tag_labels(df, "label").collect()] == [("t", "매출액", 5)]


def test_tables_are_read_like_their_tags(spark):
    from gyeol.operators import grids

    raw = RAW.replace("<TABLE><TR><TD>매출액</TD>", "<TABLE><TR><TD>(단위 : 백만원)</TD></TR><TR><TD>과목</TD><TD>당기</TD><TD>2023년</TD></TR><TR><TD>매출액 (주석 4)</TD>", 1)
    docs = spark.createDataFrame([("d", raw), ("e", None)], "doc_id string, raw string")
    years = spark.createDataFrame([("d", 2024)], "doc_id string, year int")
    read = xbrl.table_values(grids.grid_rows(docs, "doc_id", "raw"), years)
    assert {(r.label, r.year): r.value for r in read.collect()} == {("매출액", 2024): 107448752000000, ("매출액", 2023): -5000000}
    tagged = xbrl.statement_values(xbrl.tagged_cells(docs, "doc_id", "raw"))
    names = spark.createDataFrame([("ifrs-full_Revenue", "매출액", 5)], "acode string, label string, n long")
    assert [tuple(r) for r in xbrl.score_tables(read, tagged, names).collect()] == [("ifrs-full_Revenue", 2, 2, 0)]
