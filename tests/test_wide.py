from datetime import datetime

from pyspark.sql import functions as F

from gyeol.operators import wide

T = [datetime(2024, 1, 1), datetime(2024, 1, 2)]
FIELDS = [("amount", "계약금액(원)", "number"), ("ratio", "매출액대비(%)", "ratio"), ("day", "시작일", "date"), ("large", "대규모법인여부", "flag"), ("party", "계약상대", "text")]
SCHEMA = "doc_id string, seq int, item_name string, item_value string, loaded_at timestamp_ntz, id long, section string, field string, number string"


def run(spark, rows, keep=None, fields=FIELDS):
    df = spark.createDataFrame([(*r, "summary", "f", "n") for r in rows], SCHEMA)
    return {r.doc_id: tuple(r)[1:] for r in wide.wide_table(df, fields, keep).collect()}


def test_spelling_and_types(spark):
    rows = [
        ("d", 1, "본문 > 2. 계약내역 > 7. 계약금액（원） ", "３억 2,000만원", T[0], 1), ("d", 2, "계약내역>- 매출 액대비(%)", "7.6 %", T[0], 2), ("d", 3, "ㆍ시작일", "'24.3.1", T[0], 3),
        ("d", 4, "12. 대규모법인여부", "미해당 ", T[0], 4), ("d", 5, "계약\xa0상대", " A사 ", T[0], 5), ("d", 6, "확정 계약금액(원)", "1", T[0], 6), ("d", 7, "계약금액(원) > 비고", "1", T[0], 7),
    ]
    amount, ratio, day, large, party = run(spark, rows)["d"]
    assert (amount, str(ratio), str(day), large, party) == (320000000, "7.60", "2024-03-01", 0, "A사")


def test_which_item_counts(spark):
    rows = [
        ("d", 1, "계약금액(원)", "10", T[0], 1), ("d", 5, "계약금액(원)", "20", T[0], 2), ("d", 9, "계약금액(원)", "미정", T[0], 3),  # highest readable seq
        ("e", 1, "계약금액(원)", "10", T[0], 4), ("e", 1, "계약금액(원)", "-", T[1], 5),  # the later copy can't be read
        ("g", 1, "계약금액(원)", "10", T[0], 6), ("g", 1, "계약금액(원)", "30", T[0], 7),  # tie in time: larger id
        ("h", 1, "계약금액(원)", "10", T[0], 8), ("h", 1, "다른 이름", "30", T[1], 9),
        (None, 1, "계약금액(원)", "10", T[0], 10), ("i", 1, None, "10", T[0], 11), ("j", None, "계약금액(원)", "7", T[0], 12), ("k", 1, "계약금액(원)", None, T[0], 13), ("l", 1, "계약금액(원)", "", T[0], 14),
    ]
    got = run(spark, rows)
    assert {k: v[0] for k, v in got.items()} == {"d": 20, "g": 30, "j": 7}


def test_edges(spark):
    assert run(spark, []) == {}
    same = [("d", 1, "계약금액(원)", "10", T[0], 1)] * 3
    assert run(spark, same)["d"][0] == 10
    assert run(spark, [("d", 1, "계약금액(원)", "1" * 30_000, T[0], 1)]) == {}
    assert run(spark, [("d", 1, "계약상대", "가" * 200_000, T[0], 1)])["d"][4] == "가" * 200_000
    assert run(spark, same, keep=F.col("section") == "other") == {}
    assert run(spark, same, fields=FIELDS[:1])["d"] == (10,)


def test_unpivot_is_inverse(spark):
    rows = [("d", 1, "계약금액(원)", "10", T[0], 1), ("d", 2, "시작일", "2024-03-01", T[0], 2), ("e", 1, "매출액대비(%)", "5", T[0], 3)]
    df = spark.createDataFrame([(*r, "summary", "f", "n") for r in rows], SCHEMA)
    cells = wide.unpivot_cells(wide.wide_table(df, FIELDS), FIELDS[:4]).collect()
    assert {tuple(c) for c in cells} == {("d", "amount", "10"), ("d", "day", "20240301"), ("e", "ratio", "5.00")}


def test_balanced_join_is_shallow(spark):
    """Each table and the spine are shuffled once, by key; joining them shuffles nothing."""
    leaves = [spark.createDataFrame([(str(i % 3), i)], f"doc_id string, c{i} int") for i in range(9)]
    spine = spark.createDataFrame([("0",), ("1",), ("2",), ("3",)], "doc_id string").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    out = wide.balanced_outer_join(spine, leaves, "doc_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange hashpartitioning" in line for line in plan.split("\n")) <= len(leaves) + 3  # the spine once a leaf of the tree
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {str(k): tuple(i if i % 3 == k else None for i in range(9)) for k in range(4)}


def test_sources_keep_apart(spark):
    """Two sources with one doc_id, seq and field: each keeps its own."""
    rows = lambda v: spark.createDataFrame([("d", 1, "금액", v, "2024", 1)], "doc_id string, seq int, item_name string, item_value string, loaded_at string, id long")
    fields = [("f", "금액", "number")]
    out = wide.wide_tables({"a": (rows("1"), fields, None), "b": (rows("2"), fields, None)})
    assert [tuple(r) for n in ("a", "b") for r in out[n].collect()] == [("d", 1), ("d", 2)]
