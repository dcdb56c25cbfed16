import random

from pyspark.sql import functions as F

from gyeol.llm import survivors

SCHEMA = "g string, h string, dt string, id long, amount long, keep string"


def run(spark, rows, salts=4):
    order = [F.col("dt").desc_nulls_last(), F.col("id").desc_nulls_last()]
    criteria = {"keep": F.lit(True), "paid": F.col("amount") > 0}
    out = survivors.ranked_survivors(spark.createDataFrame(rows, SCHEMA), ["g", "h"], order, criteria, "id", salts).collect()
    return {(r.g, r.h): (r.group_rows, r.keep.id, r.paid and r.paid.id) for r in out}


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aab"), rnd.choice(["x", "y", None]), rnd.choice(["1", "2", None]), i, rnd.choice([None, 0, 5]), "z") for i in range(400)]
    want = {}
    for g in "ab":
        for h in "xy":
            own = sorted((r for r in rows if r[0] == g and r[1] == h), key=lambda r: (r[2] or "", r[3]), reverse=True)
            want[g, h] = (len(own), own[0][3], next((r[3] for r in own if r[4] and r[4] > 0), None))
    assert run(spark, rows) == want
    assert run(spark, rows, salts=1) == want


def test_cases(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", None, "1", 1, 1, "")]) == {}
    assert run(spark, [("a", "x", None, 7, None, "")]) == {("a", "x"): (1, 7, None)}
    assert run(spark, [("a", "x", "1", 7, 1, "")] * 3)["a", "x"][1:] == (7, 7)


def test_best_values(spark):
    rows = [("a", "x", "1", 1, 9, "old"), ("a", "x", "2", 2, None, "new"), ("a", "x", "3", 3, 0, None)]
    order = F.struct("dt", "id")
    out = survivors.best_values(spark.createDataFrame(rows, SCHEMA), ["g", "h"], order, {"amount": F.col("amount") > 0, "keep": F.col("keep").isNotNull(), "id": F.lit(True)}).first()
    assert (out.group_rows, out.amount, out.keep, out.id) == (3, 9, "new", 3)


def test_real_day(spark):
    df = spark.createDataFrame([("20240229",), ("20230229",), ("99991399",), ("2025",), ("-",), (None,), ("00000000",)], "d string")
    assert [r[0] for r in df.select(survivors.real_day("d")).collect()] == [True, False, False, False, False, False, False]


def test_null_keys_are_records_and_preferred_rows_come_first(spark):
    rows = [("a", "x", "1", 1, 9, "old"), ("a", "x", "2", 2, 0, "new"), ("a", None, "3", 3, 5, "p"), ("a", None, "4", 4, 6, "q"), (None, "x", "5", 5, 7, "r")]
    df = spark.createDataFrame(rows, SCHEMA)
    fields = {"id": F.lit(True), "keep": F.col("keep").isNotNull(), "amount": F.col("amount").isNotNull()}
    out = survivors.best_values(df, ["g", "h"], F.struct("dt", "id"), fields, uid="id", prefer={"keep": F.col("amount") > 0})
    assert sorted((r.id, r.group_rows, r.keep, r.amount) for r in out.collect()) == [(2, 2, "old", 0), (3, 1, "p", 5), (4, 1, "q", 6), (5, 1, "r", 7)]


def test_survivors_have_every_column_and_every_row(spark):
    from gyeol.llm import queries
    from gyeol.session import table

    d = "/root/testdata/sf0.01"
    ec, out = table(spark, d, "event_contract"), queries.p5_survivors(spark, d)
    assert set(ec.columns) <= set(out.columns)
    out = out.cache()
    assert out.agg(F.sum("group_rows")).first()[0] == ec.count()
    assert out.where("title_key is null").count() == ec.where("title_norm is null").count() > 0
    for c in ("amount_fixed", "amount_cond", "ratio_calc", "ratio_match", "hold_until", "doc_id", "is_correction", "loaded_at"):
        assert out.where(F.col(c).isNotNull()).count() > 0, c
    # a contract with one row keeps what the row has
    one = out.where("group_rows = 1").select("id", "ratio_calc").join(ec.select("id", F.col("ratio_calc").alias("own")), "id")
    assert one.where("not ratio_calc <=> own").count() == 0
    out.unpersist()
