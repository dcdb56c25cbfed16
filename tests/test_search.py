import math
import random
from collections import Counter

import numpy as np

from gyeol.operators import search


def test_bm25_against_brute_force(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice(["가", "나", "다", "ab", "C1"]) for _ in range(rnd.randrange(0, 9)))) for i in range(40)] + [(99, None), (98, "")]
    queries = [("q1", "가 ab"), ("q2", "c1 c1 없음")]
    got = {(r.query_id, r.doc_id): r.score for r in search.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id string, text string")).collect()}
    live = {i: t.lower().split() for i, t in docs if t is not None}
    avg = sum(map(len, live.values())) / len(live)
    want = {}
    for q, text in queries:
        for term in set(text.lower().split()):
            df = sum(term in t for t in live.values())
            for i, t in live.items():
                if tf := Counter(t)[term]:
                    want[q, i] = want.get((q, i), 0) + math.log(1 + (len(live) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 8)).astype(np.float32)
    m[5] = m[6]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = search.vector_top_k(df, df.where("vec_id % 10 = 0"), 4).collect()
    n = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = np.round(n @ n[q], 6)
        want = sorted(range(60), key=lambda i: (-s[i], i))[:4]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert search.vector_top_k(df, df.limit(0), 4).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id long, rank int")
    b = spark.createDataFrame([("q", 2, 1)], "query_id string, doc_id long, rank int")
    got = {r.doc_id: r.score for r in search.fuse_ranks([a, b]).collect()}
    assert math.isclose(got[2], 1 / 61 + 1 / 62) and math.isclose(got[1], 1 / 61)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_similar_pairs_against_all_pairs(spark):
    import random

    from gyeol.operators import search

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("가나다라ab") for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 14])))
    a, b = {word() for _ in range(90)}, {word() for _ in range(90)}
    b |= {x[1:] + "다" for x in a} | {x[:2] + "zz" + x[2:] for x in a}
    left, right = spark.createDataFrame([(x,) for x in [*a, None]], "name string"), spark.createDataFrame([(x,) for x in [*b, None]], "other string")
    for limit in (1, 4):
        got = sorted(tuple(r) for r in search.similar_pairs(left, right, limit).collect())
        assert got == sorted((x, y, edits(x, y)) for x in a for y in b if edits(x, y) <= limit)


def test_names_that_differ_at_the_start_are_found(spark, tmp_path):
    from gyeol.plans import registry

    spark.createDataFrame([("1", "가람건설", "가람", "건설"), ("2", "아람건설", None, "건설"), ("3", "대한전력반도체", None, None)], "corp_code string, corp_name string, listed_name string, sector string").write.parquet(f"{tmp_path}/company.parquet")
    spark.createDataFrame([("나람건설",), ("가람건설",), ("대한전력반도채홀",), ("전혀 다른 이름의 보고자",), (None,)], "flr_nm string").write.parquet(f"{tmp_path}/document.parquet")
    q = registry.queries()
    assert [tuple(r) for r in q["similar_names"](spark, str(tmp_path)).collect()] == [("가람건설", "아람건설", 1)]
    got = {(r.name, r.corp_code): (r.dist, r["rank"]) for r in q["entity_candidates"](spark, str(tmp_path)).collect()}
    assert got == {("나람건설", "1"): (1, 1), ("나람건설", "2"): (1, 1), ("대한전력반도채홀", "3"): (2, 1)}
