import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gyeol.llm import mixing

SCHEMA = "doc_id long, source string, n_tokens long, w double, copies int"
GOAL = [("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 10)]


def mix(spark, rows, goal=GOAL, **k):
    t = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    taken, shares = mixing.mix(t, spark.createDataFrame(goal, "source string, target_share double, max_repeat int"), **k)
    return taken.collect(), {r.source: r for r in shares.collect()}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    return [(i, rnd.choice(["a", " A", "b", "b", "b", "b", "c", "x", None]), rnd.choice([0, 10, 20, 300]), rnd.choice([0.5, 1.0, 4.0])) for i in range(3000)]


def test_shares_and_caps(spark, rows):
    taken, shares = mix(spark, rows)
    for s, share, cap in GOAL:
        assert abs(shares[s].actual_share - share) < 0.002
        assert shares[s].max_copies <= cap
    assert shares["(other)"].mixed_tokens == 0 and shares["(other)"].available_tokens > 0
    caps = {s: c for s, _, c in GOAL}
    assert all(1 <= r.copies <= caps[r.source] and r.n_tokens > 0 for r in taken)
    assert len({r.doc_id for r in taken}) == len(taken)
    # copies of one source differ by one at the most: certain ones, and one by chance
    for s in caps:
        assert len({r.copies for r in taken if r.source == s}) <= 2
    assert sum(r.copies * r.n_tokens for r in taken if r.source == "b") == shares["b"].mixed_tokens


def test_repeatable_and_seeded(spark, rows):
    one, two, three = (sorted((r.doc_id, r.copies) for r in mix(spark, rows, seed=s)[0]) for s in (1, 1, 2))
    assert one == two != three


def test_total_and_weights(spark, rows):
    taken, shares = mix(spark, rows, total_tokens=20_000, weight="w")
    for s, share, _ in GOAL:
        assert abs(shares[s].mixed_tokens - share * 20_000) <= 300
    w = {i: x for i, _, _, x in rows}
    b = [r.doc_id for r in taken if r.source == "b"]
    there = [i for i, s, n, x in rows if s == "b" and n]
    rate = lambda x: sum(w[i] == x for i in b) / sum(w[i] == x for i in there)
    assert rate(4.0) > 2 * rate(0.5) > 0


def test_cases(spark):
    assert mix(spark, [])[0] == []
    taken, shares = mix(spark, [(1, "a", 100, 1.0), (None, "a", 5, 1.0), (2, None, 5, 1.0), (3, "a", 0, 1.0)])
    assert [(r.doc_id, r.copies) for r in taken] == [(1, 2)] and shares["b"].mixed_tokens == 0
    assert mix(spark, [(1, "a", 100, 1.0)], goal=[])[0] == []
    taken, _ = mix(spark, [(1, "a", 10, 1.0)] * 4 + [(2, "b", 10, 1.0)] * 4)
    assert len(taken) == 8


def reference():
    path, pattern = mixing.tokenizer_file()
    data = open(path, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), mixing.token_counter(data, pattern)


ENC, COUNT = reference()


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("가나 다1,2.\n\n\t\xa0　ab'sｔ-😀​ \r\x85\x1c"), max_size=60))
def test_token_counts(text):
    assert COUNT(text) == len(ENC.encode_ordinary(text))


def test_count_tokens(spark):
    df = spark.createDataFrame([(1, "안녕 hello", 5, {"k": 1}), (2, None, 5, None), (3, "", 5, None), (4, "a " * 200_000, 5, None)], "doc_id long, text string, n_tokens long, m map<string,int>")
    got = {r.doc_id: r.n_tokens for r in mixing.count_tokens(df, *mixing.tokenizer_file()).collect()}
    assert got == {1: len(ENC.encode_ordinary("안녕 hello")), 2: 0, 3: 0, 4: len(ENC.encode_ordinary("a " * 200_000))}


def test_no_source_is_gathered(spark, rows):
    t = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    taken, _ = mixing.mix(t, spark.createDataFrame(GOAL, "source string, target_share double, max_repeat int"))
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan and taken.select(F.sum("copies")).first()[0] > 0
