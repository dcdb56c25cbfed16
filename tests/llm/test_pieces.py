import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gyeol.llm import pieces

T = [datetime(2024, 1, 1), datetime(2024, 1, 2)]
SCHEMA = "doc_id string, section string, seq int, item_name string, item_value string, loaded_at timestamp_ntz, id long, sec int, text int"


def run(spark, rows, limit=60, overlap=10, segment=200, paths=()):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    p = spark.createDataFrame(list(paths), "doc_id string, file_path string, sec string")
    out = pieces.split_sections(df, p, limit, overlap, segment).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.piece_no):
        got.setdefault((r.doc_id, r.section), []).append(r)
    return got


def whole(rows):
    live = {}
    for d, s, q, n, v, at, i in rows:
        if d is not None and ((d, q) not in live or (at, i) > live[d, q][0]):
            live[d, q] = ((at, i), s, n, v)
    out = {}
    for (d, q), (_, s, n, v) in sorted(live.items(), key=lambda x: (x[0][0], -1 if x[0][1] is None else x[0][1])):
        out[d, s] = out.get((d, s), "") + f"{n or ''}: {v or ''}\n"
    return out


def check(spark, rows, limit=60, overlap=10, segment=200):
    got, texts = run(spark, rows, limit, overlap, segment), whole(rows)
    assert set(got) == {k for k, t in texts.items() if len(t) > limit}
    for k, ps in got.items():
        at, text = 0, texts[k]
        assert [p.piece_no for p in ps] == list(range(1, len(ps) + 1)) and {p.n_pieces for p in ps} == {len(ps)}
        for p in ps:
            assert p.from_char == at and len(p.text) <= limit
            assert p.text == text[max(0, at - overlap) : p.to_char]
            at = p.to_char
        assert at == len(text)
    return got


def test_random_sections(spark):
    rnd = random.Random(3)
    rows, n = [], 0
    for d in "abc":
        for q in range(rnd.choice([3, 60, 300])):
            n += 1
            value = rnd.choice([None, "", "가 나. 다라마바 사.", "긴 글 " * rnd.randrange(1, 60), "x" * rnd.randrange(1, 150)])
            rows.append((d, rnd.choice(["s", "t", None]), q, rnd.choice(["a > b > c", "a > b > d", "e", None]), value, T[0], n))
    check(spark, rows)
    check(spark, rows, limit=30, overlap=0, segment=100)
    check(spark, rows, limit=500, overlap=100, segment=1000)


def test_cases(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, "s", 1, "n", "x" * 100, T[0], 1)]) == {}
    assert run(spark, [("d", "s", 1, "n", "x" * 10, T[0], 1)]) == {}
    got = run(spark, [("d", "s", None, "n", "x" * 100, T[0], 1)], paths=[("d", "p1", "q"), ("d", "p2", "q")])
    assert [p.file_path for p in got["d", "s"]] == ["p2"] * len(got["d", "s"])
    # the later copy counts, even where it is short; of copies loaded at once the larger id does
    assert run(spark, [("d", "s", 1, "n", "x" * 100, T[0], 1), ("d", "s", 1, "n", "y", T[1], 2)]) == {}
    got = run(spark, [("d", "s", 1, "n", "x" * 100, T[0], 1), ("d", "s", 1, "n", "y" * 100, T[0], 2)])
    text = "".join(p.text for p in got["d", "s"])
    assert "y" in text and "x" not in text


def test_very_long_item(spark):
    got = check(spark, [("d", "s", 1, "n", "문장이다. " * 40_000, T[0], 1)], limit=6000, overlap=300, segment=600_000)
    assert all(p.text.endswith((". ", "\n", ".")) for p in got["d", "s"])


def test_cuts_between_items(spark):
    rows = [("d", "s", q, f"제목 > 항목{q}", "값" * 15, T[0], q) for q in range(30)]
    got = check(spark, rows)
    assert all(p.text.endswith("\n") for p in got["d", "s"])


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        run(spark, [], limit=10, overlap=10)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("가나. \n다!x"), max_size=300), st.integers(3, 40))
def test_cut_text(text, cap):
    blocks = pieces.cut_text(text, cap)
    assert "".join(blocks) == text and all(len(b) <= cap for b in blocks)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=3), st.text(st.sampled_from("가. x"), min_size=1, max_size=30)), min_size=1, max_size=20), st.integers(5, 40))
def test_pack(items, cap):
    blocks = pieces.pack(items, cap)
    assert "".join(blocks) == "".join(t for _, t in items) and all(len(b) <= cap for b in blocks)
