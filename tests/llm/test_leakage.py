import random

from hypothesis import given, settings
from hypothesis import strategies as st

from gyeol.llm import leakage

ITEM = "모노라인의 142번째 결산 설명에 따르면 야간 물류 노선 예산은 처음에 52,988백만원이었으나 33차례 조정 끝에 확정되었다. The Answer is Here."


def brute(docs, items, n=leakage.MIN_RUN):
    out = set()
    for d, t in docs:
        for i, u in items:
            if d is None or not t or not u:
                continue
            a, b = leakage.letters(t), leakage.letters(u)
            if any(b[k : k + n] in a for k in range(len(b) - n + 1)):
                out.add((d, i))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    return leakage.leaks(d, spark.createDataFrame(items, "item_id long, text string"))


def test_variants(spark):
    import unicodedata

    docs = [
        (1, "앞글 " + ITEM + " 뒷글"), (2, unicodedata.normalize("NFD", ITEM).upper()), (3, "​".join(ITEM)), (4, ITEM.replace(" ", "")), (5, ITEM[:40]), (6, "다른 글"), (7, None), (None, ITEM),
        (8, ""), (9, ITEM[:30] + "가짜" + ITEM[30:70]), (10, "x" * 100_000 + ITEM), (11, ITEM[20:]), (11, ITEM[20:]),
    ]
    items = [(1, ITEM), (2, "짧다"), (3, None)]
    got = run(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items) == {(d, 1) for d in (1, 2, 3, 4, 10, 11)}


def test_removal(spark):
    docs = [(1, "앞글. " + ITEM + " 뒷글."), (2, "깨끗한 글")]
    hits = run(spark, docs, [(1, ITEM)])
    out = leakage.remove_spans(spark.createDataFrame(docs, "doc_id long, text string"), hits).collect()
    assert [(r.doc_id, r.text) for r in out] == [(1, "앞글. . 뒷글.")]


def test_empty(spark):
    assert run(spark, [], [(1, ITEM)]).count() == 0
    assert run(spark, [(1, ITEM)], []).count() == 0


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 10)
    assert {tuple(r)[:2] for r in run(spark, [(1, ITEM)], [(1, ITEM), (2, ITEM[5:] + "가")]).collect()} == {(1, 1), (1, 2)}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(30, 80), st.integers(0, 60))
def test_any_offset(seed, run_length, before):
    rnd = random.Random(seed)
    letters = "".join(chr(rnd.randrange(0xAC00, 0xAC00 + 4000)) for _ in range(200))
    noise = "".join(chr(rnd.randrange(0xC000, 0xC000 + 4000)) for _ in range(200))
    at = rnd.randrange(0, 200 - run_length)
    text = noise[:before] + "가" + letters[at : at + run_length] + "힣" + noise[before:]
    items = [(1, letters)]
    found = leakage.shared_runs(text, items, leakage.index_items(items))
    want = any(letters[k : k + leakage.MIN_RUN] in text for k in range(len(letters) - leakage.MIN_RUN + 1))
    assert bool(found) == want


def test_positions_reproduce_the_letters_of_any_text(spark):
    import random
    import unicodedata

    rnd = random.Random(5)
    bits = ["e\u200b\u0301", "ᄀ\u200bᅡ\u200bᆨ", "가\u200dᆨ", "か\u3099", "ｶﾞ", "क\u093c", "a\u20d7", "e\u0323\u0302", "\u0301", "x", "가", "·", " ", "Σ", "Ａ", "\ufeff", "é", "é".replace("é", unicodedata.normalize("NFD", "é")), "ϒ\u0301"]
    for _ in range(3000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))
        placed, starts, ends = leakage.lettered_positions(t)
        assert placed.replace("ς", "σ") == leakage.letters(t).replace("ς", "σ"), ascii(t)
        assert len(starts) == len(ends) == len(placed)


def test_one_leaked_passage_leaves_the_rest(spark):
    secret = "".join(chr(0xAC00 + 37 * k) for k in range(60))
    for mark in ("e\u200b\u0301", "ᄀ\u200bᅡ", "か\u3099"):
        docs = spark.createDataFrame([(1, f"before {mark} {secret}. after")], "doc_id long, text string")
        hits = leakage.leaks(docs, spark.createDataFrame([(7, secret)], "item_id long, text string"))
        got = leakage.remove_spans(docs, hits).first()
        assert (got.text, got.removed_chars) == (f"before {mark} . after", 60), ascii(mark)


def test_spans_without_clusters():
    """The slow way to a span agrees with the clusters, and never gives more than the leak and its own marks."""
    text = "앞 글, か\u3099가 " + "가나다라 " * 20 + "뒤 글"
    plain, starts, ends = leakage.lettered_positions(text)
    assert plain == leakage.letters(text)
    for a, b in ((3, 60), (5, 55), (0, len(plain))):
        x, y = leakage.raw_span(text, a, b)
        assert leakage.letters(text[x:y]) == plain[a:b] and x <= starts[a] and y >= ends[b - 1]


def test_only_the_span_is_removed(spark):
    leak = "held out passage number one two three four five six seven eight nine ten eleven"
    for tail in ("か\u3099", "가\u11a8", "e\u0301", "\u0915\u094d\u0937"):
        docs = spark.createDataFrame([(1, f"before {leak} after {tail} end")], "doc_id long, text string")
        items = spark.createDataFrame([(7, leak)], "item_id long, text string")
        out = leakage.remove_spans(docs, leakage.leaks(docs, items)).first()
        assert out.text.startswith("before ") and out.text.endswith(f" after {tail} end") and out.removed_chars == len(leak)


def test_runs_of_one_item_are_merged():
    item = "abcdefghij" * 6
    runs = leakage.shared_runs(item * 3, [(1, item)], leakage.index_items([(1, item)]))
    assert len(runs) >= 1 and len(leakage.merged_runs(runs)) == 1
