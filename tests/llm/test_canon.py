import random
import unicodedata

from pyspark.sql import functions as F

from gyeol.llm import canon


def forms(spark, texts):
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, raw int")
    rows = canon.with_canonical(df, "t", "c").orderBy("raw").collect()
    return [r.c for r in rows]


LIST = [
    ("ＡＢＣ １２３", "ABC 123"), ("café", "café"), ("a​b\xadc", "abc"), ("a\xa0b　c", "a b c"), ("АВС", "ABC"), ("한글", "한글"), ("가", "가"),
    ("계약ㆍ공급・판매ᆞ", "계약·공급·판매·"), ("​‍", ""), ("", ""), (None, None), ("ệ", "ệ"), ("ệ", "ệ"), ("q̣̇", "q̣̇"),
    ("²①ﬁ", "²①ﬁ"), ("e​́", "é"), ("Ά", "Á"), ("각́", "각́"), ("ᅡ", "ᅡ"), ("😀ｘ", "😀x"), ("A  b", "A  b"), ("ﾊﾞ", "バ"),
]


def test_literal(spark):
    assert forms(spark, [a for a, _ in LIST]) == [b for _, b in LIST]


def test_python_twin():
    assert [canon.fold_text(a) for a, _ in LIST if a is not None] == [b for _, b in LIST if b is not None]


def test_repeated_long_and_empty(spark):
    long = "가ㆍ" * 60_000
    got = forms(spark, [long, long, "x"])
    assert got[0] == got[1] == "가·" * 60_000
    assert canon.with_canonical(spark.createDataFrame([], "t string"), "t", "c").count() == 0


def test_tables_cover_unicode():
    for seq, one in canon.recompositions()[::97]:
        assert unicodedata.normalize("NFC", seq) == one


def test_against_python(spark):
    """Random strings of letters, marks, jamo and blanks; one Spark job for all."""
    rnd = random.Random(11)
    marks = "aAеOе가각ㄱ각\u0323\u0301\u0302\u200b\xadＡㆍ・ \xa0é😀\u1160\u11a7\u0345\u1100\u1161\u11a8"
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randrange(0, 10))) for _ in range(4000)]
    got = forms(spark, texts)
    bad = [(ascii(t), ascii(g), ascii(canon.fold_text(t))) for t, g in zip(texts, got, strict=True) if g != canon.fold_text(t)]
    assert bad == []


def test_pairs_against_brute_force(spark):
    rows = [("f", 1, "Ａb", True, True), ("f", 2, "Ab", True, True), ("f", 3, "Ab", True, True), ("f", 4, "Аb", True, True), ("g", 5, "Ab", True, True), ("f", 6, None, True, True)]
    df = spark.createDataFrame(rows, "field string, key long, raw string, in_a boolean, in_b boolean").where("raw is not null")
    got = canon.look_alike_pairs(canon.with_canonical(df, "raw", "canon"), ["field"]).where("key_a < key_b").select("key_a", "key_b").collect()
    want = {(a[1], b[1]) for a in rows for b in rows if a[2] and b[2] and a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and canon.fold_text(a[2]) == canon.fold_text(b[2])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_no_match_of_visible_differences(spark):
    got = forms(spark, ["Andre", "André", "ANDRE", "An dre"])
    assert len(set(got)) == 4


def test_extra_columns(spark):
    df = spark.createDataFrame([("ａ", 1, 2, 3)], "t string, ch int, sid int, canon int")
    assert canon.with_canonical(df, "t", "c").select("c", "ch", "canon", F.lit(1)).first()[:3] == ("a", 1, 3)


def test_line_ends_at_the_end_are_blanks(spark):
    """A line end as the last character is a blank like any other."""
    ends = ["\n", "\r\n", " ", "\x85", "\r", " ", " "]
    rows = [(i, "계약" + e) for i, e in enumerate(ends)]
    got = {r.id: r.c for r in canon.with_canonical(spark.createDataFrame(rows, "id int, t string"), "t", "c").collect()}
    assert got == {i: canon.fold_text(t) for i, t in rows} and set(got.values()) == {"계약 ", "계약  "}


def test_runs_before_marks(spark):
    """The last character of a stable run may compose with what follows it."""
    texts = ["abcéfg", "가나닥라", "xe‍́y", "ạ̇b", "́abc", "abć", "각", "plain x", "é", "①²"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.c for r in canon.with_canonical(df, "t", "c").collect()}
    assert got == {i: canon.fold_text(t) for i, t in enumerate(texts)}
