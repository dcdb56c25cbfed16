"""Visually identical text in different characters: one consistent form for all text.

Method: each distinct string that may change is exploded to positioned code points (runs of code points that can't change
and whole decomposed syllables stay one unit); a broadcast join maps every code point to its decomposition, with look-alike letters, blanks, middle dots and
invisible characters folded; combining marks are put in order of their combining class; starters and
their marks are recomposed through a second broadcast join; the string is rebuilt in order.

What is folded: canonical decompositions, full-width and half-width forms, no-break and other blanks
(to one space each), invisible characters (dropped), Greek and Cyrillic letters drawn like Latin ones,
and the middle dots of Korean text. What is kept: case, accents, the presence and number of blanks,
and compatibility characters that look different (such as superscripts and circled digits).

Cases: null stays null; '' stays ''; a string of invisible characters becomes ''. Repeated rows give
repeated rows. Texts of any length are handled: the longest unit held at once is one text. An empty table gives an empty
result. Other columns are kept whatever their names, but for names that start with ``__`` and the name of the result.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyeol.session import cut_lineage, spread

#: Letters of other scripts drawn like Latin letters.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj", strict=True))
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХԌԛԜԝаеоѕсіјрухһԁӏ", "ABESIJKMHOPCTYXGqWwaeoscijpyxhdl", strict=True))
#: Middle dots used in Korean text, all drawn as U+00B7.
MIDDLE_DOTS = "·ᆞ•‧∙⋅・ㆍ･"
DOT = "·"
#: Characters drawn as nothing, besides the format characters (category Cf).
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0x180B, 0x1810)]))
#: Compatibility tags that change only how a character is encoded.
WIDTH_TAGS = ("<wide>", "<narrow>", "<noBreak>")
#: Beyond it no character decomposes, combines or is invisible but tags and variation selectors, which text has no use for.
LAST = 0x30000
L0, V0, T0, S0 = 0x1100, 0x1161, 0x11A7, 0xAC00
#: Strings of these characters alone are already in the consistent form. ``\z``: ``$`` would let a last line end pass.
STABLE = r"\A[\x20-\x7e가-힣]*\z"
#: What an unstable string is exploded to: runs of such characters up to the last one before another character, decomposed
#: syllables that nothing combines with, and all other characters singly.
UNITS = r"[\x20-\x7e가-힣]+(?![^\x20-\x7e가-힣])|[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?(?=[\x20-\x7e가-힣\u1100-\u1112]|\z)|[\s\S]"


def _mapped(ch: str) -> str:
    """The folded, fully decomposed form of one code point."""
    if ch in GREEK:
        return GREEK[ch]
    if ch in CYRILLIC:
        return CYRILLIC[ch]
    if ch in MIDDLE_DOTS:
        return DOT
    kind = unicodedata.category(ch)
    if ch in INVISIBLE or kind == "Cf":
        return ""
    if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\x0b\x0c\r\x85":
        return " "
    tag, _, rest = unicodedata.decomposition(ch).rpartition("> ")
    if not rest:
        return ch
    if tag and tag + ">" not in WIDTH_TAGS:
        return ch
    return "".join(_mapped(chr(int(x, 16))) for x in rest.split())


@lru_cache(maxsize=1)
def code_point_rules() -> list[tuple[str, list[tuple[str, int, bool]]]]:
    """(character, [(character, combining class, starts a segment)]) of each code point that isn't simply itself.

    Bounded by Unicode: about 13,000 rows. A segment is the longest stretch inside which characters
    may compose: it starts at a starter that is never the second of a composing pair.
    """
    seconds = set(range(V0, V0 + 21)) | set(range(T0 + 1, T0 + 28))
    for cp in range(LAST):
        d = unicodedata.decomposition(chr(cp))
        if d and d[0] != "<" and len(parts := d.split()) == 2 and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            seconds.add(int(parts[1], 16))
    out = []
    for cp in range(LAST):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if S0 <= cp < S0 + 11172:
            l, v, t = (cp - S0) // 588, (cp - S0) % 588 // 28, (cp - S0) % 28
            to = chr(L0 + l) + chr(V0 + v) + (chr(T0 + t) if t else "")
        else:
            to = _mapped(ch)
        cells = [(c, unicodedata.combining(c), unicodedata.combining(c) == 0 and ord(c) not in seconds) for c in to]
        if cells != [(ch, 0, True)]:
            out.append((ch, cells))
    return out


@lru_cache(maxsize=1)
def recompositions() -> list[tuple[str, str]]:
    """(fully decomposed sequence, composed character): about 12,000 rows."""
    out = []
    for cp in range(LAST):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        d = unicodedata.normalize("NFD", ch)
        if d != ch and unicodedata.normalize("NFC", d) == ch:
            out.append((d, ch))
    return out


@lru_cache(maxsize=1)
def translation() -> dict[int, str]:
    """The same folding as a ``str.translate`` table, for operators whose hot loop is in Python already."""
    return {ord(ch): "".join(c for c, _, _ in cells) for ch, cells in code_point_rules() if not S0 <= ord(ch) < S0 + 11172}


def fold_text(s: str) -> str:
    """Plain-Python form of the operator, its brute-force twin in tests."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(translation()))


def _pairs() -> dict[str, str]:
    """Two-character compositions besides Hangul: about 1,000."""
    return {d: c for d, c in ((unicodedata.normalize("NFC", d[:-1]) + d[-1], c) for d, c in recompositions()) if len(d) == 2 and not S0 <= ord(c) < S0 + 11172}


def _hangul(first: Column, second: Column) -> Column:
    """The syllable that two characters make by the arithmetic of the Hangul block; null where they make none."""
    a, b = F.ascii(first), F.ascii(second)
    lv = a.between(L0, L0 + 18) & b.between(V0, V0 + 20)
    lvt = a.between(S0, S0 + 11171) & ((a - S0) % 28 == 0) & b.between(T0 + 1, T0 + 27)
    code = F.when(lv, S0 + ((a - L0) * 21 + (b - V0)) * 28).when(lvt, a + (b - T0))
    return F.decode(F.unhex(F.hex(code)), "UTF-16BE")


def _refold(marks: Column, pairs: Column) -> Column:
    """Compose one segment in the general case: (starter, marks still open, what is finished). Rare, see ``canonical_forms``."""

    def step(acc: Column, x: Column) -> Column:
        free = (acc["open"] == "") | ((acc["last"] < x["ccc"]) & (x["ccc"] > 0))
        met = F.when(free & (acc["st"] != ""), F.coalesce(F.try_element_at(pairs, F.concat(acc["st"], x["c"])), _hangul(acc["st"], x["c"])))
        return (
            F.when(met.isNotNull(), F.struct(acc["done"].alias("done"), met.alias("st"), acc["open"].alias("open"), acc["last"].alias("last")))
            .when(x["ccc"] == 0, F.struct(F.concat(acc["done"], acc["st"], acc["open"]).alias("done"), x["c"].alias("st"), F.lit("").alias("open"), F.lit(0).alias("last")))
            .otherwise(F.struct(acc["done"].alias("done"), acc["st"].alias("st"), F.concat(acc["open"], x["c"]).alias("open"), x["ccc"].alias("last")))
        )

    zero = F.struct(F.lit("").alias("done"), F.lit("").alias("st"), F.lit("").alias("open"), F.lit(0).alias("last"))
    return F.aggregate(marks, zero, step, lambda a: F.concat(a["done"], a["st"], a["open"]))


def _rule_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    import pyarrow as pa

    cell = pa.struct([("c", pa.string()), ("ccc", pa.int32()), ("brk", pa.bool_())])
    chars, cells = zip(*code_point_rules(), strict=True)
    to = pa.array([[{"c": c, "ccc": n, "brk": b} for c, n, b in x] for x in cells], pa.list_(cell))
    seqs, composed = zip(*recompositions(), strict=True)
    rules = spark.createDataFrame(pa.table({"ch": pa.array(chars), "to": to}))
    return rules, spark.createDataFrame(pa.table({"seq": pa.array(seqs), "composed": pa.array(composed)}))


def canonical_forms(strings: DataFrame, col: str) -> DataFrame:
    """(sid, canon) of each distinct non-null string of ``col`` that isn't stable already; sid is the string's MD5.

    Strings that are missing in the result equal their own consistent form, or have no visible character if they are
    unstable. Only distinct unstable strings are exploded; they are shuffled once, by their digest, and the
    window, both groupings and the rebuild all reuse that partitioning.
    """
    spark = strings.sparkSession
    rules, comps = _rule_tables(spark)
    raw = strings.select(F.col(col).alias("raw")).where(F.col("raw").isNotNull() & ~F.col("raw").rlike(STABLE))
    keyed = spread(raw.groupBy(F.md5("raw").alias("sid")).agg(F.first("raw").alias("raw")), "sid")
    # the outer form keeps the optimizer from splitting in the scan's filter as well; unstable strings are never empty
    chars = keyed.select("sid", F.posexplode_outer(F.regexp_extract_all("raw", F.lit(UNITS), F.lit(0))).alias("pos", "ch"))
    own = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"), F.lit(True).alias("brk")))
    cells = (
        chars.join(F.broadcast(rules), "ch", "left")
        .select("sid", "pos", F.posexplode(F.coalesce("to", own)).alias("sub", "x"))
        .select("sid", "pos", "sub", "x.*")
    )
    w = Window.partitionBy("sid").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.select(
        "sid",
        F.sum(F.col("brk").cast("int")).over(w).alias("seg"),
        F.struct(F.sum((F.col("ccc") == 0).cast("int")).over(w).alias("starter"), "ccc", "pos", "sub", "c").alias("x"),
    )
    segments = placed.groupBy("sid", "seg").agg(F.sort_array(F.collect_list("x")).alias("marks"))
    segments = segments.withColumn("seq", F.array_join(F.transform("marks", lambda x: x["c"]), ""))
    pairs = F.create_map(*[F.lit(x) for kv in sorted(_pairs().items()) for x in kv])
    # a segment that composes as a whole or has one character is done; only the others are folded step by step
    rare = F.when((F.size("marks") > 1) & F.col("composed").isNull(), _refold(F.col("marks"), pairs))
    return (
        segments.join(F.broadcast(comps), segments["seq"] == comps["seq"], "left")
        .select("sid", "seg", F.coalesce("composed", rare, segments["seq"]).alias("out"))
        .groupBy("sid")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "out"))), lambda x: x["out"]), "").alias("canon"))
    )


def with_canonical(df: DataFrame, col: str, to: str) -> DataFrame:
    """``df`` with the consistent form of text column ``col`` as column ``to``. Every row is kept.

    The forms are materialised once; rows whose text is stable or null, the bulk, are neither shuffled nor joined.
    """
    forms = cut_lineage(canonical_forms(df, col)).select(F.col("sid").alias("__sid"), F.col("canon").alias("__canon"))
    stable = F.coalesce(F.col(col).rlike(STABLE), F.lit(True))
    met = df.where(~stable).withColumn("__sid", F.md5(col)).join(forms, "__sid", "left")
    return df.where(stable).withColumn(to, F.col(col)).unionByName(met.withColumn(to, F.coalesce("__canon", F.lit(""))).drop("__sid", "__canon"))


def look_alike_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, key_a, key_b) of rows that agree in ``by`` and ``canon`` while their ``raw`` differs.

    ``rows`` has by, key, raw, canon and two flags: a row is a first partner where ``in_a``, a second where ``in_b``.
    Distinct spellings are paired first; rows that hold one spelling are joined to that pair
    afterwards, so that copies of one spelling never meet each other.
    """
    on = [*by, "canon"]
    # two spellings of one form can't both be the form, so groups without a changed row have no pairs
    changed = rows.where("raw <> canon").select(*on).distinct()
    rows = cut_lineage(rows.join(changed, on, "left_semi"))
    spelled = rows.groupBy(*on, "raw").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    first = spelled.where("in_a").select(*on, F.col("raw").alias("raw_a"))
    second = spelled.where("in_b").select(*on, F.col("raw").alias("raw_b"))
    met = first.join(second, on).where("raw_a <> raw_b")
    a = rows.where("in_a").select(*on, F.col("raw").alias("raw_a"), F.col("key").alias("key_a")).distinct()
    b = rows.where("in_b").select(*on, F.col("raw").alias("raw_b"), F.col("key").alias("key_b")).distinct()
    return met.join(a, [*on, "raw_a"]).join(b, [*on, "raw_b"]).select(*by, "key_a", "key_b").distinct()
