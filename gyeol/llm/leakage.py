"""Evaluation texts leaking into training text: which documents hold which test items, and where.

Method: every window of ``WIDTH`` letters and digits of the normalised test items goes into a hash
set that is broadcast; the normalised corpus text is probed at every ``STRIDE``-th position only, which
still meets every shared run of ``MIN_RUN`` because WIDTH + STRIDE - 1 <= MIN_RUN; each hit is verified by
extending it letter by letter in both directions. Found spans can be cut out of the text.

The normal form keeps letters and digits of the text with characters in one form and in lower case, so
blanks, punctuation, case, width and composition don't matter. One pass over the corpus, whole texts, no
shuffle. Test items larger than ``BLOCK_CHARS`` in sum are taken in blocks, each broadcast on its own.

Cases: null ids and null or empty texts share nothing; items shorter than MIN_RUN can't leak; repeated
rows give repeated hits; runs of one item that overlap count as one; an empty set of items or documents gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm import canon
from gyeol.session import busy, ship_package

MIN_RUN = 50
WIDTH, STRIDE = 25, 26
#: Normalised characters of test items in one broadcast set: about 1 GB of windows at the most.
BLOCK_CHARS = 5_000_000
HITS = "doc_id long, item_id long, run int, from_char int, to_char int"
_PLAIN = re.compile(r"[\x00-\x7f가-힣\n■※]*")
_OTHER = re.compile(r"[\W_]+")
#: Vowels and finals of Hangul and half-width voicing marks, which join the letter before them without being marks.
_JOINS = re.compile(r"[\u1160-\u11ff\ud7b0-\ud7ff\uff9e\uff9f]")


def letters(text: str) -> str:
    """Letters and digits of a text in one form, lower case."""
    if not _PLAIN.fullmatch(text):
        # letters that aren't composed yet must meet before the rest is dropped
        text = unicodedata.normalize("NFC", text.translate(canon.translation()) if unicodedata.is_normalized("NFC", text) else canon.fold_text(text))
    return _OTHER.sub("", text).lower()


def _clusters(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each letter with all that may compose with it: marks, jamo, and what is invisible between them."""
    gone = canon.translation()
    start = 0
    for i, ch in enumerate(text):
        joins = unicodedata.category(ch) in ("Mn", "Mc", "Me", "Cf") or _JOINS.match(ch) or gone.get(ord(ch)) == ""
        if i > start and not joins:
            yield start, i
            start = i
    if text:
        yield start, len(text)


def lettered_positions(text: str) -> tuple[str, list[int], list[int]]:
    """``letters(text)`` with the raw start and end of each of its characters; a slow path for documents with hits."""
    out, starts, ends = [], [], []
    for a, b in _clusters(text):
        own = letters(text[a:b])
        out.append(own)
        starts += [a] * len(own)
        ends += [b] * len(own)
    return "".join(out), starts, ends


def index_items(items: list[tuple[int, str]]) -> dict[str, list[tuple[int, int]]]:
    """window -> [(index of item, position)] of all windows of the normalised items."""
    table: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, (_, text) in enumerate(items):
        for i in range(len(text) - WIDTH + 1) if len(text) >= MIN_RUN else ():
            table[text[i : i + WIDTH]].append((k, i))
    return dict(table)


def shared_runs(text: str, items: list[tuple[int, str]], table: dict[str, list[tuple[int, int]]]) -> set[tuple[int, int, int]]:
    """(index of item, start, end) of the runs of MIN_RUN and more in a normalised text."""
    found: set[tuple[int, int, int]] = set()
    reach: dict[tuple[int, int], int] = {}
    for i in range(0, len(text) - WIDTH + 1, STRIDE):
        for k, j in table.get(text[i : i + WIDTH], ()):
            if reach.get((k, i - j), -1) > i:
                continue
            item = items[k][1]
            a, b, x, y = i, i + WIDTH, j, j + WIDTH
            while a > 0 and x > 0 and text[a - 1] == item[x - 1]:
                a, x = a - 1, x - 1
            while b < len(text) and y < len(item) and text[b] == item[y]:
                b, y = b + 1, y + 1
            reach[k, i - j] = b
            if b - a >= MIN_RUN:
                found.add((k, a, b))
    return found


def merged_runs(runs: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of one item that overlap or touch as one: an item that repeats itself meets a repeating text in many ways."""
    out: list[tuple[int, int, int]] = []
    for k, a, b in sorted(runs):
        if out and out[-1][0] == k and a <= out[-1][2]:
            out[-1] = (k, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((k, a, b))
    return out


_built: dict[str, tuple] = {}


def _index_once(key: str, shared) -> tuple[list[tuple[int, str]], dict[str, list[tuple[int, int]]]]:
    """The items of a broadcast with their windows, built once a worker process instead of once a task; only the last block is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = (shared.value, index_items(shared.value))
    return _built[key]


def raw_span(text: str, a: int, b: int) -> tuple[int, int]:
    """Raw start and end of the letters a to b of a text, by bisection: for texts whose clusters don't give its letters."""

    def place(n: int) -> int:
        lo, hi = 0, len(text)
        while lo < hi:  # the last place before which there are at most n letters
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(letters(text[:mid])) <= n else (lo, mid - 1)
        return lo

    return place(a), place(b)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The normalised items in blocks of at most BLOCK_CHARS, streamed through the driver."""
    block, size = [], 0
    for r in items.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).distinct().toLocalIterator():
        own = letters(r[1])
        if block and size + len(own) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], own))
        size += len(own)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, run, from_char, to_char) of every shared run; positions are in the raw text."""
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    out = None
    for block in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared, key=uuid.uuid4().hex):
            import pyarrow as pa

            own, table = _index_once(key, shared)
            for batch in batches:
                rows = []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    plain = letters(t)
                    if hits := merged_runs(shared_runs(plain, own, table)):
                        placed, starts, ends = lettered_positions(t)
                        # a final sigma depends on the letters around it, its place doesn't
                        same = placed.replace("ς", "σ") == plain.replace("ς", "σ")
                        rows += [(i, own[k][0], b - a, *((starts[a], ends[b - 1]) if same else raw_span(t, a, b))) for k, a, b in hits]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=["doc_id", "item_id", "run", "from_char", "to_char"])

        part = busy(source).mapInArrow(scan, HITS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], HITS)


def remove_spans(docs: DataFrame, hits: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, removed_chars) of the documents with hits, their leaked spans cut out. Overlapping spans count once."""
    spans = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("from_char", "to_char"))).alias("spans"))
    mine = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null").join(spans, "doc_id")
    zero = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))

    def step(acc, x):
        start = F.greatest(acc["at"], x["from_char"])
        return F.struct(F.concat(acc["kept"], F.substring(F.col("text"), acc["at"] + 1, start - acc["at"])).alias("kept"), F.greatest(acc["at"], x["to_char"]).alias("at"))

    rest = F.aggregate("spans", zero, step, lambda a: F.concat(a["kept"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return mine.select("doc_id", rest.alias("kept"), F.length("text").alias("n")).select("doc_id", F.col("kept").alias("text"), (F.col("n") - F.length("kept")).alias("removed_chars"))
