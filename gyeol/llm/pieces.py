"""Splitting oversized items at natural boundaries: pieces under a limit with a fixed overlap.

Method: structure-tree packing. The items of a section form a tree by the headings in their names
(``a > b > c``); an item that is too large on its own is a tree of paragraphs, sentences, words and, last,
characters. Sibling subtrees are merged bottom-up while they fit; only nodes that don't fit are opened.
Every piece after the first starts with the last ``overlap`` characters before its own content.

The text of a section is its items in seq order, each ``name: value`` and a line end, so its length is the
sum of both lengths plus 3 an item. Sections within the limit aren't pieces and have no row.

Scale: sizes, copies and offsets are found on narrow rows without text. Offsets come from a two-level
prefix sum (blocks of ``BLOCK`` seqs, then rows in a block), so a section may hold any number of
rows. A section is packed in segments of about ``segment`` characters, cut between items; a segment gets
the tail of the one before it, so that overlaps run across segments.

Cases: null doc_id rows are ignored; a null section is a section of its own; a null seq counts as -1;
null names and values are ''; of several copies of a (doc_id, seq) the latest loaded_at counts, then the largest
id; of several paths of a document the greatest is carried, without one it is null; a blank-free text is
cut by characters; other columns of the inputs, whatever their names, don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyeol.session import cut_lineage, ship_package, spread

LIMIT, OVERLAP = 6000, 300
BLOCK = 512
SEGMENT = 600_000
PARTS = "doc_id string, section string, file_path string, section_size long, segment long, piece_in_segment int, from_char long, to_char long, text string"
#: Natural boundaries inside an item, coarse to fine: paragraph, sentence, word.
LEVELS = [re.compile(r"[^\n]*\n+|[^\n]+"), re.compile(r".*?[.!?。…]+[\"'”’)\]]*(?:\s+|$)|.+", re.S), re.compile(r"\s*\S+\s*", re.S)]


def cut_text(text: str, cap: int, level: int = 0) -> list[str]:
    """Blocks of at most ``cap`` characters of one item, merged from the finest level upwards."""
    if len(text) <= cap:
        return [text]
    if level == len(LEVELS):
        return [text[i : i + cap] for i in range(0, len(text), cap)]
    blocks: list[str] = []
    for part in LEVELS[level].findall(text):
        blocks += cut_text(part, cap, level + 1)
    return merge(blocks, cap)


def merge(blocks: list[str], cap: int) -> list[str]:
    """Neighbouring blocks joined while they fit."""
    out, held, size = [], [], 0
    for b in blocks:
        if held and size + len(b) > cap:
            out.append("".join(held))
            held, size = [], 0
        held.append(b)
        size += len(b)
    return out + ["".join(held)] if held else out


def pack(items: list[tuple[list[str], str]], cap: int, depth: int = 0) -> list[str]:
    """Blocks of at most ``cap`` characters of items (heading path, text), opened only where they don't fit."""
    if sum(len(t) for _, t in items) <= cap:
        return ["".join(t for _, t in items)]
    if len(items) == 1:
        return cut_text(items[0][1], cap)
    blocks: list[str] = []
    i = 0
    while i < len(items):
        head = items[i][0][depth] if depth < len(items[i][0]) - 1 else None
        j = i + 1
        while head is not None and j < len(items) and depth < len(items[j][0]) - 1 and items[j][0][depth] == head:
            j += 1
        if j - i == len(items):  # one heading over all: its children are the siblings
            return pack(items, cap, depth + 1)
        blocks += pack(items[i:j], cap, depth + 1) if j - i > 1 else cut_text(items[i][1], cap)
        i = j
    return merge(blocks, cap)


def _live(rows: DataFrame) -> DataFrame:
    """(doc_id, sec, seq, id, size) of the copy that counts of each (doc_id, seq)."""
    size = F.length(F.coalesce("item_name", F.lit(""))) + F.length(F.coalesce("item_value", F.lit(""))) + 3
    narrow = rows.where("doc_id is not null").select(
        "doc_id", F.coalesce("section", F.lit("\x00")).alias("sec"), F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"), "loaded_at", "id", size.cast("long").alias("size"))
    w = Window.partitionBy("doc_id", "seq").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("id").desc_nulls_last())
    return narrow.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "loaded_at")


def oversized_rows(rows: DataFrame, paths: DataFrame, limit: int, segment: int, overlap: int) -> DataFrame:
    """(doc_id, seq, id, sec, file_path, section_size, start, segment, own) of the rows of oversized sections.

    A row that ends close before a later segment is there once more for it, with own = false.
    """
    live = _live(rows)
    over = live.groupBy("doc_id", "sec").agg(F.sum("size").alias("section_size")).where(F.col("section_size") > limit)
    over = over.join(paths.groupBy("doc_id").agg(F.max("file_path").alias("file_path")), "doc_id", "left")
    salted = over.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    mine = live.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(16)).cast("int")).join(salted, ["doc_id", "sec", "salt"]).drop("salt")
    mine = mine.withColumn("block", F.floor(F.col("seq") / BLOCK))
    w = Window.partitionBy("doc_id", "sec").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = mine.groupBy("doc_id", "sec", "block").agg(F.sum("size").alias("in_block")).withColumn("base", F.coalesce(F.sum("in_block").over(w), F.lit(0))).drop("in_block")
    inside = Window.partitionBy("doc_id", "sec", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = mine.join(base, ["doc_id", "sec", "block"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    home, end = F.floor(F.col("start") / segment), F.col("start") + F.col("size")
    first, last = F.greatest(home + 1, F.floor(end / segment)), F.floor((end + overlap) / segment)
    later = F.when(last >= first, F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("segment"), F.lit(False).alias("own"))))
    mark = F.concat(F.array(F.struct(home.alias("segment"), F.lit(True).alias("own"))), F.coalesce(later, F.array()))
    return placed.withColumn("m", F.explode(mark)).select("doc_id", "seq", "id", "sec", "file_path", "section_size", "start", "m.*")


def split_sections(rows: DataFrame, paths: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, segment: int = SEGMENT) -> DataFrame:
    """Pieces of all oversized sections: doc_id, section, file_path, section_size, piece_no, n_pieces, from_char, to_char, text.

    ``rows`` has doc_id, section, seq, item_name, item_value, loaded_at, id; ``paths`` has doc_id, file_path.
    Pieces cover [from_char, to_char) of the section; their text starts ``overlap`` characters earlier.
    """
    if not 0 <= overlap < limit or segment <= limit:
        raise ValueError("need 0 <= overlap < limit < segment")
    ship_package(rows.sparkSession)
    marks = oversized_rows(rows, paths, limit, segment, overlap)
    name, value = F.coalesce("item_name", F.lit("")), F.coalesce("item_value", F.lit(""))
    full = rows.where("doc_id is not null").select("doc_id", F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"), "id", name.alias("name"), value.alias("value"))
    joined = marks.join(full, (marks["doc_id"] == full["doc_id"]) & (marks["seq"] == full["seq"]) & marks["id"].eqNullSafe(full["id"])).select(
        marks["doc_id"], "sec", "segment", marks["seq"], "own", "start", "file_path", "section_size", "name", "value")
    ordered = spread(joined, "doc_id", "sec", "segment").sortWithinPartitions("doc_id", "sec", "segment", "start", "own")
    cap = limit - overlap

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "section", "file_path", "section_size", "segment", "piece_in_segment", "from_char", "to_char", "text"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

        def pieces(key: tuple, meta: tuple, before: str, start: int, items: list) -> Iterator[tuple]:
            for k, block in enumerate(pack(items, cap)):
                tail = before[-overlap:] if overlap else ""
                yield (key[0], None if key[1] == "\x00" else key[1], *meta, key[2], k, start, start + len(block), tail + block)
                before, start = (tail + block)[-overlap:] if overlap else "", start + len(block)

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        key, meta, before, start, items, out = None, None, "", 0, [], []
        for batch in batches:
            for doc, sec, seg, _, own, at, path, size, name, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (doc, sec, seg) != key:
                    if items:
                        out += pieces(key, meta, before, start, items)
                    key, meta, before, start, items = (doc, sec, seg), (path, size), "", 0, []
                text = f"{name}: {value}\n"
                if own:
                    if not items:
                        start = at
                    items.append(([p.strip() for p in name.split(">")], text))
                else:
                    before += text
            if out:
                yield flush(out)
                out = []
        if items:
            out += pieces(key, meta, before, start, items)
        yield flush(out)

    parts = cut_lineage(ordered.mapInArrow(run, PARTS))
    by_segment = parts.groupBy("doc_id", "section", "segment").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id", "section").orderBy("segment")
    sums = by_segment.select(
        F.col("doc_id").alias("d"), F.col("section").alias("s"), F.col("segment").alias("g"),
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
        F.sum("n").over(Window.partitionBy("doc_id", "section")).alias("n_pieces"))
    hit = parts.join(sums, (F.col("doc_id") == F.col("d")) & F.col("section").eqNullSafe(F.col("s")) & (F.col("segment") == F.col("g")))
    return hit.select("doc_id", "section", "file_path", "section_size", (F.col("earlier") + F.col("piece_in_segment") + 1).alias("piece_no"), "n_pieces", "from_char", "to_char", "text")
