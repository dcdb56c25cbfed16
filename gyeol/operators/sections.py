"""Sections and chunks of marked-up reports: one piece a section, split again where it is too large, never inside a table.

Method: the markup is cut at the starts of its second-level sections; each section is taken apart into blocks, a table or a
paragraph each, and the blocks are packed in order into chunks of at most ``limit`` characters. A table larger than the limit
is a chunk of its own, whole. Every chunk starts with a header line that says whose, when, what and which section it is.
Column expressions only; the longest unit held at once is one section.

Cases: text before the first section is a section without a title; null markup has no chunks, '' has none either; other columns are
kept out; repeated documents give repeated chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyeol.functions.text import html_to_text, strip

LIMIT = 13_000
_SECTION = r"(?i)(?=<SECTION-2\b)"
_BLOCKS = r"(?is)<TABLE\b.*?</TABLE>|<P\b[^>]*>.*?</P>|(?:(?!<TABLE\b|<P\b).)+"


def sections(docs: DataFrame, doc_id: str = "doc_id", raw: str = "raw") -> DataFrame:
    """(doc_id, section_no, title, body): the second-level sections of each document in order."""
    parts = docs.where(F.col(raw).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(raw, _SECTION)).alias("section_no", "body"))
    title = strip(F.regexp_replace(F.regexp_extract("body", r"(?is)<TITLE[^>]*>(.*?)</TITLE>", 1), "<[^>]+>", ""))
    # the title of a document's head isn't that of a section
    own = F.when(F.col("body").rlike(r"(?i)^<SECTION-2\b"), F.nullif(title, F.lit("")))
    body = F.when(own.isNotNull(), F.regexp_replace("body", r"(?is)^(<SECTION-2\b[^>]*>\s*)<TITLE[^>]*>.*?</TITLE>", "$1")).otherwise(F.col("body"))
    return parts.select("doc_id", "section_no", own.alias("title"), body.alias("body"))


def pack_blocks(blocks: Column, limit: int) -> Column:
    """array<string>: neighbouring blocks joined by line ends while they fit; one that doesn't is alone."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(acc: Column, x: Column) -> Column:
        fits = F.length(acc["held"]) + F.length(x) + 1 <= limit
        joined = F.when(acc["held"] == "", x).otherwise(F.concat(acc["held"], F.lit("\n"), x))
        closed = F.when(acc["held"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["held"]))
        return F.when((acc["held"] == "") | fits, F.struct(acc["done"].alias("done"), joined.alias("held"))).otherwise(F.struct(closed.alias("done"), x.alias("held")))

    return F.aggregate(blocks, zero, step, lambda a: F.when(a["held"] == "", a["done"]).otherwise(F.array_append(a["done"], a["held"])))


def chunks(docs: DataFrame, header: list[str], limit: int = LIMIT, doc_id: str = "doc_id", raw: str = "raw") -> DataFrame:
    """(doc_id, section_no, chunk_no, title, n_chars, is_table, text) of documents; ``header`` names the columns of the header line.

    n_chars is the size without the header; a chunk above ``limit`` is one block, as is_table says.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.concat_ws(" | ", *header).alias("head")).dropDuplicates(["doc_id"])
    found = sections(docs, doc_id, raw)
    blocks = F.filter(F.transform(F.regexp_extract_all("body", F.lit(_BLOCKS), F.lit(0)), lambda b: html_to_text(b)), lambda t: t != "")
    packed = found.select("doc_id", "section_no", "title", F.posexplode(pack_blocks(blocks, limit)).alias("chunk_no", "chunk"))
    line = F.concat_ws(" | ", F.nullif("head", F.lit("")), "title")
    out = packed.join(own, "doc_id")
    return out.select("doc_id", "section_no", "chunk_no", "title", F.length("chunk").alias("n_chars"), (F.length("chunk") > limit).alias("is_table"), F.concat(line, F.lit("\n"), "chunk").alias("text"))
