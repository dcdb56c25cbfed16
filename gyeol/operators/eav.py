"""Lookups in ordered item rows (doc_id, seq, item_name, item_value). One grouped pass each, no self-joins.

Order is always ``seq``; names are compared without white space; a document without a match has null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyeol.functions.numbers import to_int
from gyeol.functions.text import squeeze, strip


def named(*patterns: str, name: str = "item_name") -> Column:
    """True where the name without white space contains every pattern."""
    key = squeeze(F.col(name))
    hits = [key.contains("".join(p.split())) for p in patterns]
    return reduce(Column.__and__, hits)


def last_value(cond: Column, value: str = "item_value", order: str = "seq") -> Column:
    """Aggregate: the value of the last row that fits. Corrected documents repeat an item after its old value."""
    return F.max_by(F.col(value), F.when(cond, F.col(order)))


def first_value(cond: Column, value: str = "item_value", order: str = "seq") -> Column:
    """Aggregate: the value of the first row that fits."""
    return F.min_by(F.col(value), F.when(cond, F.col(order)))


def with_next(items: DataFrame, section: str | None = None) -> DataFrame:
    """``items`` (of one section) with ``next_value``, the value of the row that follows in the document."""
    rows = items if section is None else items.where(F.col("section") == section)
    return rows.withColumn("next_value", F.lead("item_value").over(Window.partitionBy("doc_id").orderBy("seq")))


def numbered_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, pos, line, next_line) of the trimmed lines of each text; the last line has no next one."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.transform(F.split(F.col(text), "\n"), strip).alias("l"))
    # the next line is put beside its line before rows are made, so that no row carries the whole text
    pairs = F.transform(F.arrays_zip(F.col("l").alias("line"), F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))).alias("next_line")), lambda x, i: F.struct(i.alias("pos"), x["line"].alias("line"), x["next_line"].alias("next_line")))
    return lines.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.*")


def label_values(lines: DataFrame, labels: dict[str, str], known: list[str]) -> DataFrame:
    """One row a document: for each label the line after its first occurrence; '' where that line is a label itself."""
    value = F.when(F.col("next_line").isin(known), F.lit("")).otherwise(F.coalesce("next_line", F.lit("")))
    rows = lines.withColumn("value", value)
    return rows.groupBy("doc_id").agg(*[F.min_by("value", F.when(F.col("line") == label, F.col("pos"))).alias(k) for k, label in labels.items()])


#: Words that say that something decided was called off.
CALLED_OFF = "철회|취소|해제|무효|가처분|중단"


def correction_reasons(items: DataFrame, head: int = 80) -> DataFrame:
    """(doc_id, correct_reason, is_withdrawn) from the parts of the first ``head`` item names.

    Parts shorter than 8 characters, numbered or numeric ones don't count. The most frequent part that says
    something was called off wins; else the most frequent one that occurs twice; first seen breaks ties.
    """
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    parts = items.withColumn("nth", nth).where(F.col("nth") <= head).select("doc_id", "nth", F.posexplode(F.split("item_name", ">")).alias("pos", "part"))
    parts = parts.withColumn("part", strip(F.col("part")))
    parts = parts.where((F.length("part") >= 8) & ~F.col("part").rlike(r"(?U)^\d{1,2}\s*[.．]") & ~F.col("part").rlike(r"(?U)^[\d,.\s%()-]+$"))
    counts = parts.groupBy("doc_id", "part").agg(F.count("*").alias("n"), F.min(F.struct("nth", "pos")).alias("seen"))
    counts = counts.withColumn("off", F.col("part").rlike(CALLED_OFF)).where("off or n >= 2")
    w = Window.partitionBy("doc_id").orderBy(F.col("off").desc(), F.col("n").desc(), "seen")
    best = counts.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.select("doc_id", F.col("part").alias("correct_reason"), F.col("off").cast("int").alias("is_withdrawn"))


def mode_value(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each group; the value seen first breaks ties."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "seen")
    return counts.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "seen")


def priority_number(*conds: Column, parse=to_int) -> Column:
    """Aggregate: the first number under the first condition that has one."""
    return F.coalesce(*[F.min_by(parse(F.col("item_value")), F.when(c & parse(F.col("item_value")).isNotNull(), F.col("seq"))) for c in conds])
