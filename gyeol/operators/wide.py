"""Attribute-value rows into wide tables: one row per entity with typed columns.

Method: the rows are partitioned by attribute into typed narrow tables (entity, value), each a folder of its own in the
shared checkpoint folder, so that reading one reads nothing of the others. They are combined through a balanced tree of outer
joins over the spine of all entities: a leaf joins the spine with up to ``FAN`` narrow tables, leaves are joined
pairwise. Every join is by entity on a side that keeps all entities, so the partitioning holds from leaf to root: each narrow
table is shuffled once, by entity, and nothing else is. The result is that of full outer joins.

Cases: a repeated (entity, seq) counts with its latest copy (then the largest uid); of several rows of one
attribute the one with the highest seq that can be read as the type wins, a null seq being lowest; rows with a null entity or
attribute are ignored; an entity none of whose values can be read has no row; names of extra columns in
the input don't matter. One entity may hold any share of the rows: copies are compared by (entity, seq),
and values are reduced on the map side before they meet by entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyeol.functions.readers import READERS, SQL_TYPES
from gyeol.functions.units import half_width
from gyeol.session import shared_folder

#: Numbering and bullets that may stand before a name.
LEADING = r"^(?:\(?[0-9]+(?:-[0-9]+)*[.)]|\(?[가-하][.)]|[①-⑳]|[-ㆍ·ᆞ•‧∙・○●□■※*])+"


def label_key(name: Column) -> Column:
    """Comparable form of an attribute: the last part of its path, without blanks, numbering and bullets."""
    last = F.regexp_extract(half_width(name), r"([^>]*)$", 1)
    return F.regexp_replace(F.regexp_replace(last, r"(?U)\s+", ""), LEADING, "")


def latest_copies(rows: DataFrame, keys: list[str], recency: list[str]) -> DataFrame:
    """The row of each key with the greatest ``recency``; keys hold few rows each."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in recency])
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


Source = tuple[DataFrame, list[tuple[str, str, str]], Column | None]


def _named_fields(rows: DataFrame, fields: list[tuple[str, str, str]], keep: Column | None) -> DataFrame:
    """(doc_id, seq, loaded_at, id, field, kind, item_value): the field each row fills, null where none."""
    table = {"".join(label.split()): (field, kind) for field, label, kind in fields}
    own = F.create_map(*[F.lit(x) for label, (field, kind) in table.items() for x in (label, f"{kind} {field}")]) if table else F.create_map().cast("map<string,string>")
    name = F.try_element_at(own, label_key(F.col("item_name")))
    narrow = rows.where("doc_id is not null").select("doc_id", "seq", "loaded_at", "id", (name if keep is None else F.when(keep, name)).alias("name"), "item_value")
    return narrow.select("doc_id", "seq", "loaded_at", "id", "name", F.when(F.col("name").isNotNull(), F.col("item_value")).alias("item_value"))


def typed_cells(sources: dict[str, Source]) -> DataFrame:
    """(source, doc_id, field, number, ratio, date, flag, text) with one row a readable cell of all sources.

    A source is (rows, fields, keep): rows have doc_id, seq, item_name, item_value, loaded_at and id; fields are (field, label,
    type); ``keep`` limits the rows that may fill a field.
    """
    named = reduce(DataFrame.unionByName, [_named_fields(*x).withColumn("source", F.lit(n)) for n, x in sources.items()])
    live = latest_copies(named, ["source", "doc_id", "seq"], ["loaded_at", "id"]).where("name is not null and item_value is not null")
    used = [k for k in READERS if any(kind == k for _, fields, _ in sources.values() for _, _, kind in fields)] or ["text"]
    typed = live.select("source", "doc_id", "seq", "name", *[F.when(F.col("name").startswith(f"{k} "), READERS[k](F.col("item_value"))).alias(k) for k in used])
    # a row that can't be read has no rank; each reader runs once a row
    read = reduce(Column.__or__, [F.col(k).isNotNull() for k in used])
    rank = F.when(read, F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63))))
    best = typed.groupBy("source", "doc_id", "name").agg(F.max_by(F.struct(*used), rank).alias("v")).where("v is not null")
    return best.select("doc_id", *[F.col(f"v.{k}") if k in used else F.lit(None).cast(SQL_TYPES[k]).alias(k) for k in READERS], "source", F.substring_index("name", " ", -1).alias("field"))


#: Narrow tables that one leaf of the tree joins with the spine.
FAN = 4


def balanced_outer_join(spine: DataFrame, tables: list[DataFrame], key: str, fan: int = FAN) -> DataFrame:
    """All tables (one row a key) joined to the spine of all keys, as a balanced tree whose partitioning by key never changes."""
    leaves = [reduce(lambda left, t: left.join(t, key, "left"), tables[i : i + fan], spine) for i in range(0, len(tables), fan)] or [spine]
    while len(leaves) > 1:
        pairs = [leaves[i : i + 2] for i in range(0, len(leaves), 2)]
        leaves = [p[0].join(p[1], key) if len(p) == 2 else p[0] for p in pairs]  # both sides have every key
    return leaves[0]


def wide_tables(sources: dict[str, Source]) -> dict[str, DataFrame]:
    """The wide table of each source; the typed cells of all are found and written in one pass, a folder a source and field."""
    spark = next(iter(sources.values()))[0].sparkSession
    path = shared_folder(spark, "cells")
    typed_cells(sources).write.partitionBy("source", "field").parquet(path)
    kinds = ", ".join(f"{k} {SQL_TYPES[k]}" for k in READERS)
    cells = spark.read.schema(f"doc_id string, {kinds}, source string, field string").parquet(path)
    out = {}
    for name, (_, fields, _) in sources.items():
        mine = cells.where(F.col("source") == name)
        narrow = [mine.where(F.col("field") == f).select("doc_id", F.col(kind).alias(f)) for f, _, kind in fields]
        out[name] = balanced_outer_join(mine.select("doc_id").distinct(), narrow, "doc_id")
    return out


def wide_table(rows: DataFrame, fields: list[tuple[str, str, str]], keep: Column | None = None) -> DataFrame:
    """One row per doc_id with a typed column for each field of ``fields``; field names have no blanks."""
    return wide_tables({"rows": (rows, fields, keep)})["rows"]


def unpivot_cells(wide: DataFrame, fields: list[tuple[str, str, str]]) -> DataFrame:
    """(doc_id, field, typed_value) of every filled cell, values as text: days as YYYYMMDD."""
    parts = [
        F.struct(F.lit(f).alias("field"), (F.date_format(f, "yyyyMMdd") if kind == "date" else F.col(f).cast("string")).alias("typed_value"))
        for f, _, kind in fields
    ]
    long = wide.select("doc_id", F.explode(F.array(*parts)).alias("c")).select("doc_id", "c.*")
    return long.where("typed_value is not null")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
