"""Wide tables of the item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.operators.wide import Source, union_all, unpivot_cells, wide_tables
from gyeol.session import table

TABLES = ("contract_item", "major_item", "holding_item")
#: Bound of the field list, which is read to the driver as the schema of the result.
MAX_FIELDS = 10_000


def wide_fields(spark: SparkSession, d: str) -> dict[str, list[tuple[str, str, str]]]:
    """Fields by table; a schema, so it is read to the driver, at most ``MAX_FIELDS`` rows."""
    rows = table(spark, d, "wide_field").select("source_table", "field", "label", "value_type").limit(MAX_FIELDS + 1).collect()
    if len(rows) > MAX_FIELDS:
        raise ValueError("wide_field is not a schema: too many rows")
    return {t: [(r.field, r.label, r.value_type) for r in rows if r.source_table == t] for t in TABLES}


def source(spark: SparkSession, d: str, name: str, fields: list[tuple[str, str, str]]) -> Source:
    return table(spark, d, name), fields, F.col("section") == "summary" if name == "holding_item" else None


def wide_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    return wide_tables({name: source(spark, d, name, wide_fields(spark, d)[name])})[name]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the three wide tables but those of type text, which aren't read or joined at all."""
    shown = {name: [x for x in fields if x[2] != "text"] for name, fields in wide_fields(spark, d).items()}
    wide = wide_tables({name: source(spark, d, name, fields) for name, fields in shown.items()})
    return union_all([unpivot_cells(wide[name], fields).select(F.lit(name).alias("source_table"), "doc_id", "field", "typed_value") for name, fields in shown.items()])


def p4_wide_contract(spark: SparkSession, d: str) -> DataFrame:
    return wide_of(spark, d, "contract_item")


def p4_wide_major(spark: SparkSession, d: str) -> DataFrame:
    return wide_of(spark, d, "major_item")


def p4_wide_holding(spark: SparkSession, d: str) -> DataFrame:
    return wide_of(spark, d, "holding_item")
