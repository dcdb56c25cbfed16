"""Writing tables: whole-table overwrites, so that a repeated load gives the same table; parents last to go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.sources.schemas import CLUSTER, column_names

#: Children before parents.
RESET_ORDER = ["doc_relation", "contract_item", "major_item", "holding_item", "event_contract", "event_major", "event_holding", "document", "company"]


def write_table(df: DataFrame, root: str, name: str, target_rows: int = 2_000_000) -> DataFrame:
    """Overwrite a Parquet table with the columns of its schema, clustered for its usual filter; returns it read back."""
    out = df.select(*[c for c in column_names(name) if c in df.columns])
    if name in CLUSTER:
        out = out.sortWithinPartitions(CLUSTER[name])
    out.write.mode("overwrite").option("maxRecordsPerFile", target_rows).parquet(f"{root}/{name}.parquet")
    return df.sparkSession.read.parquet(f"{root}/{name}.parquet")


def reset(spark: SparkSession, root: str) -> None:
    """Empty all tables that are there, children first."""
    for name in RESET_ORDER:
        path = f"{root}/{name}.parquet"
        try:
            schema = spark.read.parquet(path).schema
        except Exception:  # noqa: S112, BLE001  (no such table)
            continue
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def load_report(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows by kind, largest first: what a load prints."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *by)
