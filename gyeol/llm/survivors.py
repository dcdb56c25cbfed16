"""Best representative of each duplicate group: one surviving record, the best value field by field.

Method: records are ranked by window ordering (the caller's criteria, then a unique id as the last
tie-break) and the top record of each group is kept. A criterion is a filter (trusted, complete) with
the same recency order. A group may hold a third of all rows, so ranking runs twice: first inside
``SALTS`` parts of each group, then over the at most ``SALTS`` winners of each criterion.

Cases: rows with a null in a group key belong to no group; a group without a row passing a
criterion has null there; ties are broken by the id, rows repeated with one id count as one row each;
columns whose names start with ``__`` are reserved, other columns are carried along whatever they are called; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group is ranked in before its winners meet.
SALTS = 64


def real_day(c: str) -> Column:
    """True where the text is ``YYYYMMDD`` and a calendar day; never null."""
    text = F.col(c)
    return F.coalesce(text.rlike(r"^\d{8}$") & F.try_to_date(F.when(text.rlike(r"^\d{8}$"), text), "yyyyMMdd").isNotNull(), F.lit(False))


def ranked_survivors(df: DataFrame, keys: list[str], order: list[Column], criteria: dict[str, Column], uid: str, salts: int = SALTS) -> DataFrame:
    """One row a group: its keys, ``group_rows``, and for each criterion a struct of the winning row's columns.

    ``order`` ranks best first and must end in a unique column; ``criteria`` name -> row filter.
    """
    fields = [c for c in df.columns if c not in keys]
    base = df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    base = base.withColumn("__salt", F.pmod(F.xxhash64(uid), F.lit(salts)))
    for n, cond in criteria.items():
        base = base.withColumn(f"__ok_{n}", F.coalesce(cond, F.lit(False)))

    def winners(d: DataFrame, by: list[str]) -> DataFrame:
        keep = None
        for n in criteria:
            w = Window.partitionBy(*by).orderBy(F.col(f"__ok_{n}").desc(), *order)
            d = d.withColumn(f"__rn_{n}", F.row_number().over(w))
            top = (F.col(f"__rn_{n}") == 1) & F.col(f"__ok_{n}")
            keep = top if keep is None else keep | top
        d = d.withColumn("__n", F.sum("__rows").over(Window.partitionBy(*by)))
        first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
        d = d.withColumn("__first", first)
        return d.where(keep | F.col("__first"))

    part = winners(base.withColumn("__rows", F.lit(1)), [*keys, "__salt"])
    # the rows of a part are counted once, on its first row
    part = part.withColumn("__rows", F.when(F.col("__first"), F.col("__n")).otherwise(0))
    top = winners(part.drop("__n", "__first", *[f"__rn_{n}" for n in criteria]), keys)
    row = F.struct(*[F.col(c) for c in fields])
    aggs = [F.max(F.when((F.col(f"__rn_{n}") == 1) & F.col(f"__ok_{n}"), row)).alias(n) for n in criteria]
    return top.groupBy(*keys).agg(F.max("__n").cast("long").alias("group_rows"), *aggs)


def best_values(df: DataFrame, keys: list[str], order: Column, fields: dict[str, Column], uid: str | None = None, prefer: dict[str, Column] | None = None) -> DataFrame:
    """The built record: for each field its value in the newest row where ``fields[name]`` holds.

    One hash aggregation with map-side combine; ``order`` is one comparable struct, greatest is best. Among the rows of a field those
    where ``prefer[name]`` holds come first. With ``uid`` a row with a null in a key is a record of its own, without it is left out.
    """
    first = {n: F.coalesce(cond, F.lit(False)) for n, cond in (prefer or {}).items()}
    rank = lambda n: F.struct(first[n], order) if n in first else order
    aggs = [F.max_by(F.col(n), F.when(F.coalesce(cond, F.lit(False)), rank(n))).alias(n) for n, cond in fields.items()]
    whole = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    rows = df.where(whole) if uid is None else df.withColumn("__own", F.when(~whole, F.col(uid)))
    return rows.groupBy(*keys, *([] if uid is None else ["__own"])).agg(F.count("*").alias("group_rows"), *aggs).drop("__own")
