"""Every registered query runs on the smallest tables, and those with SQL give the same rows as a second engine."""

import importlib.util
import math
import os
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
spec = importlib.util.spec_from_file_location("__spark_entry__", ROOT / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
CORE = sorted(k for k in entry.registry.queries())


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (int, Decimal)):
        return f"{float(v):.6f}"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(map(lambda i: value(r[i]) or "~", order)) for r in records)


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(tiny):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{tiny}/{f}')")
    return con


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70
    df = entry.entry(spark)
    assert df.count() > 0 and "doc_id" in df.columns


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, tiny, name):
    df = entry.queries()[name](spark, tiny)
    got = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(got, df.columns) == rows(cur.fetchall(), names)
    spark.catalog.clearCache()


def test_core_doesnt_need_the_subpackage():
    for p in (ROOT / "gyeol").rglob("*.py"):
        if "llm" not in p.parts:
            assert "gyeol.llm" not in p.read_text(encoding="utf-8"), p
