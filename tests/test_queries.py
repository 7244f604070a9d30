"""Every registered query with a twin, on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def twin():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def _rows(columns, rows):
    fix = lambda v: float(f"{v:.6g}") if isinstance(v, float) and not math.isnan(v) else v
    return sorted(([fix(r[c]) for c in columns] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, twin, name):
    df = entry.queries()[name](spark, DIR)
    rel = twin.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    assert _rows(columns, df.collect()) == _rows(columns, [dict(zip(rel.columns, r)) for r in rel.fetchall()])


@pytest.mark.parametrize("name", ["diff_cells", "diff_rows", "merge_conflicts"])
def test_shifted_keys_meet(spark, tmp_path, name):
    """Orders whose keys reach beyond a million meet the ones that the versions shift there, with another customer."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT i + s AS o_orderkey, i * 3 + s AS o_custkey, 1000.5 + i AS o_totalprice, CASE WHEN i % 3 = 0 THEN 'O' ELSE 'F' END AS o_orderstatus FROM range(1, 90) a(i), (VALUES (0), (1000000)) b(s)")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    df, rel = entry.queries()[name](spark, str(tmp_path)), con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert _rows(columns, df.collect()) == _rows(columns, [dict(zip(rel.columns, r)) for r in rel.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
