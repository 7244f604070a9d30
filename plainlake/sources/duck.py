"""DuckDB files as source and sink; the wheel is imported only here."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from plainlake.session import Workspace
from plainlake.sources.ddl import Column, Schema, Table, create_table, quoted, table_order, view_order


def read_schema(path: str) -> Schema:
    import duckdb

    con = duckdb.connect(path, read_only=True)
    try:
        out = Schema()
        for t, c, kind, null in con.execute("SELECT table_name, column_name, data_type, is_nullable FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN (SELECT table_name FROM duckdb_tables()) ORDER BY table_name, ordinal_position").fetchall():
            out.tables.setdefault(t, Table(t, [])).columns.append(Column(c, kind, null == "NO"))
        for t, cols in con.execute("SELECT table_name, constraint_column_names FROM duckdb_constraints() WHERE constraint_type = 'PRIMARY KEY'").fetchall():
            out.tables[t].pk = list(cols)
        for v, sql in con.execute("SELECT view_name, sql FROM duckdb_views() WHERE NOT internal").fetchall():
            out.views[v] = sql.rstrip(";\n")
        for t in out.tables.values():
            t.sql = create_table(t)
        return out
    finally:
        con.close()


def local_path(url: str) -> Path:
    parts = urlparse(url)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{url}: DuckDB files need a shared folder with a path (file:)")
    return Path(parts.path)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The engine writes the table as Parquet into the shared folder, and Spark reads that. The file is opened on the driver,
    so the shared folder must be one that the driver can write to by a path (file:)."""
    import duckdb

    to = local_path(Workspace(spark, "duck").path) / "t.parquet"
    to.parent.mkdir(parents=True)
    con = duckdb.connect(path, read_only=True)
    try:
        con.execute(f"COPY (SELECT * FROM {quoted(table)}) TO '{to}' (FORMAT PARQUET)")
    finally:
        con.close()
    return spark.read.parquet(f"file://{to}")


def write(path: str, schema: Schema, tables: dict[str, DataFrame]) -> None:
    """Each table goes through Parquet, so rows are not moved one by one; REAL is written as DOUBLE to keep precision."""
    import re

    import duckdb

    con = duckdb.connect(path)
    try:
        for t in table_order({n: x.ddl() for n, x in schema.tables.items()}, strict=False):
            ddl = create_table(Table(t, [Column(c.name, re.sub(r"^REAL$", "DOUBLE", c.kind, flags=re.I), c.notnull, c.default) for c in schema.tables[t].columns], schema.tables[t].pk))
            con.execute(ddl)
            if t in tables:
                ws = Workspace(tables[t].sparkSession, "duck")
                if ws.save(tables[t], "t").limit(1).count():
                    names = ", ".join(map(quoted, tables[t].columns))
                    con.execute(f"INSERT INTO {quoted(t)} ({names}) SELECT {names} FROM read_parquet('{local_path(ws.path)}/t/*.parquet')")
                ws.drop()
        for v in view_order(schema.views):
            con.execute(schema.views[v])
    finally:
        con.close()
