"""SQLite as a Spark data source (the Python DataSource API) and as a sink."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plainlake.functions.canon import normal_type, spark_type
from plainlake.sources.ddl import Schema, from_connection, quoted


def read_schema(path: str) -> Schema:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        return from_connection(con)
    finally:
        con.close()


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Splits a table by ranges of rowid, which are read in parallel; tables without one are one partition."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.parts = int(options.get("partitions", "8"))

    def _open(self) -> sqlite3.Connection:
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        return con

    def partitions(self) -> list[InputPartition]:
        con = self._open()
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        except sqlite3.Error:
            return [_Range(0, -1)]
        finally:
            con.close()
        if low is None:
            return [_Range(1, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if (partition.low, partition.high) == (1, 0):
            return
        con = self._open()
        try:
            names = ", ".join(quoted(f.name) for f in self.schema)
            where = "" if partition.high < partition.low else f" WHERE rowid BETWEEN {partition.low} AND {partition.high}"
            for row in con.execute(f"SELECT {names} FROM {quoted(self.table)}{where}"):
                yield tuple(_fit(v, f.dataType) for v, f in zip(row, self.schema))
        finally:
            con.close()


def _fit(v, kind: T.DataType):
    """A value as its declared type holds it; what doesn't fit a number is NULL, and text takes any value's text."""
    if v is None:
        return None
    if isinstance(kind, T.BinaryType):
        return v if isinstance(v, bytes) else str(v).encode()
    if isinstance(kind, T.StringType):
        return v.hex() if isinstance(v, bytes) else str(v)
    try:
        if isinstance(kind, T.BooleanType):
            return bool(int(v))
        return int(v) if isinstance(kind, T.LongType) else float(v)
    except (TypeError, ValueError):
        return None


class SqliteSource(DataSource):
    """spark.read.format("plainlake_sqlite").option("table", t).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "plainlake_sqlite"

    def schema(self) -> T.StructType:
        return table_schema(read_schema(self.options["path"]), self.options["table"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def table_schema(schema: Schema, table: str) -> T.StructType:
    """SQLite keeps dates, decimals and the like as text or numbers: they are read as such."""
    if table not in schema.tables:
        raise ValueError(f"no table {table!r}; there are {', '.join(sorted(schema.tables)) or 'none'}")
    simple = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}
    return T.StructType([T.StructField(c.name, simple.get(normal_type(c.kind), T.DoubleType() if isinstance(spark_type(c.kind), T.DecimalType) else T.StringType())) for c in schema.tables[table].columns])


def write(path: str, schema: Schema, tables: dict[str, DataFrame], batch: int = 5000) -> None:
    """SQLite has one writer: rows stream through the driver in batches, a table at a time, inside one transaction."""
    con = sqlite3.connect(path)
    try:
        con.execute("PRAGMA foreign_keys = OFF")
        from plainlake.sources.ddl import table_order, view_order

        for t in table_order({n: x.ddl() for n, x in schema.tables.items()}, strict=False):
            con.execute(schema.tables[t].ddl())
            if t not in tables:
                continue
            df = tables[t]
            insert = f"INSERT INTO {quoted(t)} ({', '.join(map(quoted, df.columns))}) VALUES ({', '.join('?' * len(df.columns))})"
            held: list[tuple] = []
            for row in df.toLocalIterator():
                held.append(tuple(bytes(v) if isinstance(v, bytearray) else v if isinstance(v, (int, float, str, bytes, type(None))) else str(v) for v in row))
                if len(held) >= batch:
                    con.executemany(insert, held)
                    held.clear()
            con.executemany(insert, held)
            for index in schema.tables[t].indexes:
                con.execute(index)
        for v in view_order(schema.views):
            con.execute(schema.views[v])
        con.commit()
    finally:
        con.close()
