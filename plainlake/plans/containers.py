"""Containers, order, filters and outputs as registered queries: a table is written, read back, and compared with itself.

The files lie in the folder that driver and executors share, as on a cluster; the twins read the tables they came from.
"""

from __future__ import annotations

import sqlite3
import threading
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainlake import api
from plainlake.functions.canon import double_text
from plainlake.operators import compare
from plainlake.plans import show
from plainlake.session import Workspace
from plainlake.sources import hooks, snapshot
from plainlake.sources.duck import local_path
from plainlake.sources.settings import Settings, load, resolve
from plainlake.streaming.watch import watch

Query = Callable[[SparkSession, str], DataFrame]


def _folder(spark: SparkSession) -> Path:
    to = local_path(Workspace(spark, "containers").path)
    to.mkdir(parents=True)
    return to


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with holes, quotes, commas and line feeds."""
    c = _table(spark, sf_dir, "customer")
    odd = F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 5 == 1, F.concat(F.lit('a "b", '), "c_name", F.lit("\n"))).when(F.col("c_custkey") % 5 == 2, "").otherwise(F.col("c_name"))
    return c.select(F.col("c_custkey").alias("id"), odd.alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("balance"))


_NULLS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'a "b", ' || c_name || chr(10) WHEN c_custkey % 5 = 2 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS balance FROM customer"""


def _round_trip(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = snapshot.from_frames(spark, {"people": _with_nulls(spark, sf_dir)})
        to = _folder(spark) / {"csv": "x", "gz": "x", "parquetdir": "x.parquets", "sqlite": "x.sqlite", "duckdb": "x.duckdb"}[kind]
        if kind in ("csv", "gz"):
            snapshot.to_csv(s, to, Settings(compressed=kind == "gz"))
        else:
            {"parquetdir": snapshot.to_parquet, "sqlite": snapshot.to_sqlite, "duckdb": snapshot.to_duckdb}[kind](s, to)
        return snapshot.load(spark, to)["people"].select("id", "name", F.col("balance").cast("double").alias("balance"))

    return run


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one table from each container, with what the container was taken for."""
    s, to, out = snapshot.from_frames(spark, {"region": _table(spark, sf_dir, "region")}), _folder(spark), None
    given = Settings(order="all-columns")
    snapshot.to_csv(s, to / "a", given)
    snapshot.to_parquet(s, to / "b", given)
    snapshot.to_sqlite(s, to / "c.db")
    snapshot.to_duckdb(s, to / "d.duckdb")
    for path in (to / "a", to / "b", to / "c.db", to / "d.duckdb", to / "b" / "region.parquet"):
        rows = snapshot.load(spark, path)["region"].select(F.lit(snapshot.detect(path)).alias("kind"), F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name")
        out = rows if out is None else out.unionByName(rows)
    return out


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of a CSV file, line by line with their places."""
    to = _folder(spark) / "x"
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("name"), (F.col("n_nationkey") / 8).alias("share"))
    snapshot.to_csv(snapshot.from_frames(spark, {"t": n}), to, Settings(natural_sort=True))
    return _placed(spark, to / "t.csv")


def _placed(spark: SparkSession, path: Path) -> DataFrame:
    return spark.read.text(f"file://{path}").select((F.monotonically_increasing_id() + 1).alias("place"), F.col("value").alias("line"))


def row_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small table written in every order."""
    rows, to, out = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("n")), _folder(spark), None
    s = snapshot.from_frames(spark, {"t": rows})
    for name, given in {"pk": Settings(), "natural": Settings(natural_sort=True), "clause": Settings(order_by="n DESC, id"), "all": Settings(order="all-columns"), "key": Settings(order="add-synthetic-key")}.items():
        snapshot.to_csv(s, to / name, given)
        lines = _placed(spark, to / name / "t.csv").filter("place > 1").select(F.lit(name).alias("mode"), (F.col("place") - 1).alias("place"), F.regexp_extract("line", '"(s[0-9]+)"', 1).alias("id"))
        out = lines if out is None else out.unionByName(lines)
    return out


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second export makes of each table, and the rows that are there then."""
    to, read = _folder(spark) / "x", lambda t: _table(spark, sf_dir, t)
    given = lambda: Settings(order="all-columns")
    snapshot.to_csv_incremental(snapshot.from_frames(spark, {"nation": read("nation"), "region": read("region"), "supplier": read("supplier")}), to, given())
    did = snapshot.to_csv_incremental(snapshot.from_frames(spark, {"nation": read("nation").repartition(3), "region": read("region").filter("r_regionkey > 0"), "customer": read("customer")}), to, given())
    there = snapshot.load(spark, to).tables
    out = spark.createDataFrame(sorted(did.items()), "table_name string, status string")
    counts = None
    for t in ("nation", "region", "customer"):
        c = there[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        counts = c if counts is None else counts.unionByName(c)
    return out.join(counts, "table_name", "left").select("table_name", "status", F.coalesce("n", F.lit(0)).alias("n"))


def table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the tables that each filter leaves."""
    s, to, out = snapshot.from_frames(spark, {t: _table(spark, sf_dir, t) for t in ("nation", "region", "supplier")}), _folder(spark), None
    snapshot.to_parquet(s, to / "x", Settings(order="all-columns"))
    for name, given in {"all": {}, "only": {"tables": ["nation", "region"]}, "without": {"exclude": ["nation"]}}.items():
        for t, df in snapshot.load(spark, to / "x", **given).tables.items():
            c = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("filter"), F.lit(t).alias("table_name"), "n")
            out = c if out is None else out.unionByName(c)
    return out


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory is rebuilt as a database after a change; the rows are those of the last build."""
    to = _folder(spark)
    region = _table(spark, sf_dir, "region")
    given = Settings(order="all-columns")
    snapshot.to_csv(snapshot.from_frames(spark, {"region": region.filter("r_regionkey < 2")}), to / "x", given)
    built, changed = threading.Semaphore(0), []

    def build() -> None:
        snapshot.to_sqlite(snapshot.load(spark, to / "x"), to / "x.sqlite", force=True)
        built.release()

    def stop() -> bool:
        if not changed:
            snapshot.write_csv(region.orderBy("r_regionkey"), to / "x" / "region.csv")
            changed.append(1)
        return built.acquire(blocking=False) and built.acquire(blocking=False)

    builds = watch(to / "x", build, debounce=0.1, poll=0.05, stop=lambda: stop() or _rows(to / "x.sqlite") == 5)
    return snapshot.load(spark, to / "x.sqlite")["region"].select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name", F.lit(builds >= 2).alias("rebuilt"))


def _rows(path: Path) -> int:
    con = sqlite3.connect(path)
    try:
        return con.execute("SELECT count(*) FROM region").fetchone()[0]
    finally:
        con.close()


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that schema.sql declares, written and parsed again."""
    to = _folder(spark) / "x"
    snapshot.to_csv(snapshot.from_frames(spark, {t: _table(spark, sf_dir, t) for t in ("nation", "customer", "supplier")}), to, Settings(order="all-columns"))
    s = snapshot.load(spark, to).schema
    return spark.createDataFrame([(t, c.name, c.kind) for t, x in s.tables.items() for c in x.columns], "table_name string, column_name string, kind string")


def through_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read to Arrow and to pandas, and frames of them written and read again."""
    to = _folder(spark)
    api.to_parquet({"nation": _table(spark, sf_dir, "nation")}, to / "x", spark, order="all-columns")
    arrow, pandas = api.to_arrow(to / "x", "nation", spark), api.sql_pandas("SELECT * FROM nation WHERE n_regionkey < 3", to / "x", spark)
    api.to_csv({"arrow": spark.createDataFrame(arrow), "pandas": spark.createDataFrame(pandas)}, to / "y", spark, order="all-columns")
    back = api.load(to / "y", spark).tables
    return back["arrow"].withColumn("way", F.lit("arrow")).unionByName(back["pandas"].withColumn("way", F.lit("pandas")))


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as CSV and as a table, line by line."""
    r = _table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_regionkey", F.when(F.col("r_regionkey") != 2, F.col("r_name")).alias("r_name"))
    lines = [("csv", i, x) for i, x in enumerate(show.to_csv(r).splitlines())]
    lines += [("table", i, "|".join(c.strip() for c in x.split("│")[1:-1])) for i, x in enumerate(show.to_table(r).splitlines()) if x.startswith("│")]
    return spark.createDataFrame(lines, "way string, place long, line string")


def settings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a written directory, and what is resolved from them and a caller's."""
    to = _folder(spark) / "x"
    snapshot.to_csv(snapshot.from_frames(spark, {"nation": _table(spark, sf_dir, "nation")}), to, Settings(order="all-columns", null_mode="excel", compressed=True))
    found, both = load(to), resolve(to, order_by="n_name", null_mode="mysql")
    rows = [("file", "order", found.order), ("file", "null_mode", found.null_mode), ("file", "compressed", str(found.compressed)), ("both", "order_by", both.order_by), ("both", "null_mode", both.null_mode), ("both", "compressed", str(both.compressed))]
    return spark.createDataFrame(rows, "source string, name string, value string")


def git_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks installed from a subfolder, beside one of another origin, and taken away again."""
    to = _folder(spark)
    (to / ".git" / "hooks").mkdir(parents=True)
    (to / "a" / "b").mkdir(parents=True)
    (to / ".git" / "hooks" / "post-merge").write_text("#!/bin/sh\nexit 0\n")
    rows = [("install", n) for n in hooks.install(to / "a" / "b")] + [("there", f.name) for f in sorted((to / ".git" / "hooks").iterdir())]
    rows += [("uninstall", n) for n in hooks.uninstall(to / "a" / "b")] + [("left", f.name) for f in sorted((to / ".git" / "hooks").iterdir())]
    return spark.createDataFrame(rows, "step string, hook string")


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequential checksum of the same rows in every container, and of other rows."""
    s, to = snapshot.from_frames(spark, {"t": _with_nulls(spark, sf_dir).withColumn("id", F.col("id"))}), _folder(spark)
    snapshot.to_csv(s, to / "a")
    snapshot.to_parquet(s, to / "b")
    snapshot.to_sqlite(s, to / "c.db")
    first = snapshot.checksum(snapshot.load(spark, to / "a"))
    rows = [(n, snapshot.checksum(snapshot.load(spark, to / n)) == first) for n in ("b", "c.db")]
    rows.append(("other", snapshot.checksum(snapshot.from_frames(spark, {"t": s["t"].filter("id <> 7")})) == first))
    return spark.createDataFrame(rows, "container string, same boolean")


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and errors that are found in a sound directory and in one with a repeated key and a torn file."""
    to = _folder(spark)
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    snapshot.to_csv(snapshot.from_frames(spark, {"nation": n}), to / "x")
    snapshot.to_csv(snapshot.from_frames(spark, {"nation": n.unionByName(n.filter("id = 3")), "torn": n}), to / "y")
    with open(to / "y" / "torn.csv", "a") as f:
        f.write('"99"\n')
    good, bad = api.validate(spark, to / "x"), api.validate(spark, to / "y")
    return spark.createDataFrame([("good", good.rows.get("nation"), len(good.errors)), ("bad", bad.rows.get("nation"), len(bad.errors))], "directory string, n long, n_errors long")


def keys_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a table whose columns are all keys, merged."""
    base = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    more = lambda k: base.filter(f"o_orderkey % 17 = {k}").select((F.col("o_orderkey") + 10**6 + k * 10**6).alias("o_orderkey"), "o_custkey")
    left, right = base.filter("o_orderkey % 5 <> 0").unionByName(more(1)), base.filter("o_orderkey % 7 <> 0").unionByName(more(2)).unionByName(more(1))
    pk = ["o_orderkey", "o_custkey"]
    return compare.merged_table(compare.merge(base, left, right, pk), pk).select(*[F.col(c).cast("bigint").alias(c) for c in pk])


def doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of numbers from 1e-30 to 9e30, with one and with three digits."""
    k = F.col("o_orderkey") % 61 - 30
    one, three = F.concat((F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("e"), k.cast("string")), F.concat(F.lit("-1.2"), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("e"), k.cast("string"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", double_text(one.cast("double")).alias("one"), double_text(three.cast("double")).alias("three"))


_DIGITS = """CASE WHEN k >= {n} THEN '{s}' || {d} || repeat('0', k - {n}) WHEN k < 0 THEN '{s}0.' || repeat('0', -k - 1) || {d} ELSE '{s}' || left({d}, k + 1) || '.' || substr({d}, k + 2) END"""

QUERIES: dict[str, Query] = {
    "container_csv": _round_trip("csv"), "container_csv_gz": _round_trip("gz"), "container_parquet": _round_trip("parquetdir"), "container_sqlite": _round_trip("sqlite"), "container_duckdb": _round_trip("duckdb"),
    "container_detection": detection, "csv_lines": csv_lines, "row_orders": row_orders, "incremental_export": incremental, "table_filter": table_filter, "watch_directory": watched, "declarations": declarations,
    "arrow_and_frames": through_arrow, "result_formats": shown, "settings_file": settings_file, "git_hooks": git_hooks, "checksums": checksums, "validation": validation, "merge_keys_only": keys_only, "double_text": doubles,
}

ORACLES: dict[str, str] = {f"container_{k}": _NULLS for k in ("csv", "csv_gz", "parquet", "sqlite", "duckdb")} | {
    "container_detection": "SELECT kind, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region CROSS JOIN (VALUES ('csv'), ('parquetdir'), ('sqlite'), ('duckdb'), ('parquet')) v(kind)",
    "csv_lines": """SELECT 1 AS place, '"id","name","share"' AS line UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey) + 1, '"' || n_nationkey || '","' || CASE WHEN n_regionkey <> 1 THEN n_name ELSE '\\N' END || '","' || CASE WHEN n_nationkey % 8 = 0 THEN CAST(n_nationkey // 8 AS VARCHAR) ELSE CAST(n_nationkey / 8 AS VARCHAR) END || '"' FROM nation""",
    "row_orders": "WITH s AS (SELECT 's' || s_suppkey AS id, s_suppkey AS k, CAST(s_nationkey AS VARCHAR) AS t, s_nationkey AS n FROM supplier) SELECT 'pk' AS mode, row_number() OVER (ORDER BY id) AS place, id FROM s UNION ALL SELECT 'all', row_number() OVER (ORDER BY id, t), id FROM s UNION ALL SELECT 'key', row_number() OVER (ORDER BY id, t), id FROM s UNION ALL SELECT 'natural', row_number() OVER (ORDER BY k), id FROM s UNION ALL SELECT 'clause', row_number() OVER (ORDER BY n DESC, id), id FROM s",
    "incremental_export": "SELECT 'nation' AS table_name, 'unchanged' AS status, count(*) AS n FROM nation UNION ALL SELECT 'region', 'updated', count(*) FILTER (WHERE r_regionkey > 0) FROM region UNION ALL SELECT 'customer', 'added', count(*) FROM customer UNION ALL SELECT 'supplier', 'removed', 0",
    "table_filter": "WITH c AS (SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier) SELECT 'all' AS filter, * FROM c UNION ALL SELECT 'only', * FROM c WHERE table_name <> 'supplier' UNION ALL SELECT 'without', * FROM c WHERE table_name <> 'nation'",
    "watch_directory": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, true AS rebuilt FROM region",
    "declarations": "SELECT table_name, column_name, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'INTEGER' WHEN data_type = 'DOUBLE' THEN 'REAL' ELSE 'TEXT' END AS kind FROM information_schema.columns WHERE table_name IN ('nation', 'customer', 'supplier')",
    "arrow_and_frames": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, 'arrow' AS way FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'pandas' FROM nation WHERE n_regionkey < 3",
    "result_formats": "WITH r AS (SELECT r_regionkey AS k, CASE WHEN r_regionkey <> 2 THEN r_name END AS n, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) SELECT 'csv' AS way, 0 AS place, 'r_regionkey,r_name' AS line UNION ALL SELECT 'csv', i, k || ',' || coalesce(n, '') FROM r UNION ALL SELECT 'table', 1, 'r_regionkey|r_name' UNION ALL SELECT 'table', i + 2, k || '|' || coalesce(n, 'NULL') FROM r",
    "settings_file": "SELECT * FROM (VALUES ('file', 'order', 'all-columns'), ('file', 'null_mode', 'empty'), ('file', 'compressed', 'True'), ('both', 'order_by', 'n_name'), ('both', 'null_mode', 'literal'), ('both', 'compressed', 'True')) v(source, name, value)",
    "git_hooks": "SELECT * FROM (VALUES ('install', 'pre-commit'), ('there', 'post-merge'), ('there', 'pre-commit'), ('uninstall', 'pre-commit'), ('left', 'post-merge')) v(step, hook)",
    "checksums": "SELECT * FROM (VALUES ('b', true), ('c.db', true), ('other', false)) v(container, same)",
    "validation": "SELECT 'good' AS directory, count(*) AS n, CAST(0 AS BIGINT) AS n_errors FROM nation UNION ALL SELECT 'bad', count(*) + 1, 2 FROM nation",
    "merge_keys_only": "WITH b AS (SELECT o_orderkey, o_custkey FROM orders), m AS (SELECT o_orderkey % 17 AS k, o_orderkey + 1000000 + (o_orderkey % 17) * 1000000 AS o_orderkey, o_custkey FROM orders WHERE o_orderkey % 17 IN (1, 2)) SELECT o_orderkey, o_custkey FROM b WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, o_custkey FROM m",
    "double_text": f"WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 61 - 30 AS INTEGER) AS k, CAST(o_orderkey % 9 + 1 AS VARCHAR) AS d, '12' || (o_orderkey % 9 + 1) AS t FROM orders) SELECT o_orderkey, {_DIGITS.format(n=0, s='', d='d')} AS one, {_DIGITS.format(n=2, s='-', d='t')} AS three FROM o",
}
