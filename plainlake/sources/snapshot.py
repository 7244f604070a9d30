"""A snapshot: a set of tables from any container, loaded lazily, and written to any container."""

from __future__ import annotations

import gzip
import shutil
import tempfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainlake.functions.canon import NULL_MARK, ddl_type, encoded, spark_type
from plainlake.operators.compare import ROWID, fingerprint
from plainlake.operators.order import SYNTHETIC, ordered, with_synthetic_key
from plainlake.session import ship
from plainlake.sources import ddl, duck, settings, sqlite
from plainlake.sources.ddl import Column, Schema, Table

FORMATS = ("csv", "parquetdir", "sqlite", "duckdb", "parquet")


class FormatError(ValueError):
    pass


def detect(path: str | Path) -> str:
    """The container at `path`: a directory with schema.sql holds CSV files, or Parquet files if there is one; a file goes
    by its extension."""
    p = Path(path)
    if not p.exists():
        raise FormatError(f"{p} doesn't exist")
    if p.is_dir():
        if p.suffix.lower().startswith(".parquet") or any(p.glob("*.parquet")):
            return "parquetdir"
        if (p / "schema.sql").exists():
            return "csv"
        raise FormatError(f"{p} has no schema.sql")
    kind = {".sqlite": "sqlite", ".sqlite3": "sqlite", ".db": "sqlite", ".duckdb": "duckdb", ".parquet": "parquet"}.get(p.suffix.lower())
    if not kind:
        raise FormatError(f"{p}: unknown extension {p.suffix!r}")
    return kind


@dataclass
class Snapshot:
    spark: SparkSession
    schema: Schema
    tables: dict[str, DataFrame]
    settings: settings.Settings = field(default_factory=settings.Settings)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name!r}; there are {', '.join(sorted(self.tables)) or 'none'}")
        return self.tables[name]

    def pk(self, name: str) -> list[str]:
        return self.schema.tables[name].pk if name in self.schema.tables else []

    def sql(self, text: str) -> DataFrame:
        """A read-only statement over the tables and views; views are made in the order of their use."""
        from plainlake.plans.sql_runner import run_sql

        frames = dict(self.tables)
        for v in ddl.view_order(self.schema.views):
            frames[v] = run_sql(ddl.view_query(self.schema.views[v]), frames, self.spark)
        return run_sql(text, frames, self.spark)


def data_file(directory: Path, table: str) -> Path | None:
    return next((p for p in (directory / f"{table}.csv", directory / f"{table}.csv.gz") if p.exists()), None)


def read_csv(spark: SparkSession, path: str | Path, columns: Sequence[str]) -> DataFrame:
    """A headered, quoted CSV file as text; rows that are too short or too long, and another header, are errors. Only the
    mark is NULL: an empty field, quoted or not, is empty text."""
    kind = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(kind).csv(f"file://{path.resolve()}" if isinstance(path, Path) else path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False, nullValue="\x01", emptyValue="")
    return df.select(*[F.nullif(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(NULL_MARK)).alias(c) for c in columns])


def typed(df: DataFrame, table: Table) -> DataFrame:
    """Text columns as their declared types: empty or unreadable text is no number."""
    out = []
    for c in table.columns:
        x, kind = F.col(f"`{c.name}`"), spark_type(c.kind)
        if isinstance(kind, T.BinaryType):
            x = F.try_to_binary(x, F.lit("hex"))
        elif isinstance(kind, T.BooleanType):
            x = F.when(F.lower(x).isin("1", "true", "t", "yes"), True).when(F.lower(x).isin("0", "false", "f", "no"), False)
        elif not isinstance(kind, T.StringType):
            x = F.trim(x).try_cast(kind)
        out.append(x.alias(c.name))
    return df.select(*out)


def _listed(spark: SparkSession, url: str) -> dict[str, str]:
    """{name: URL} of what lies in a folder of any store that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(url)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(folder)}


def load_url(spark: SparkSession, url: str, tables: Sequence[str] = (), exclude: Sequence[str] = (), raw: bool = False) -> Snapshot:
    """The tables of a directory in a store that only Spark reads: Parquet files or folders of them, or CSV files."""
    there = _listed(spark, url)
    chosen = settings.Settings(tables=list(tables), exclude=list(exclude)).chosen
    text = spark.read.text(there["schema.sql"], wholetext=True).first()[0] if "schema.sql" in there else None
    schema, found = ddl.parse(text) if text else Schema(), {}
    parquet = {n.removesuffix(".parquet"): x for n, x in there.items() if n.endswith(".parquet")}
    if not parquet and not text:
        raise FormatError(f"{url} has no schema.sql and no Parquet")
    for t in chosen(sorted(parquet) if parquet else schema.tables):
        if parquet:
            found[t] = spark.read.parquet(parquet[t])
            schema.tables.setdefault(t, from_frame(t, found[t]))
        elif f := there.get(f"{t}.csv", there.get(f"{t}.csv.gz")):
            df = read_csv(spark, f, [c.name for c in schema.tables[t].columns])
            found[t] = df if raw else typed(df, schema.tables[t])
    return Snapshot(spark, schema, found)


def to_parquet_url(s: Snapshot, url: str, given: settings.Settings | None = None) -> list[str]:
    """schema.sql and one folder of Parquet files a table, in any store that Spark writes and at any size: every task sorts
    and writes its own range of the order, and nothing passes through the driver or one task."""
    given = given or settings.Settings()
    names = given.chosen(s.tables)
    for t in names:
        in_order(s, t, given).write.mode("error").parquet(f"{url}/{t}.parquet")
    folder = s.spark._jvm.org.apache.hadoop.fs.Path(url)
    out = folder.getFileSystem(s.spark.sparkContext._jsc.hadoopConfiguration()).create(s.spark._jvm.org.apache.hadoop.fs.Path(f"{url}/schema.sql"), True)
    try:
        out.write(_declared(s, names, given).text().encode())
    finally:
        out.close()
    return names


def load(spark: SparkSession, path: str | Path, tables: Sequence[str] = (), exclude: Sequence[str] = (), raw: bool = False) -> Snapshot:
    """The tables at `path` as lazy DataFrames; nothing is read but schemas. `raw` leaves CSV cells as text."""
    if "://" in str(path):
        return load_url(spark, str(path), tables, exclude, raw)
    p, kind = Path(path), detect(path)
    chosen = settings.Settings(tables=list(tables), exclude=list(exclude)).chosen
    if kind == "csv":
        schema = ddl.parse((p / "schema.sql").read_text())
        found = {}
        for t in chosen(schema.tables):
            f = data_file(p, t)
            names = [c.name for c in schema.tables[t].columns]
            df = read_csv(spark, f, names) if f else spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in names]))
            found[t] = df if raw else typed(df, schema.tables[t])
        return Snapshot(spark, schema, found, settings.load(p) or settings.Settings())
    if kind in ("parquetdir", "parquet"):
        files = {x.stem: x for x in sorted(p.glob("*.parquet"))} if p.is_dir() else {p.stem: p}
        found = {t: spark.read.parquet(f"file://{files[t].resolve()}") for t in chosen(files)}
        schema = ddl.parse((p / "schema.sql").read_text()) if p.is_dir() and (p / "schema.sql").exists() else Schema()
        for t, df in found.items():
            schema.tables.setdefault(t, from_frame(t, df))
        return Snapshot(spark, schema, found, (settings.load(p) if p.is_dir() else None) or settings.Settings())
    if kind == "sqlite":
        ship(spark)
        spark.dataSource.register(sqlite.SqliteSource)
        schema = sqlite.read_schema(str(p))
        reader = lambda t: spark.read.format("plainlake_sqlite").schema(sqlite.table_schema(schema, t)).option("table", t).load(str(p.resolve()))
    else:
        schema = duck.read_schema(str(p))
        reader = lambda t: duck.read(spark, str(p), t)
    return Snapshot(spark, schema, {t: reader(t) for t in chosen(schema.tables)})


def from_frame(name: str, df: DataFrame) -> Table:
    """The declaration of a frame; its key is id or <name without s>_id."""
    names = [f.name for f in df.schema]
    pk = next(([c] for c in ("id", f"{name.removesuffix('s')}_id") if c in names), [])
    return Table(name, [Column(f.name, ddl_type(f.dataType)) for f in df.schema], pk)


def from_frames(spark: SparkSession, frames: Mapping[str, DataFrame]) -> Snapshot:
    return Snapshot(spark, Schema({t: from_frame(t, df) for t, df in frames.items()}), dict(frames))


def _sorted_parts(df: DataFrame, tmp: str, kind: str, **options) -> list[Path]:
    """The files of rows that are in order, in that order: every task sorts and writes its own range."""
    df.write.mode("overwrite").format(kind).options(**options).save(f"file://{tmp}/out")
    return sorted(x for x in Path(tmp, "out").iterdir() if x.name.startswith("part-"))


def in_order(s: Snapshot, t: str, given: settings.Settings) -> DataFrame:
    df = s.tables[t]
    if given.order_by:
        return ordered(df, order_by=given.order_by)
    if given.order == "add-synthetic-key":
        return with_synthetic_key(df).orderBy(SYNTHETIC)
    return ordered(df, s.pk(t), given.order, given.natural_sort)


def write_csv(df: DataFrame, to: Path, null_mode: str = "marker", compressed: bool = False) -> None:
    """UTF-8, commas, every field quoted, "" for a quote, line feeds, a header: the same rows give the same bytes."""
    out = df.select(*[encoded(F.col(f"`{f.name}`"), f.dataType, null_mode).alias(f.name) for f in df.schema])
    header = ",".join('"' + c.replace('"', '""') + '"' for c in out.columns) + "\n"
    target = f"{to}.gz" if compressed else to
    with tempfile.TemporaryDirectory(prefix="plainlake-write-", dir=to.parent) as tmp:
        parts = _sorted_parts(out, tmp, "csv", header=False, quoteAll=True, escape='"', nullValue=NULL_MARK, emptyValue="", lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        with open(target, "wb") as raw, gzip.GzipFile("", "wb", fileobj=raw, mtime=0) if compressed else raw as f:
            f.write(header.encode())
            for part in parts:  # bytes only: the rows were sorted and written in parallel
                with open(part, "rb") as p:
                    shutil.copyfileobj(p, f, 1 << 20)


def write_parquet(df: DataFrame, to: Path) -> None:
    """One sorted file: the tasks' row groups in order."""
    import pyarrow.parquet as pq

    with tempfile.TemporaryDirectory(prefix="plainlake-write-", dir=to.parent) as tmp:
        parts = _sorted_parts(df, tmp, "parquet", compression="snappy")
        if len(parts) == 1:
            shutil.move(parts[0], to)
            return
        writer = None
        for part in parts:
            f = pq.ParquetFile(part)
            writer = writer or pq.ParquetWriter(to, f.schema_arrow, compression="snappy")
            for k in range(f.num_row_groups):
                writer.write_table(f.read_row_group(k))
        if writer:
            writer.close()


def _swap(build, to: Path, force: bool) -> None:
    """Builds beside `to` and puts the result in its place when it is whole."""
    if to.exists() and not force:
        raise FileExistsError(f"{to} exists")
    tmp = Path(tempfile.mkdtemp(prefix=f".{to.name}-", dir=to.parent))
    try:
        build(tmp / "new")
        if to.is_dir():
            shutil.rmtree(to)
        elif to.exists():
            to.unlink()
        shutil.move(tmp / "new", to)
    finally:
        shutil.rmtree(tmp, ignore_errors=True)


def _declared(s: Snapshot, names: Sequence[str], given: settings.Settings) -> Schema:
    tables = {t: s.schema.tables[t] for t in names}
    if given.order == "add-synthetic-key" and not given.order_by:
        tables = {t: Table(t, [Column(SYNTHETIC, "INTEGER"), *x.columns], x.pk) for t, x in tables.items()}
    return Schema(tables, s.schema.views if set(names) == set(s.schema.tables) else {})


def to_csv(s: Snapshot, to: str | Path, given: settings.Settings | None = None, force: bool = False) -> list[str]:
    """A directory with schema.sql, the settings and one CSV file a table; the tables written."""
    given = given or settings.Settings()
    names = given.chosen(s.tables)

    def build(new: Path) -> None:
        new.mkdir()
        (new / "schema.sql").write_text(_declared(s, names, given).text())
        for t in names:
            write_csv(in_order(s, t, given), new / f"{t}.csv", given.null_mode, given.compressed)
        (new / settings.FILE).write_text(given.text())

    _swap(build, Path(to), force)
    return names


def to_csv_incremental(s: Snapshot, to: str | Path, given: settings.Settings | None = None) -> dict[str, str]:
    """Writes only tables whose fingerprint is not the one in the settings file, and says of each table what became of it.
    Tables outside the filter are left alone; a file in the other compression goes when its table is written."""
    given, to = given or settings.Settings(), Path(to)
    before = (settings.load(to) or settings.Settings()).table_checksums if to.is_dir() else {}
    to.mkdir(exist_ok=True)
    names, out = given.chosen(s.tables), {}
    now = {t: fingerprint(s.tables[t]).first()["digest"] for t in names}
    for t in names:
        there = data_file(to, t)
        out[t] = "unchanged" if before.get(t) == now[t] and there else "updated" if t in before else "added"
        if out[t] != "unchanged":
            new = to / f".new-{t}.csv"  # whole before it takes the old one's place
            write_csv(in_order(s, t, given), new, given.null_mode, given.compressed)
            ending, other = (".csv.gz", ".csv") if given.compressed else (".csv", ".csv.gz")
            Path(f"{new}.gz" if given.compressed else new).replace(to / f"{t}{ending}")
            (to / f"{t}{other}").unlink(missing_ok=True)
    for t in given.chosen(before):
        if t not in s.schema.tables:
            out[t] = "removed"
            for f in (to / f"{t}.csv", to / f"{t}.csv.gz"):
                f.unlink(missing_ok=True)
    kept = {t: c for t, c in before.items() if t not in out} | now
    given.table_checksums = kept
    (to / "schema.sql").write_text(Schema({t: x for t, x in s.schema.tables.items() if t in kept}, s.schema.views).text())
    (to / settings.FILE).write_text(given.text())
    return out


def to_parquet(s: Snapshot, to: str | Path, given: settings.Settings | None = None, force: bool = False) -> list[str]:
    """A directory with schema.sql and one sorted Parquet file a table."""
    given = given or settings.Settings()
    names = given.chosen(s.tables)

    def build(new: Path) -> None:
        new.mkdir()
        (new / "schema.sql").write_text(_declared(s, names, given).text())
        for t in names:
            write_parquet(in_order(s, t, given), new / f"{t}.parquet")
        (new / settings.FILE).write_text(given.text())

    _swap(build, Path(to), force)
    return names


def to_sqlite(s: Snapshot, to: str | Path, force: bool = False) -> None:
    _swap(lambda new: sqlite.write(str(new), s.schema, s.tables), Path(to), force)


def to_duckdb(s: Snapshot, to: str | Path, force: bool = False) -> None:
    _swap(lambda new: duck.write(str(new), s.schema, s.tables), Path(to), force)


def checksum(s: Snapshot, tables: Sequence[str] = (), exclude: Sequence[str] = ()) -> str:
    """The sequential checksum of the chosen tables, equal for equal content in any container."""
    from plainlake.operators.compare import checksum as of

    names = settings.Settings(tables=list(tables), exclude=list(exclude)).chosen(s.tables)
    views = list(s.schema.views) if not tables and not exclude else []
    return of({t: s.tables[t] for t in names}, {t: [(c.name, c.kind) for c in s.schema.tables[t].columns] for t in names}, {t: s.pk(t) for t in names}, views)


__all__ = ["FORMATS", "ROWID", "Snapshot", "checksum", "detect", "from_frames", "load", "to_csv", "to_csv_incremental", "to_duckdb", "to_parquet", "to_parquet_url", "to_sqlite"]
