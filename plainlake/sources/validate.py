"""Structural validation of a directory: schema, files, headers, arity, keys and settings."""

from __future__ import annotations

import csv
import gzip
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from plainlake.operators.compare import fingerprint
from plainlake.operators.order import duplicate_keys
from plainlake.sources import ddl, settings
from plainlake.sources.snapshot import data_file, detect, read_csv


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    rows: dict[str, int] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return not self.errors


def header(path: Path) -> list[str]:
    with (gzip.open(path, "rt", encoding="utf-8", newline="") if path.suffix == ".gz" else open(path, encoding="utf-8", newline="")) as f:
        return next(csv.reader(f), [])


def validate(spark: SparkSession, path: str | Path) -> Report:
    """Every problem that is found, not the first; a missing data file is a warning, as an empty table needs none."""
    p, out = Path(path), Report()
    kind = detect(p)
    try:
        settings.load(p)
    except (ValueError, TypeError) as e:
        out.errors.append(f"settings: {e}")
    if not (p / "schema.sql").exists():
        out.errors.append("schema.sql is missing")
        return out
    try:
        schema = ddl.parse((p / "schema.sql").read_text())
        schema.text()
    except (ddl.SchemaError, ValueError) as e:
        out.errors.append(f"schema.sql: {e}")
        return out
    for name, table in schema.tables.items():
        names = [c.name for c in table.columns]
        f = p / f"{name}.parquet" if kind == "parquetdir" else data_file(p, name)
        if f is None or not f.exists():
            out.warnings.append(f"{name}: no data file")
            continue
        try:
            if kind == "parquetdir":
                df = spark.read.parquet(f"file://{f.resolve()}")
                found = df.columns
            else:
                found = header(f)
                df = read_csv(spark, f, names)
            if found != names:
                out.errors.append(f"{name}: columns {found} instead of {names}")
                continue
            # The digest reads every cell, so that a row of another length is met; a count alone parses none.
            out.rows[name] = fingerprint(df).first()["n_rows"]
            if table.pk and (dup := duplicate_keys(df, table.pk).limit(5).collect()):
                out.errors.append(f"{name}: duplicate keys, such as {[tuple(r)[:-1] for r in dup]}")
        except Exception as e:  # noqa: BLE001  one broken file must not hide the others
            out.errors.append(f"{name}: {str(e).splitlines()[0][:300]}")
    return out
