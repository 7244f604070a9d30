"""A directory from raw CSV files, with an inferred schema."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plainlake.operators.infer import Inferred, infer
from plainlake.sources import ddl, settings
from plainlake.sources.snapshot import Snapshot, read_csv, to_csv, typed
from plainlake.sources.validate import header


def init(spark: SparkSession, source: str | Path, to: str | Path | None = None, force: bool = False, detect_pk: bool = True, detect_fk: bool = True, tables: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[Inferred]:
    """Infers types, keys and foreign keys of the CSV files at `source` and writes the directory `to`."""
    p = Path(source)
    files = {f.name.removesuffix(".gz").removesuffix(".csv"): f for f in ([p] if p.is_file() else sorted([*p.glob("*.csv"), *p.glob("*.csv.gz")]))}
    given = settings.Settings(tables=list(tables), exclude=list(exclude))
    names = given.chosen(files)
    if not names:
        raise ValueError(f"no CSV files in {p}")
    texts = {t: read_csv(spark, files[t], header(files[t])) for t in names}
    found = infer(texts, detect_pk, detect_fk)
    schema = ddl.Schema()
    for t in found:
        schema.tables[t.table] = ddl.inferred_table(t.table, list(t.columns.items()), [t.pk] if t.pk else [], t.nullable, t.foreign)
    frames = {}
    for t in found:
        blank = texts[t.table].select(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in texts[t.table].columns])
        frames[t.table] = typed(blank, schema.tables[t.table])
    if any(not t.pk for t in found):
        given.order = "all-columns"
    to_csv(Snapshot(spark, schema, frames, given), to or p.with_suffix(".tables"), given, force)
    return found
