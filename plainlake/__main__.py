"""python -m plainlake COMMAND …; exit status 1: differences, conflicts or errors were found."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from pathlib import Path

from plainlake import api
from plainlake.plans import show
from plainlake.session import session
from plainlake.sources import hooks
from plainlake.streaming.watch import watch

SUFFIX = {"to-csv": ".tables", "to-parquet": ".parquetdir", "to-sqlite": ".sqlite", "to-duckdb": ".duckdb"}


def _list(x: str) -> list[str]:
    return [p for p in x.split(",") if p]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plainlake")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str, choose: bool = True):
        p = sub.add_parser(name)
        for x in paths:
            p.add_argument(x)
        if choose:
            g = p.add_mutually_exclusive_group()
            g.add_argument("--tables", type=_list, default=[])
            g.add_argument("--exclude", type=_list, default=[])
        return p

    for name in SUFFIX:
        p = command(name, "input")
        p.add_argument("-o", "--output")
        p.add_argument("--force", action="store_true")
        p.add_argument("--pipe", action="store_true")
        if name in ("to-csv", "to-parquet"):
            g = p.add_mutually_exclusive_group()
            g.add_argument("--order", choices=["pk", "all-columns", "add-synthetic-key"])
            g.add_argument("--order-by")
            p.add_argument("--natural-sort", action="store_true")
        if name == "to-csv":
            p.add_argument("--null-mode")
            p.add_argument("--compress", action="store_true")
            p.add_argument("--incremental", action="store_true")
    p = command("init", "source")
    p.add_argument("-o", "--output")
    p.add_argument("--force", action="store_true")
    p.add_argument("--no-pk-detection", action="store_true")
    p.add_argument("--no-fk-detection", action="store_true")
    command("validate", "path", choose=False)
    p = command("diff", "left", "right")
    p.add_argument("--json", action="store_true")
    p = command("merge", "base", "left", "right", choose=False)
    p.add_argument("-o", "--output")
    p.add_argument("--strategy", choices=["normal", "ours", "theirs"], default="normal")
    p.add_argument("--force", action="store_true")
    command("checksum", "path")
    p = command("sql", "query", "path", choose=False)
    p.add_argument("--format", choices=["csv", "table"])
    p = command("watch", "path", choose=False)
    p.add_argument("--target", choices=["sqlite", "duckdb", "parquet"], default="sqlite")
    p.add_argument("-o", "--output")
    p.add_argument("--debounce", type=int, default=500)
    p = sub.add_parser("hooks")
    p.add_argument("action", choices=["install", "uninstall"])
    p.add_argument("--force", action="store_true")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "hooks":
        print(*(hooks.install(force=a.force) if a.action == "install" else hooks.uninstall()))
        return 0
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    if a.command in SUFFIX:
        out = Path(tempfile.mkdtemp(prefix="plainlake-"), "out" + SUFFIX[a.command]) if a.pipe else Path(a.output or Path(a.input.rstrip("/")).with_suffix(SUFFIX[a.command]))
        filters = {"tables": a.tables, "exclude": a.exclude}
        if a.command in ("to-csv", "to-parquet"):
            given = filters | {"order": a.order, "order_by": a.order_by, "natural_sort": a.natural_sort}
            if a.command == "to-csv":
                done = api.to_csv(a.input, out, spark, a.force, a.incremental, null_mode=a.null_mode, compressed=a.compress, **given)
                if a.incremental:
                    print(json.dumps(done), file=sys.stderr)
            else:
                api.to_parquet(a.input, out, spark, a.force, **given)
        else:
            from plainlake.sources import snapshot

            (snapshot.to_sqlite if a.command == "to-sqlite" else snapshot.to_duckdb)(snapshot.load(spark, a.input, **filters), out, a.force)
        print(out)
    elif a.command == "init":
        for t in api.init(spark, a.source, a.output, a.force, not a.no_pk_detection, not a.no_fk_detection, a.tables, a.exclude):
            print(f"{t.table}: {t.n_rows} rows, key {t.pk or 'none'}, {', '.join(f'{c} {k}' for c, k in t.columns.items())}")
    elif a.command == "validate":
        r = api.validate(spark, a.path)
        for x in r.errors:
            print(f"error: {x}")
        for x in r.warnings:
            print(f"warning: {x}")
        return int(not r.ok)
    elif a.command == "diff":
        any_row, out = False, sys.stdout
        for k, (t, df) in enumerate(api.diff(a.left, a.right, spark, a.tables, a.exclude).items()):
            out.write((f"{', ' if k else '{'}{json.dumps(t)}: [") if a.json else "")
            for i, r in enumerate(df.toLocalIterator()):  # rows are written as they come
                any_row, x = True, r.asDict(recursive=True)
                out.write((", " if i else "") + json.dumps(x, default=str, sort_keys=True) if a.json else " ".join([t, *(f"{n}={v}" for n, v in x.items())]) + "\n")
            out.write("]" if a.json else "")
        out.write("}\n" if a.json else "")
        return int(any_row)
    elif a.command == "merge":
        rows, conflicts = api.merge(a.base, a.left, a.right, a.output, a.strategy, spark, a.force)
        for t, df in rows.items():
            for r in df.filter("conflict").toLocalIterator():
                conflicts[f"{t} {[v for k, v in r.asDict().items() if k not in ('class', 'conflict', 'columns', 'result', 'stays')]}"] = r["class"]
        for k, v in conflicts.items():
            print(f"conflict: {k}: {v}")
        return int(bool(conflicts))
    elif a.command == "checksum":
        print(api.checksum(a.path, spark, a.tables, a.exclude))
    elif a.command == "sql":
        df = api.sql(a.query, a.path, spark)
        if (a.format or ("table" if sys.stdout.isatty() else "csv")) == "table":
            sys.stdout.write(show.to_table(df))
        else:
            show.write_csv(df, sys.stdout)
    elif a.command == "watch":
        to = Path(a.output or Path(a.path.rstrip("/")).with_suffix("." + a.target))
        build = {"sqlite": api.to_sqlite, "duckdb": api.to_duckdb, "parquet": api.to_parquet}[a.target]
        watch(a.path, lambda: build(a.path, to, spark, force=True), a.debounce / 1000)
    return 0


if __name__ == "__main__":
    sys.exit(main())
