"""schema.sql: parsing, generation, and the orders that dependencies ask for."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter


@dataclass
class Column:
    name: str
    kind: str
    notnull: bool = False
    default: str | None = None


@dataclass
class Table:
    name: str
    columns: list[Column]
    pk: list[str] = field(default_factory=list)
    sql: str | None = None
    indexes: list[str] = field(default_factory=list)

    def ddl(self) -> str:
        return self.sql or create_table(self)


@dataclass
class Schema:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)

    def text(self) -> str:
        """Tables in the order of their foreign keys, each with its indexes, then views in the order of their use."""
        out = []
        for t in table_order({n: t.ddl() for n, t in self.tables.items()}):
            out += [self.tables[t].ddl(), *self.tables[t].indexes]
        out += [self.views[v] for v in view_order(self.views)]
        return "".join(f"{s.strip().rstrip(';')};\n" for s in out)


class SchemaError(ValueError):
    pass


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def create_table(t: Table) -> str:
    single = len(t.pk) == 1
    lines = [f"  {quoted(c.name)} {c.kind}" + " PRIMARY KEY" * (single and c.name == t.pk[0]) + " NOT NULL" * c.notnull + (f" DEFAULT {c.default}" if c.default is not None else "") for c in t.columns]
    if len(t.pk) > 1:
        lines.append(f"  PRIMARY KEY ({', '.join(map(quoted, t.pk))})")
    return f"CREATE TABLE {quoted(t.name)} (\n" + ",\n".join(lines) + "\n)"


def statements(text: str) -> list[str]:
    """The statements of a script; semicolons in literals, names and comments don't end one."""
    out, now = [], ""
    for part in re.split(r"(;)", text):
        now += part
        if part == ";" and sqlite3.complete_statement(now):
            out.append(now.strip().rstrip(";"))
            now = ""
    return [s for s in [*out, now.strip()] if s]


def parse(text: str) -> Schema:
    """Executes the script in an empty in-memory database and reads its catalogue."""
    con = sqlite3.connect(":memory:")
    con.execute("PRAGMA foreign_keys = OFF")
    pending, error = statements(text), None
    while pending:  # views may come before what they read
        later = []
        for s in pending:
            try:
                con.execute(s)
            except sqlite3.Error as e:
                error = SchemaError(f"{e}: {s[:80]}")
                later.append(s)
        if len(later) == len(pending):
            raise error
        pending = later
    return from_connection(con)


def from_connection(con: sqlite3.Connection) -> Schema:
    out = Schema()
    for name, sql in con.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name"):
        info = con.execute(f"PRAGMA table_info({quoted(name)})").fetchall()
        keys = sorted((r[5], r[1]) for r in info if r[5])
        out.tables[name] = Table(name, [Column(r[1], r[2] or "TEXT", bool(r[3]), r[4]) for r in info], [k for _, k in keys], sql)
    for table, sql in con.execute("SELECT tbl_name, sql FROM sqlite_master WHERE type = 'index' AND sql IS NOT NULL ORDER BY name"):
        out.tables[table].indexes.append(sql)
    for name, sql in con.execute("SELECT name, sql FROM sqlite_master WHERE type = 'view' ORDER BY name"):
        out.views[name] = sql
    return out


def _sorted(uses: Mapping[str, Iterable[str]], what: str, strict: bool) -> list[str]:
    sorter = TopologicalSorter()
    for name in sorted(uses):
        sorter.add(name, *sorted(uses[name]))
    try:
        sorter.prepare()
    except CycleError as e:
        if strict:
            raise SchemaError(f"{what} depend on each other: {' -> '.join(e.args[1])}") from e
        return sorted(uses)
    out = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out


def references(sql: str) -> set[str]:
    return {a or b for a, b in re.findall(r'\bREFERENCES\s+(?:"([^"]+)"|(\w+))', sql, re.I)}


def table_order(ddl: Mapping[str, str], strict: bool = True) -> list[str]:
    """Tables after those that their foreign keys name; equals by name. A cycle is an error unless `strict` is off."""
    return _sorted({t: {r for r in references(s) if r in ddl and r != t} for t, s in ddl.items()}, "tables", strict)


def view_order(views: Mapping[str, str]) -> list[str]:
    """Views after those that they read."""
    words = {v: set(re.findall(r"\w+", re.sub(r"'[^']*'", " ", s))) for v, s in views.items()}
    return _sorted({v: {w for w in words[v] if w in views and w != v} for v in views}, "views", True)


def view_query(sql: str) -> str:
    """The SELECT of a CREATE VIEW statement."""
    return re.sub(r"^\s*CREATE\s+(?:TEMP(?:ORARY)?\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:\"[^\"]+\"|\S+)\s*(?:\([^)]*\)\s*)?AS\s+", "", sql, flags=re.I | re.S)


def inferred_table(name: str, columns: Sequence[tuple[str, str]], pk: Sequence[str], nullable: Mapping[str, bool], foreign: Sequence[tuple[str, str, str]] = ()) -> Table:
    t = Table(name, [Column(c, k, not nullable.get(c, True) and c not in pk) for c, k in columns], list(pk))
    sql = create_table(t)
    if foreign:
        sql = sql[: -len("\n)")] + "".join(f",\n  FOREIGN KEY ({quoted(c)}) REFERENCES {quoted(r)}({quoted(k)})" for c, r, k in foreign) + "\n)"
    t.sql = sql
    return t
