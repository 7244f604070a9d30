"""The settings file of a directory, and which of its settings, the caller's and the defaults hold."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from plainlake.functions.canon import NULL_ALIASES, NULL_MODES

FILE, VERSION = "plainlake.toml", "1"
ORDERS = ("pk", "all-columns", "add-synthetic-key")


@dataclass
class Settings:
    order: str = "pk"
    null_mode: str = "marker"
    natural_sort: bool = False
    order_by: str | None = None
    compressed: bool = False
    tables: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    table_checksums: dict[str, str] = field(default_factory=dict)
    format_version: str = VERSION
    created_by: str | None = None

    def __post_init__(self):
        self.null_mode = NULL_ALIASES.get(self.null_mode, self.null_mode)
        if self.null_mode not in NULL_MODES:
            raise ValueError(f"unknown null mode {self.null_mode!r}")
        if self.order not in ORDERS:
            raise ValueError(f"unknown order {self.order!r}")
        if self.tables and self.exclude:
            raise ValueError("tables and exclude can't be given together")

    def chosen(self, names) -> list[str]:
        """Include list (empty: all) without the excluded."""
        return [n for n in names if (not self.tables or n in self.tables) and n not in self.exclude]

    def text(self) -> str:
        x = {k: v for k, v in asdict(self).items() if v not in (None, [], {}, False)}
        if self.order_by:
            x.pop("order")
        sums = x.pop("table_checksums", {})
        lines = [f"{k} = {json.dumps(v)}" for k, v in sorted(x.items())]
        return "\n".join(lines + (["", "[table_checksums]", *(f"{json.dumps(k)} = {json.dumps(v)}" for k, v in sorted(sums.items()))] if sums else [])) + "\n"


def load(directory: Path) -> Settings | None:
    """The settings of a directory: its only .toml file, by whatever name."""
    files = sorted(Path(directory).glob("*.toml"))
    if not files:
        return None
    raw = tomllib.loads((directory / FILE if directory / FILE in files else files[0]).read_text())
    if raw.get("format_version") != VERSION:
        raise ValueError(f"unsupported format version {raw.get('format_version')!r}")
    return Settings(**{k: v for k, v in raw.items() if k in Settings.__dataclass_fields__})


def resolve(directory: Path | None, **given) -> Settings:
    """What the caller gives, else what the directory's file says, else the defaults; a clause of order_by beats an order
    from the file, and natural sort means key order."""
    found = load(directory) if directory and Path(directory).is_dir() else None
    given = {k: v for k, v in given.items() if v not in (None, [], False)}
    base = {} if found is None else {k: v for k, v in asdict(found).items() if k not in ("table_checksums", "created_by")}
    if "order" in given:
        base.pop("order_by", None)
    if "tables" in given:
        base.pop("exclude", None)
    if "exclude" in given:
        base.pop("tables", None)
    out = Settings(**base | given)
    if out.natural_sort:
        out.order = "pk"
    return out
