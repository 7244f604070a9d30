"""Git hooks: validate before a commit, rebuild after a merge."""

from __future__ import annotations

import stat
from pathlib import Path

MARK = "# plainlake hook"
SCRIPTS = {
    "pre-commit": 'for d in $(git diff --cached --name-only --diff-filter=ACM | grep "/schema.sql$" | xargs -r -n1 dirname | sort -u); do\n  python -m plainlake validate "$d" || exit 1\ndone\n',
    "post-merge": 'for d in $(git diff --name-only HEAD@{1} HEAD | grep -E "[.](csv|csv[.]gz|sql)$" | xargs -r -n1 dirname | sort -u); do\n  [ -f "$d/schema.sql" ] && python -m plainlake to-sqlite "$d" --force\ndone\nexit 0\n',
}


def _folder(start: str | Path) -> Path:
    """The hooks of the repository that holds `start`; a worktree has a file that names its git folder."""
    here = Path(start).resolve()
    for p in (here, *here.parents):
        git = p / ".git"
        if git.is_file() and git.read_text().startswith("gitdir:"):
            git = p / git.read_text().partition(":")[2].strip()
        if git.is_dir():
            (git / "hooks").mkdir(exist_ok=True)
            return git / "hooks"
    raise ValueError(f"{start} is in no git repository")


def install(repo: str | Path = ".", force: bool = False) -> list[str]:
    """Writes the hooks and gives their names; a hook of another origin is left out unless `force`."""
    out = []
    for name, body in SCRIPTS.items():
        f = _folder(repo) / name
        if f.exists() and MARK not in f.read_text() and not force:
            continue
        f.write_text(f"#!/bin/sh\n{MARK}\n{body}")
        f.chmod(f.stat().st_mode | stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH)
        out.append(name)
    return out


def uninstall(repo: str | Path = ".") -> list[str]:
    out = []
    for name in SCRIPTS:
        f = _folder(repo) / name
        if f.exists() and MARK in f.read_text():
            f.unlink()
            out.append(name)
    return out
