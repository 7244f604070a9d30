"""Rebuilds a target when a directory changes."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from pathlib import Path


def state(path: Path) -> dict[str, tuple[int, int]]:
    """Size and time of the files that matter: data, schema and settings."""
    files = [path] if path.is_file() else [f for f in path.iterdir() if f.suffix in (".csv", ".gz", ".parquet", ".sql", ".toml")]
    return {f.name: ((s := f.stat()).st_size, s.st_mtime_ns) for f in sorted(files)}


def watch(path: str | Path, build: Callable[[], None], debounce: float = 0.5, poll: float = 0.2, stop: Callable[[], bool] = lambda: False) -> int:
    """Builds once, then after each change that has been quiet for `debounce` seconds; an error of a build is reported and
    the watch goes on. Returns the number of builds that succeeded."""
    p, done = Path(path), 0

    def once() -> int:
        try:
            build()
            return 1
        except Exception as e:  # noqa: BLE001  the next change may mend it
            print(f"build failed: {e}", file=sys.stderr)
            return 0

    built = state(p)
    done += once()
    seen, since = built, time.monotonic()
    while not stop():
        time.sleep(poll)
        now = state(p)
        if now != seen:
            seen, since = now, time.monotonic()
        elif now != built and time.monotonic() - since >= debounce:
            built = now
            done += once()
    return done
