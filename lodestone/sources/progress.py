"""Progress of a run, and saved journal offsets, as small JSON files that are replaced whole."""

from __future__ import annotations

import json
import os
import time

#: The keys of a run's progress.
DEFAULTS = {"phase": "idle", "dirs_visited": 0, "files_checked": 0, "files_new": 0, "files_queued": 0, "files_processed": 0, "files_errors": 0, "current_file": "", "started_at": None, "updated_at": None, "db_total": 0, "db_indexed": 0, "db_pending": 0, "db_errors": 0, "db_chunks": 0}


def _replace(path: str, values: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.next", "w", encoding="utf-8") as f:
        json.dump(values, f)
    os.replace(f"{path}.next", path)


def read(path: str) -> dict:
    """The values, with defaults for those that are missing; defaults alone where the file can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            return DEFAULTS | json.load(f)
    except (OSError, ValueError, TypeError):
        return dict(DEFAULTS)


def write(path: str, **values) -> dict:
    """The values over those that are there, stamped with the time; keys of one's own stay as well."""
    now = read(path) | values | {"updated_at": time.time()}
    _replace(path, now)
    return now


def write_stats(path: str, stats: dict) -> dict:
    """The catalog's counts beside a run's."""
    return write(path, **{"db_" + ("chunks" if k == "total_chunks" else k): v for k, v in stats.items() if k in ("total", "indexed", "errors", "pending", "total_chunks")})


def clear(path: str) -> dict:
    """The defaults over all that they name."""
    return write(path, **DEFAULTS)


def save_offsets(path: str, volume: str, state: dict) -> None:
    """A volume's journal state beside the others'."""
    _replace(path, load_offsets(path) | {volume: state})


def load_offsets(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        return got if isinstance(got, dict) else {}
    except (OSError, ValueError):
        return {}
