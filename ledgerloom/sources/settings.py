"""Settings of a run: a JSON file, overridden by environment variables; the commit of a checkout."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

PREFIX = "LEDGERLOOM_"
UNKNOWN_COMMIT = "unknown"


def load(path: str | None, environment: Mapping[str, str], prefix: str = PREFIX) -> dict[str, str]:
    """Settings by dotted names in lower case. ``PREFIX_A__B`` overrides ``a.b``; a missing file has no settings."""
    out: dict[str, str] = {}

    def walk(value, name: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{name}.{k}" if name else k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{name}.{i}")
        elif value is not None:
            out[name.lower()] = json.dumps(value) if isinstance(value, bool) else str(value)

    if path and Path(path).exists():
        walk(json.loads(Path(path).read_text(encoding="utf-8-sig")), "")
    for k, v in environment.items():
        if k.upper().startswith(prefix):
            out[k[len(prefix) :].replace("__", ".").lower()] = v
    return out


def commit_of(folder: str) -> str:
    """The commit that a checkout is at, read from its ``.git`` folder; ``unknown`` where that fails."""
    for place in [Path(folder).resolve(), *Path(folder).resolve().parents]:
        git = place / ".git"
        if git.is_dir():
            try:
                head = (git / "HEAD").read_text().strip()
                if not head.startswith("ref: "):
                    return head or UNKNOWN_COMMIT
                ref = head[5:]
                if (git / ref).exists():
                    return (git / ref).read_text().strip() or UNKNOWN_COMMIT
                packed = (git / "packed-refs").read_text().splitlines()
                return next((x.split()[0] for x in packed if x.endswith(" " + ref)), UNKNOWN_COMMIT)
            except OSError:
                return UNKNOWN_COMMIT
    return UNKNOWN_COMMIT
