"""Run manifests, template values and templates."""

from __future__ import annotations

import json
import re
import subprocess
from datetime import date, datetime, timezone
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

TRACKED = ("pyspark", "pandas", "numpy", "pyarrow")


def git_sha(folder: str = ".") -> str:
    """Commit of a folder, "unknown" where there is none. [SK5]"""
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def package_versions(names: tuple[str, ...] = TRACKED) -> dict[str, str]:
    """[SK6]"""
    out = {}
    for n in names:
        try:
            out[n] = version(n)
        except PackageNotFoundError:
            out[n] = "absent"
    return out


def resolve_as_of(as_of: str | None, allow_live_end: bool) -> date | None:
    """The end date of a run: given, or live where that is allowed; both or neither is refused. [C11]"""
    if (as_of is None) == (not allow_live_end):
        raise ValueError("give either as_of or allow_live_end")
    return date.fromisoformat(as_of) if as_of else None


def write_manifest(path: str, payload: dict, as_of: date | None) -> dict:
    """JSON with _meta (git_sha, as_of, live_end, written_at_utc, package_versions) and the payload. [SK4]"""
    meta = {
        "git_sha": git_sha(),
        "as_of": as_of.isoformat() if as_of else None,
        "live_end": as_of is None,
        "written_at_utc": datetime.now(timezone.utc).isoformat(),
        "package_versions": package_versions(),
    }
    out = {"_meta": meta, **payload}
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True), encoding="utf-8")
    return out


def fill_template(text: str, values: dict[str, object], missing: str = "[missing: {}]") -> str:
    """Replaces {{key}}; keys without a value are marked. [SK8]"""
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(values[m[1]]) if m[1] in values else missing.format(m[1]), text)
