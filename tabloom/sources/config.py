"""Settings of an export or a generation run, from a flat YAML file and from arguments."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

#: What must be given; numbers and their defaults.
REQUIRED = ("host", "port", "dbname", "user", "password", "schema_path", "stat_path", "index_file", "constraint_file")
EXPORT_KEYS = ("dbname", "username", "host", "port", "schema-file", "query", "query-file", "explainfile", "explainfile-analyze", "stats-file", "constr-file", "index-file", "no-checks", "no-exts")


@dataclass(frozen=True)
class Settings:
    host: str | None = None
    port: str | None = None
    dbname: str | None = None
    user: str | None = None
    password: str | None = None
    schema_path: str | None = None
    stat_path: str | None = None
    index_file: str | None = None
    constraint_file: str | None = None
    batch_size: int = 10_000
    generation_threads: int = 4
    table_threads: int = 1
    store_threads: int = 1


def flat_yaml(text: str) -> dict[str, str]:
    """key: value lines; quotes around values and comments go, nested content is not read."""
    out = {}
    for line in text.splitlines():
        if line[:1].isspace() or line.lstrip().startswith("#") or ":" not in line:
            continue
        key, _, value = line.partition(":")
        value = value.split(" #", 1)[0].strip()
        out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def merged(arguments: dict, file: str | None = None) -> Settings:
    """Arguments win over the file, which wins over defaults, for every key alike. Missing required keys are an error."""
    found = {k.replace("-", "_"): v for k, v in (flat_yaml(Path(file).read_text()) if file else {}).items()}
    found |= {k: v for k, v in arguments.items() if v is not None}
    known = {f.name: f for f in fields(Settings)}
    own = {k: int(v) if isinstance(known[k].default, int) else str(v) for k, v in found.items() if k in known}
    settings = Settings(**own)
    if missing := [k for k in REQUIRED if not getattr(settings, k)]:
        raise ValueError(f"missing: {', '.join(missing)}")
    return settings


def export_settings(file: str) -> dict[str, str]:
    """Keys of an export; query and query-file exclude each other, unknown keys are an error."""
    found = flat_yaml(Path(file).read_text())
    if unknown := set(found) - set(EXPORT_KEYS):
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    if "query" in found and "query-file" in found:
        raise ValueError("either query or query-file")
    return found


def query_text(found: dict[str, str]) -> str | None:
    return found.get("query") or (Path(found["query-file"]).read_text() if "query-file" in found else None)
