"""Configuration of a store: precedence of settings, and whether a topology of journals is sound."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

from claimloom.operators.journal import Refused

DEFAULTS = {"prefilter": 0.60, "cluster": 0.65, "pair_budget": 4096, "workers": 4, "min_score_ppm": 700_000, "min_recall_ppm": 600_000}
ROLES, MODES = ("primary", "replica"), ("follow", "fork")


def load(path: str) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else {}


def save(path: str, settings: dict) -> None:
    """Plain tables of scalars, written beside the target and renamed over it."""
    lines, tables = [], []
    for k, v in settings.items():
        (tables if isinstance(v, dict) else lines).append((k, v))
    show = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
    text = "".join(f"{k} = {show(v)}\n" for k, v in lines)
    text += "".join(f"\n[{k}]\n" + "".join(f"{a} = {show(b)}\n" for a, b in v.items()) for k, v in tables)
    part = Path(f"{path}.part")
    part.write_text(text, encoding="utf-8")
    part.replace(path)


def resolve(name: str, explicit: dict | None = None, configured: dict | None = None, prefix: str = "CLAIMLOOM_"):
    """A setting's value: given explicitly, else by environment, else configured, else the default."""
    if explicit and explicit.get(name) is not None:
        return explicit[name]
    if (value := os.environ.get(prefix + name.upper())) is not None:
        kind = type(DEFAULTS.get(name, ""))
        return kind(value)
    if configured and configured.get(name) is not None:
        return configured[name]
    return DEFAULTS.get(name)


def check_topology(journals: list[dict]) -> None:
    """Journals (name, role, path[, mode, source]): one primary, paths of their own, replicas that lead to it without a cycle."""
    by = {j["name"]: j for j in journals}
    primaries = [j for j in journals if j["role"] == "primary"]
    if len(by) != len(journals) or len({j["path"] for j in journals}) != len(journals):
        raise Refused("topology", "names and paths must differ")
    if len(primaries) != 1 or primaries[0].get("source"):
        raise Refused("topology", "there is exactly one primary, and it has no source")
    for j in journals:
        if j["role"] not in ROLES:
            raise Refused("topology", f"unknown role {j['role']}")
        if j["role"] == "replica" and (j.get("mode") not in MODES or j.get("source") not in by):
            raise Refused("topology", f"{j['name']} needs a mode and a known source")
        seen, now = set(), j
        while now.get("source"):
            if now["name"] in seen:
                raise Refused("topology", f"{j['name']} is its own source")
            seen.add(now["name"])
            now = by[now["source"]]


def store_paths(root: str, paths: list[str]) -> list[str]:
    """Relative paths inside ``root``, at most 64; anything else is refused."""
    if len(paths) > 64:
        raise Refused("paths", "at most 64 paths")
    for p in paths:
        if p.startswith("/") or ".." in p.split("/") or "\\" in p or not p:
            raise Refused("paths", f"{p!r} is not a relative path")
    return [f"{root}/{p}" for p in paths]
