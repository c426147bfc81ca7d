"""Settings: a YAML file with anchors and a !join tag, checked by classes."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from functools import lru_cache
from pathlib import Path


def load(path: str) -> dict:
    """The file's settings. !join [a, b] puts its parts together; 1e-12 without a point is a number too. Cached by path and time."""
    return _load(path, Path(path).stat().st_mtime_ns)


@lru_cache(maxsize=32)
def _load(path: str, _changed: int) -> dict:
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("!join", lambda loader, node: "".join(str(x) for x in loader.construct_sequence(node, deep=True)))
    Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^[-+]?\d+(\.\d*)?[eE][-+]?\d+$"), list("-+0123456789"))
    return yaml.load(Path(path).read_text(), Loader) or {}  # noqa: S506  a safe loader


#: What a point's fields may hold.
STATUSES, TIERS, GRADES = ("not_started", "in_progress", "implemented", "validated", "active", "disabled"), ("all", "very_high", "high", "medium", "low", "micro"), ("low", "medium", "high")


@dataclass(frozen=True)
class PointSettings:
    point: int
    group: int
    status: str = "implemented"
    tiers: tuple[str, ...] = ("all",)
    priority: int = 2
    least: int = 100
    complexity: str = "medium"

    def __post_init__(self):
        bad = [
            name
            for name, ok in (
                ("point", 1 <= self.point <= 100), ("group", 1 <= self.group <= 7), ("status", self.status in STATUSES), ("tiers", bool(self.tiers) and set(self.tiers) <= set(TIERS)),
                ("priority", 1 <= self.priority <= 5), ("least", self.least >= 0), ("complexity", self.complexity in GRADES),
            )
            if not ok
        ]
        if bad:
            raise ValueError(f"point {self.point}: {', '.join(bad)}")


def points(settings: dict) -> list[PointSettings]:
    """Checked points of a settings file; unknown fields are refused."""
    known = {f.name for f in fields(PointSettings)}
    out = []
    for p in settings.get("points", []):
        if extra := set(p) - known:
            raise ValueError(f"point {p.get('point')}: {', '.join(sorted(extra))}")
        out.append(PointSettings(**{k: tuple(v) if isinstance(v, list) else v for k, v in p.items()}))
    return out


def variants(settings: dict, flags: list[str]) -> dict[str, dict]:
    """The settings, and a copy for each flag (a dotted name) with it turned over; the file stays as it is."""
    import copy

    out = {"base": settings}
    for flag in flags:
        one = copy.deepcopy(settings)
        *way, last = flag.split(".")
        at = one
        for k in way:
            at = at[k]
        at[last] = not at[last]
        out[flag] = one
    return out


def inline_numbers(source: str, allowed: tuple[float, ...] = (0, 1, 2, -1)) -> list[tuple[int, float]]:
    """Numbers written in a Python source instead of being settings: line and value."""
    import ast

    return sorted((n.lineno, n.value) for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Constant) and type(n.value) in (int, float) and n.value not in allowed)


def project_paths(root: str, *parts: str, environ: dict[str, str] | None = None, variable: str = "BARLOOM_HOME") -> str:
    """A path under the folder that a variable names, else under `root`, with forward slashes on every system."""
    import os

    base = (os.environ if environ is None else environ).get(variable) or root
    return "/".join([base.replace("\\", "/").rstrip("/"), *(p.strip("/\\").replace("\\", "/") for p in parts)])


def shard_size(memory_gb: float, base: int = 64, least: int = 8, most: int = 256, safety: float = 0.7, per_shard_mb: float = 50.0) -> int:
    """Shards that fit the memory. On a cluster spark.sql.files.maxPartitionBytes and AQE do this."""
    return int(min(max(min(base, memory_gb * 1024 * safety / per_shard_mb), least), most))
