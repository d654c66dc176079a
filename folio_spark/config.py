"""Settings: defaults, overlaid by a mapping (a parsed file) and then by environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1500
    chunk_overlap: int = 200
    similarity: float = 0.92
    top_k: int = 50
    library: str = ""
    strict: bool = False


def _cast(kind, value):
    if kind is bool:
        if isinstance(value, str):
            low = value.strip().lower()
            if low not in ("1", "0", "true", "false", "yes", "no", "on", "off"):
                raise ValueError(f"not a truth value: {value!r}")
            return low in ("1", "true", "yes", "on")
        return bool(value)
    return kind(value)


def load(file: Mapping | None = None, env: Mapping[str, str] | None = None, prefix: str = "FOLIO_") -> Settings:
    """Unknown names in the file are an error; those in the environment are not ours."""
    kinds = {f.name: type(getattr(Settings(), f.name)) for f in fields(Settings)}
    unknown = set(file or {}) - set(kinds)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = replace(Settings(), **{k: _cast(kinds[k], v) for k, v in (file or {}).items()})
    found = os.environ if env is None else env
    return replace(out, **{k: _cast(kind, found[prefix + k.upper()]) for k, kind in kinds.items() if prefix + k.upper() in found})
