"""Overrides of detector configurations, as an operator would store them by feature."""

from __future__ import annotations

import dataclasses
import math
from typing import Any, TypeVar

Config = TypeVar("Config")

#: Fields that are shares, and so at most 1; all numbers are at least 0.
SHARES = {"max_directness", "min_revisit", "min_coherence", "status_share", "swing_directness"}


def overridden(cfg: Config, values: dict[str, Any]) -> Config:
    """The configuration with some fields replaced: unknown names and non-numbers are refused, numbers are kept in their range."""
    fields = {f.name: getattr(cfg, f.name) for f in dataclasses.fields(cfg)}  # type: ignore[arg-type]
    unknown = set(values) - set(fields)
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    new: dict[str, Any] = {}
    for name, value in values.items():
        if value is None:
            new[name] = None
            continue
        if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
            raise ValueError(f"{name} is no number")
        kept = min(max(value, 0), 1) if name in SHARES else max(value, 0)
        new[name] = int(kept) if isinstance(fields[name], int) and not isinstance(fields[name], bool) else float(kept)
    return dataclasses.replace(cfg, **new)  # type: ignore[type-var]
