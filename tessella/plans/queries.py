"""All queries over the reference operators."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

for _module in ("scans", "projections", "selections", "aligning"):
    importlib.import_module(f"{__package__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
