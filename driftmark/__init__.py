"""Compare versions of data sets record by record on Spark."""

from __future__ import annotations

import importlib
from typing import Any

__version__ = "0.1.0"

#: Public names and where they are; loaded on first use, so that workers import no more than they run.
_PUBLIC = {
    "CanonicalPolicy": "functions.canonical", "canonicalize": "functions.canonical", "canonical_json": "functions.canonical",
    "DatasetDiff": "operators.compare", "compare": "operators.compare", "Match": "operators.matching",
    "Snapshot": "operators.snapshot", "build_snapshot": "operators.snapshot", "read_entries": "sources.readers", "read_rows": "sources.readers",
}
__all__ = [*_PUBLIC, "__version__"]


def __getattr__(name: str) -> Any:
    if name in _PUBLIC:
        return getattr(importlib.import_module(f".{_PUBLIC[name]}", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
