"""Registered queries: Spark callables over the given tables and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = [
    "sources", "clean", "quality", "split", "features", "decide", "evaluate", "incidents", "workbench",
    "drift", "models", "streaming",
]


def load():
    """Import every catalog module and return the registry."""
    for m in MODULES:
        importlib.import_module(f"flowlens.catalog.{m}")
    return importlib.import_module("flowlens.catalog.registry")
