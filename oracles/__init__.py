"""ANSI SQL counterparts of the registered queries, written independently of the DataFrame code."""

from __future__ import annotations

import importlib
import pkgutil

from .base import with_base


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in pkgutil.iter_modules(__path__):
        if module.name != "base":
            loaded = importlib.import_module(f"{__name__}.{module.name}")
            extra = getattr(loaded, "TABLES", None)
            found |= {name: with_base(text, extra) for name, text in loaded.SQL.items()}
    return found
