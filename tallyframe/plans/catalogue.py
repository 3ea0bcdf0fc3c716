"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

for _name in ("training", "listings", "evidence", "opinions", "profiles", "sampling", "metrics", "texts", "cleaning", "checks", "models", "features", "rollups", "matching", "more"):
    try:
        _m = importlib.import_module(f"{__package__}.{_name}")
    except ModuleNotFoundError as e:
        if not e.name or not e.name.endswith(_name):
            raise
        continue
    QUERIES.update(_m.QUERIES)
    ORACLE.update(getattr(_m, "ORACLE", {}))
