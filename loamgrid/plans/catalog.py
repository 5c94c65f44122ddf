"""The registered queries and their SQL, by name."""

from __future__ import annotations

import importlib

PARTS = ("relational", "grids", "spatial", "texts", "composites", "statistics", "published")


def _all(what: str) -> dict:
    out: dict = {}
    for part in PARTS:
        out |= getattr(importlib.import_module(f"loamgrid.plans.{part}"), what)
    return out


def queries() -> dict:
    return _all("Q")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
