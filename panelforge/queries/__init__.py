"""The registered queries over the given tables, by category."""

from __future__ import annotations

import importlib

_CATEGORIES = ["relational", "windowed", "modeling", "evaluation", "io"]


def _modules():
    return [importlib.import_module(f"panelforge.queries.{name}") for name in _CATEGORIES]


def queries() -> dict:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for m in _modules() for name, q in m.SQL.items()}


def flagship(spark, sf_dir):
    from ..plans.season import flagship

    return flagship(spark, sf_dir)
