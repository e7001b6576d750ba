"""All registered queries of the date engine, and their SQL."""

from __future__ import annotations

from . import catalog_dates, catalog_eval, catalog_extract, catalog_harvest, catalog_resolve  # noqa: F401  they register themselves
from .registry import QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
