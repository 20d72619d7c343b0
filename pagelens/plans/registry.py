"""All queries of the library, by key, with their SQL."""

from __future__ import annotations

from . import catalogue


def queries():
    return {k: q for m in catalogue.MODULES for k, q in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in catalogue.MODULES for k, s in m.ORACLE_SQL.items()}
