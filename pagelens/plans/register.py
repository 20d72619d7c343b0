"""How a module of queries collects them with their SQL."""

from __future__ import annotations


def registrar():
    """A decorator that puts a query and its SQL into the two dictionaries returned with it."""
    queries, sql = {}, {}

    def query(text: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return put

    return query, queries, sql
