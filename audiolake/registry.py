"""Queries by name and the SQL that states the same results."""

from __future__ import annotations

import re

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r"(?<!')\bshow\b(?!')", '"show"', sql)  # a reserved word there
        return f

    return add


# Parts of SQL texts.


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^0-9a-z]+', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_filter(string_split({norm(c)}, ' '), lambda x: x <> '')"


def hex_number(c: str, start: int, n: int) -> str:
    return f"CAST('0x' || substr({c}, {start}, {n}) AS BIGINT)"
