"""Every registered query of the library, by its stable id, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    query: Query
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _ENTRIES[name] = Entry(f, sql)
        return f

    return add


def _load() -> None:
    from starloom.plans import families  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {k: e.query for k, e in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: e.sql for k, e in _ENTRIES.items() if e.sql}
