"""Registry of runnable queries: name -> (Spark callable, checking SQL, inventory ids)."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]
    run: QueryFn
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register `fn(spark, sf_dir) -> DataFrame` under `name`."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in _ENTRIES:
            raise ValueError(f"duplicate query {name}")
        _ENTRIES[name] = Entry(name, tuple(c.strip() for c in covers.split(",")), fn, sql)
        return fn

    return wrap


def entries() -> dict[str, Entry]:
    from . import load_all

    load_all()
    return dict(_ENTRIES)
