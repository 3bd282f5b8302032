"""Registry of named queries and of the SQL each is checked against."""

from __future__ import annotations

import textwrap
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables and derived views of one data folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        build = views.SPARK.get(name)
        df = build(self) if build else self.spark.read.parquet(self.path(name))
        self.__dict__[name] = df
        return df


def compose(text: str, needed: tuple[str, ...]) -> str:
    """Put the SQL of the derived views in front of a statement."""
    text = textwrap.dedent(text).strip()
    chain: list[str] = []

    def add(name):
        for parent in views.PARENTS.get(name, ()):
            add(parent)
        if name not in chain:
            chain.append(name)

    for n in needed:
        add(n)
    parts = [f"{n} AS ({views.SQL[n]})" for n in chain]
    if not parts:
        return text
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(start):
            return start + ",\n".join(parts) + ",\n" + text[len(start):]
    return "WITH " + ",\n".join(parts) + "\n" + text


def query(key: str, sql: str | None = None, uses: tuple[str, ...] | str = ()):
    """Register fn(t: Tables) -> DataFrame under a key, with its SQL where there is one."""
    needed = (uses,) if isinstance(uses, str) else tuple(uses)

    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        QUERIES[key].__doc__ = fn.__doc__
        if sql:
            SQL[key] = compose(sql, needed)
        return fn

    return wrap
