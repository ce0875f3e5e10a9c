"""Named queries over a star-schema folder, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equilake.functions.scalars import r_dec
from equilake.sources import bridge
from equilake.warehouse import Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Bridge tables that most others are derived from.
BASE = ("px_walk", "fin")


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None, recursive: bool = False, share: tuple[str, ...] = ()):
    """Register ``fn(warehouse) -> DataFrame``; ``sql`` may refer to bridge tables as ``{name}``.

    ``share`` names bridge tables that the query reads along several paths.
    """

    def decorate(fn):
        def run(spark: SparkSession, root: str) -> DataFrame:
            return fn(Warehouse.from_star_schema(spark, root).share(*share))

        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = bridge.with_clause(sql, extra, recursive)
        return fn

    return decorate


def r6(c: Column | str, name: str | None = None) -> Column:
    out = r_dec(c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def r4(c: Column | str, name: str | None = None) -> Column:
    out = r_dec(c, 4)
    return out.alias(name or c) if name or isinstance(c, str) else out


def r2(c: Column | str, name: str | None = None) -> Column:
    out = r_dec(c, 2)
    return out.alias(name or c) if name or isinstance(c, str) else out


def s6(expr: str, name: str | None = None) -> str:
    """The same rounding as SQL text."""
    return f"floor(({expr}) * 1e6 + 0.50013) / 1e6" + (f" as {name}" if name else "")


def s4(expr: str, name: str | None = None) -> str:
    return f"floor(({expr}) * 1e4 + 0.50013) / 1e4" + (f" as {name}" if name else "")


def s2(expr: str, name: str | None = None) -> str:
    return f"floor(({expr}) * 100 + 0.50013) / 100" + (f" as {name}" if name else "")


def long(c: Column | str, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name)
