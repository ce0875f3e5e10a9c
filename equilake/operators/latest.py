"""Newest rows, point lookups and list filters.

``row_number() <= n`` lets Spark insert a partial group limit before the shuffle, so a key that
holds a third of all rows sends at most n rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each key in ``order`` (which should be total)."""
    name = rank or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key by ``order`` columns, largest first."""
    return top_n_per_key(df, keys, [F.desc_nulls_last(c) for c in order], 1)


def newest(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Newest-first list; plans as a distributed top-k, not a full sort."""
    return df.orderBy(*order).limit(n)


def filter_rows(df: DataFrame, *, since: tuple[str, object] | None = None, **equals) -> DataFrame:
    """Optional equality filters plus one optional ``column >= value``; None means no filter."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    if since is not None and since[1] is not None:
        df = df.filter(F.col(since[0]) >= F.lit(since[1]))
    return df


def select_fields(df: DataFrame, **fields: str | Column) -> DataFrame:
    """Compact projection: output name -> column, struct path or ``jsoncol:$.path``."""

    def resolve(spec: str | Column) -> Column:
        if isinstance(spec, Column):
            return spec
        if ":$" in spec:
            name, path = spec.split(":", 1)
            return F.get_json_object(name, path)
        return F.col(spec)

    return df.select(*[resolve(s).alias(n) for n, s in fields.items()])


class UnknownId(KeyError):
    """No row has the requested id."""


def get_by_id(df: DataFrame, key: str, value, required: bool = False) -> DataFrame:
    """Point lookup pushed to the scan. With ``required`` an unknown id is an error."""
    found = df.filter(F.col(key) == F.lit(value)).limit(1)
    if required and found.isEmpty():
        raise UnknownId(f"unknown {key}: {value}")
    return found


def sorted_symbols(df: DataFrame) -> DataFrame:
    """Distinct symbols in order, as rows: a range-partitioned sort, never one array."""
    return df.select("symbol").distinct().orderBy("symbol")
