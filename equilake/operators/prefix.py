"""Prefix scans per key that split a key over tasks: places, running sums, and linear recurrences.

A window over a key sorts the whole key in one task. Here a range shuffle on (key, order) numbers the rows of a key wherever they lie, and the scans
work on blocks of consecutive places: inside each block, then over the blocks' totals, so half of all rows may share a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from equilake.session import store

SUM_BITS = 12
MAP_BITS = 5
HASH_BITS = 17


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, int]:
    """df with ``place`` (0, 1, ... by ``order`` within ``keys``, nulls first), and the most rows of a key.

    The sorted table is written once, so places never change. A row's place is its place in its partition plus the counts of the key in
    earlier partitions. Keys must not be null.
    """
    keys = list(keys)
    rows = store(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    # A row for each key and partition that the key is in.
    parts = parts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n"))
    most = parts.agg(F.max(F.col("_before") + F.col("_n"))).first()[0] or 0
    placed = rows.join(parts.drop("_n"), [*keys, "_part"])
    return placed.withColumn("place", F.col("_before") + F.col("_at") - F.col("_low")).drop("_at", "_part", "_low", "_before"), most


def rows_of_a_key(df: DataFrame, keys: Sequence[str]) -> int:
    """The most rows of a key, or a bound of them that is no more than a window holds.

    Counts by ``2 ** HASH_BITS`` values of the keys' hash are bounds and small; only if one of them is too large are the keys counted.
    """
    counted = df.select(*keys).groupBy(F.pmod(F.xxhash64(*keys), F.lit(1 << HASH_BITS)).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    most = counted.agg(F.max("_n")).first()[0] or 0
    if most > 1 << SUM_BITS:
        most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return most


def numbered_in_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, int]:
    """``numbered`` for keys that are mostly small: without a key of more than ``2 ** SUM_BITS`` rows the rows are shuffled once, by key, and the scans that follow keep to it (also by ``_block``, which the caller drops)."""
    most = rows_of_a_key(df, keys)
    if most > 1 << SUM_BITS:
        return numbered(df, keys, order)
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1)
    return placed.withColumn("_block", _block(MAP_BITS)), most


def _block(bits: int) -> Column:
    return F.shiftright("place", bits)


def in_key(rows: DataFrame, keys: Sequence[str]) -> WindowSpec:
    """The rows of a key by place. With the blocks of ``numbered_in_windows`` first, the order in which their maps are composed: all scans share one sort then."""
    return Window.partitionBy(*keys).orderBy(*["_block"] * ("_block" in rows.columns), "place")


def sum_scan(rows: DataFrame, keys: Sequence[str], most: int, sums: dict[str, str | Column]) -> DataFrame:
    """Adds running sums by place within keys, each row included; ``sums``: new column -> summed column (never null)."""
    keys = list(keys)
    if most <= 1 << SUM_BITS:
        w = in_key(rows, keys).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    rows = rows.withColumn("_b", _block(SUM_BITS))
    totals = rows.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_b", *[F.sum(f"_t{i}").over(before).alias(f"_s{i}") for i in range(len(sums))])
    inside = Window.partitionBy(*keys, "_b").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(totals, [*keys, "_b"])
    rows = rows.withColumns({n: F.col(n) + F.coalesce(F.col(f"_s{i}"), F.lit(0)) for i, n in enumerate(sums)})
    return rows.drop("_b", *[f"_s{i}" for i in range(len(sums))])


def lag_scan(rows: DataFrame, keys: Sequence[str], most: int, column: str, name: str) -> DataFrame:
    """Adds the column's value in the key's row before; null in the first."""
    keys = list(keys)
    if most <= 1 << SUM_BITS:
        return rows.withColumn(name, F.lag(column).over(in_key(rows, keys)))
    rows = rows.withColumn(name, F.lag(column).over(Window.partitionBy(*keys, _block(SUM_BITS)).orderBy("place")))
    # The first row of a block follows the last one of the block before.
    ends = rows.where(F.pmod(F.col("place") + 1, F.lit(1 << SUM_BITS)) == 0).select(*keys, (F.col("place") + 1).alias("place"), F.col(column).alias("_last"))
    return rows.join(ends, [*keys, "place"], "left").withColumn(name, F.when(F.pmod("place", F.lit(1 << SUM_BITS)) == 0, F.col("_last")).otherwise(F.col(name))).drop("_last")


def affine_scan(rows: DataFrame, keys: Sequence[str], most: int, a: str = "a", b: str = "b") -> DataFrame:
    """Adds ``A``, ``B``: the map x -> A x + B that the maps x -> a x + b of a key give one after another, up to each row.

    Blocks of 32 rows are composed inside the row's window, the blocks' maps in the same way above them, and so on: the sizes of a key's
    levels are 1, 1/32, 1/1024 ... of its rows, and no array holds more than 32 maps. Where a key fits a window, the maps of the blocks
    before a row's own are collected in it (at most 128 of them) and nothing is joined.
    """
    keys = list(keys)
    rows = rows.withColumn("_b", _block(MAP_BITS))
    w = Window.partitionBy(*keys, "_block" if "_block" in rows.columns else "_b").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

    def composed(maps: Column) -> Column:
        return F.aggregate(maps, one, lambda p, x: F.struct((x["a"] * p["a"]).alias("a"), (x["a"] * p["b"] + x["b"]).alias("b")))

    rows = rows.withColumn("_m", composed(F.collect_list(F.struct(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))).over(w)))
    if most <= 1 << MAP_BITS:
        return rows.withColumns({"A": F.col("_m.a"), "B": F.col("_m.b")}).drop("_b", "_m")
    if most <= 1 << SUM_BITS:
        before = in_key(rows, keys).rowsBetween(Window.unboundedPreceding, -1)
        ends = F.when(F.pmod(F.col("place") + 1, F.lit(1 << MAP_BITS)) == 0, F.col("_m"))
        rows = rows.withColumn("_p", composed(F.collect_list(ends).over(before)))
        return rows.withColumns({"A": F.col("_m.a") * F.col("_p.a"), "B": F.col("_m.a") * F.col("_p.b") + F.col("_m.b")}).drop("_b", "_m", "_p")
    tops = rows.groupBy(*keys, "_b").agg(F.max_by("_m", "place").alias("_m")).select(*keys, F.col("_b").alias("place"), "_m.a", "_m.b")
    above = affine_scan(tops, keys, (most >> MAP_BITS) + 1)
    carry = above.select(*keys, (F.col("place") + 1).alias("_b"), F.col("A").alias("_pa"), F.col("B").alias("_pb"))
    rows = rows.join(carry, [*keys, "_b"], "left")
    pa, pb = F.coalesce("_pa", F.lit(1.0)), F.coalesce("_pb", F.lit(0.0))
    return rows.withColumns({"A": F.col("_m.a") * pa, "B": F.col("_m.a") * pb + F.col("_m.b")}).drop("_b", "_m", "_pa", "_pb")
