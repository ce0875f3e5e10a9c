"""Runs of equal keys in a stream of Arrow batches, and numbers for the rows of a sorted table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equilake.session import store


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows whose key (never null) is equal. One run is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        cuts = np.flatnonzero(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for first, last in zip(edges, edges[1:], strict=False):
            part = batch.slice(first, last - first)
            if held and held[0].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with `place` (from 0, by `order`, nulls first) within their key (never null) and `size` of the key.

    A range shuffle on (key, order) spreads a hot key over many partitions. The sorted table is written once, so places never change;
    they are a row's place in its partition and the counts of the key's earlier partitions.
    """
    ordered = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__at", F.monotonically_increasing_id())
    ordered = store(ordered, name).withColumn("__part", F.shiftright("__at", 33))
    parts = ordered.groupBy(key, "__part").agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    whole = Window.partitionBy(key)
    parts = parts.withColumn("__before", F.sum("__n").over(whole.orderBy("__part")) - F.col("__n")).withColumn("size", F.sum("__n").over(whole))
    placed = ordered.join(parts.drop("__n"), [key, "__part"])
    return placed.withColumn("place", F.col("__before") + F.col("__at") - F.col("__low")).drop("__at", "__part", "__low", "__before")
