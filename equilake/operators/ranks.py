"""Exact order statistics that never sort a whole group in one task.

A group here is a cross-section (all symbols on a date, all companies of a sector, all decisions
of a tag) and grows with the data, so ``row_number() over (partition by group)`` would put it in
one task. Instead:

1. rows are pre-aggregated to distinct (group, value) with a count, so ties cost one row;
2. values fall into cells that keep their order, about 64 per factor of e, whose counts are
   prefix-summed per group (a few thousand cells at most);
3. the exact position inside a cell comes from a window over (group, cell).

Where values crowd (more than CROWDED distinct ones in a cell), a range shuffle by value takes the place of the cells: it cuts wherever the values
are, so half of all rows may lie within a millionth. Both ways give the same positions.

The cell depends on the value alone: a re-run after a lost executor gives the same answer. What is read several times is written
once as Parquet, with the columns that are needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilake.operators.prefix import numbered, sum_scan
from equilake.session import store

CROWDED = 1 << 16
_CELLS_PER_E = 64
_CELL_ORIGIN = 64 * 760  # beyond |ln| of any double
_TIE_CELL_HEX = 3  # 4096 cells of a uniform hash


def order_cell(value: Column) -> Column:
    """Integer that is monotone in ``value``."""
    magnitude = F.floor(F.ln(F.abs(value)) * _CELLS_PER_E) + _CELL_ORIGIN
    return F.when(value > 0, magnitude).when(value < 0, -magnitude).otherwise(F.lit(0)).cast("bigint")


def _prefix(df: DataFrame, group: Sequence[str], cell: str, count: str) -> DataFrame:
    """Per (group, cell): rows in earlier cells and rows in the group."""
    cells = df.groupBy(*group, cell).agg(F.sum(count).alias("_in_cell"))
    ordered = Window.partitionBy(*group).orderBy(cell)
    return cells.select(
        *group, cell,
        (F.sum("_in_cell").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in_cell")).alias("_cell_before"),
        F.sum("_in_cell").over(Window.partitionBy(*group)).alias("n"),
    )


def value_positions(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct (group, value) with ``ties``, ``before`` (rows with a smaller value) and group size ``n``."""
    group = list(group)
    distinct = store(
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, value).agg(F.count(F.lit(1)).alias("ties"))
        .withColumn("_cell", order_cell(F.col(value))), "values")
    fullest = distinct.groupBy(*group, "_cell").count().agg(F.max("count")).first()[0] or 0
    if fullest > CROWDED:
        named = distinct.drop("_cell").dropna(subset=group)
        rows, most = numbered(named, group, [value])
        rows = sum_scan(rows, group, most, {"_upto": "ties"})
        sizes = named.groupBy(*group).agg(F.sum("ties").alias("n"))
        return rows.join(sizes, group).select(*group, value, "ties", (F.col("_upto") - F.col("ties")).alias("before"), "n")
    cells = _prefix(distinct, group, "_cell", "ties")
    inside = Window.partitionBy(*group, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        distinct.join(cells, [*group, "_cell"])
        .withColumn("before", F.col("_cell_before") + F.sum("ties").over(inside) - F.col("ties"))
        .select(*group, value, "ties", "before", "n")
    )


def with_average_rank(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank (ties share the mean of their positions) of non-null values."""
    df = store(df, "ranked")
    ranks = value_positions(df, group, value).select(*group, value, (F.col("before") + (F.col("ties") + 1) / 2).alias(out))
    return df.join(ranks, [*group, value], "left")


def group_median(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per group, NULLs ignored."""
    pos = value_positions(df, group, value)
    lower, upper = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("ties")), F.col(value)))

    return pos.groupBy(*group).agg(((at(lower) + at(upper)) / 2).alias(out))


def bucket_of(position: Column, n: Column, buckets: int) -> Column:
    """1-based bucket of a 0-based position; the first ``n mod buckets`` buckets get one extra row."""
    size, extra = F.floor(n / buckets), n % buckets
    edge = extra * (size + 1)
    late = F.floor(F.try_divide(position - edge, size)) + extra
    return (F.when(position < edge, F.floor(position / (size + 1))).otherwise(late) + 1).cast("int")


def with_quantile_bucket(df: DataFrame, group: Sequence[str], value: str, tie: str, buckets: int, out: str = "bucket") -> DataFrame:
    """Equal-count buckets by value; ties in order of md5(tie), then tie.

    Groups with fewer rows than buckets are dropped, as are NULL values. Only tie groups that
    straddle a bucket edge need positions of single rows; these come from md5 cells.
    """
    df = store(df.filter(F.col(value).isNotNull()), "bucketed")
    pos = value_positions(df, group, value).filter(F.col("n") >= buckets)
    first = bucket_of(F.col("before"), F.col("n"), buckets)
    last = bucket_of(F.col("before") + F.col("ties") - 1, F.col("n"), buckets)
    placed = df.join(pos.withColumn("_first", first).withColumn("_last", last), [*group, value])

    hashed = (
        placed.filter("_first < _last")
        .withColumn("_hash", F.md5(F.col(tie).cast("string")))
        .withColumn("_tie_cell", F.substring("_hash", 1, _TIE_CELL_HEX))
    )
    tie_group = [*group, value]
    cells = _prefix(hashed.withColumn("_one", F.lit(1)), tie_group, "_tie_cell", "_one").drop("n")
    inside = Window.partitionBy(*tie_group, "_tie_cell").orderBy("_hash", tie)
    position = F.col("before") + F.col("_cell_before") + F.row_number().over(inside) - 1
    straddling = (
        hashed.join(cells, [*tie_group, "_tie_cell"])
        .withColumn(out, bucket_of(position, F.col("n"), buckets))
        .select(*df.columns, out)
    )
    whole = placed.filter("_first = _last").withColumn(out, F.col("_first")).select(*df.columns, out)
    return whole.unionByName(straddling)


def rank_correlation(df: DataFrame, group: Sequence[str], x: str, y: str, out: str) -> DataFrame:
    """Spearman correlation per group over rows where both sides are present.

    The mean of n ranks is (n + 1) / 2, so one aggregation of centred products is enough, and with
    half-integer ranks its sums are exact. NULL when either side is constant.
    """
    # Read by both sides' ranks and by the products: written once instead of computing the panel behind it again.
    pairs = store(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, x, y), "pairs")
    ranked = pairs
    for value, out_rank in ((x, "_rx"), (y, "_ry")):
        ranks = value_positions(pairs, group, value).select(*group, value, (F.col("before") + (F.col("ties") + 1) / 2).alias(out_rank))
        ranked = ranked.join(ranks, [*group, value])
    sums = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(F.col("_rx") * F.col("_rx")).alias("_xx"),
        F.sum(F.col("_ry") * F.col("_ry")).alias("_yy"),
    )
    correction = F.col("n") * (F.col("n") + 1) * (F.col("n") + 1) / 4
    vx, vy = F.col("_xx") - correction, F.col("_yy") - correction
    corr = F.when((vx > 0) & (vy > 0), (F.col("_xy") - correction) / F.sqrt(vx * vy))
    return sums.select(*group, "n", corr.alias(out))
