"""As-of lookups as union + last-value window.

Bars and lookups are unioned and sorted once per symbol. Lookups are first reduced to distinct
(symbol, date) pairs, so the window sees at most one bar and one lookup per symbol and calendar
day however many rows ask for the same price; the answers go back by an equi-join that AQE may
split if a pair is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_DAYS = 3

# Calendar days of each horizon.
HORIZON_DAYS = {"1w": 7, "1m": 30, "3m": 91, "6m": 182}


def asof_value(
    targets: DataFrame,
    series: DataFrame,
    value: Column,
    *,
    series_date: str = "trade_date",
    target_date: str = "target_date",
    tolerance_days: int | None = STALE_DAYS,
    skip_null: bool = True,
) -> DataFrame:
    """Distinct (symbol, target_date) of ``targets`` with the latest ``value`` on or before it.

    ``skip_null`` looks through rows whose value is missing; otherwise the latest row decides even
    if its value is NULL. Output: symbol, target_date, asof_date, value.
    """
    points = targets.select("symbol", F.col(target_date).alias("d")).distinct().select(
        "symbol", "d", F.lit(1).alias("kind"), F.lit(None).cast(f"struct<d:date,v:{_type_of(series, value)}>").alias("hit")
    )
    hit = F.struct(F.col(series_date).alias("d"), value.alias("v"))
    bars = series.select(
        "symbol",
        F.col(series_date).alias("d"),
        F.lit(0).alias("kind"),
        (F.when(value.isNotNull(), hit) if skip_null else hit).alias("hit"),
    )
    window = Window.partitionBy("symbol").orderBy("d", "kind").rowsBetween(Window.unboundedPreceding, 0)
    scanned = bars.unionByName(points).withColumn("hit", F.last("hit", ignorenulls=True).over(window))
    found = scanned.filter("kind = 1").select(
        "symbol", F.col("d").alias("target_date"), F.col("hit.d").alias("asof_date"), F.col("hit.v").alias("value")
    )
    if tolerance_days is None:
        return found
    fresh = F.datediff("target_date", "asof_date") <= tolerance_days
    return found.select(
        "symbol", "target_date", F.when(fresh, F.col("asof_date")).alias("asof_date"), F.when(fresh, F.col("value")).alias("value")
    )


def _type_of(series: DataFrame, value: Column) -> str:
    return series.select(value.alias("v")).schema["v"].dataType.simpleString()


def adjusted_price() -> Column:
    return F.coalesce(F.col("adj_close"), F.col("close"))


def asof_price(targets: DataFrame, prices: DataFrame, tolerance_days: int | None = STALE_DAYS, variant: str = "factor") -> DataFrame:
    """``factor``: latest non-null adjusted price. ``ledger``: raw close of the latest bar, even if null."""
    if variant == "factor":
        return asof_value(targets, prices, adjusted_price(), tolerance_days=tolerance_days)
    return asof_value(targets, prices, F.col("close"), tolerance_days=tolerance_days, skip_null=False)


def asof_price_open(targets: DataFrame, prices: DataFrame) -> DataFrame:
    """Latest close on or before the date with no staleness limit, else the latest close known.

    A zero or missing as-of close also falls back.
    """
    hits = asof_value(targets, prices, F.col("close"), tolerance_days=None, skip_null=False)
    last = prices.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("last_close"))
    return hits.join(last, "symbol", "left").select(
        "symbol", "target_date", F.coalesce(F.nullif("value", F.lit(0.0)), F.col("last_close")).alias("value")
    )


def known_value(known: DataFrame, dates: DataFrame, *, value: str, key: str = "fiscal_date", known_on: str = "known_date") -> DataFrame:
    """For every (symbol, target_date): the value with the greatest ``key`` among rows known by then.

    Rows may become known out of ``key`` order, so the scan carries the running maximum of
    (key, value) rather than the last row seen.
    """
    kind = known.schema[value].dataType.simpleString()
    rows = known.filter(F.col(known_on).isNotNull()).select(
        "symbol", F.col(known_on).alias("d"), F.lit(0).alias("kind"), F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("hit")
    )
    points = dates.select("symbol", F.col("target_date").alias("d")).distinct().select(
        "symbol", "d", F.lit(1).alias("kind"), F.lit(None).cast(f"struct<k:date,v:{kind}>").alias("hit")
    )
    window = Window.partitionBy("symbol").orderBy("d", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # max_by keeps the whole struct of the greatest key, so a NULL value of that key wins too.
    best = F.max_by(F.col("hit"), F.col("hit.k")).over(window)
    scanned = rows.unionByName(points).withColumn("best", best)
    return scanned.filter("kind = 1").select("symbol", F.col("d").alias("target_date"), F.col("best.v").alias("value"))
