"""Scans over daily prices and the calendars derived from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilake.functions.scalars import safe_div
from equilake.operators.indicators import with_bar_index


def scan_bars(prices: DataFrame, start: dt.date | None = None, end: dt.date | None = None, adjusted: bool = True) -> DataFrame:
    """Bars of a date window for a backtest. The date filter reaches the Parquet scan.

    Rows without a close are skipped. When adjusted, open, high and low are scaled by
    adj_close / close and the adjusted close is used where there is one.
    """
    df = prices
    if start is not None:
        df = df.filter(F.col("trade_date") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("trade_date") <= F.lit(end))
    df = df.filter(F.col("close").isNotNull())
    scales = F.col("adj_close").isNotNull() & (F.col("close") != 0) if adjusted else F.lit(False)
    factor = F.when(scales, safe_div("adj_close", "close")).otherwise(F.lit(1.0))
    close = F.when(scales, F.col("adj_close")).otherwise(F.col("close"))

    def side(name: str) -> Column:
        return F.coalesce(F.col(name) * factor, close)

    return df.select(
        "symbol", "trade_date", side("open").alias("open"), side("high").alias("high"), side("low").alias("low"),
        close.alias("close"), F.coalesce("volume", F.lit(0)).cast("bigint").alias("volume"),
    )


def price_series(prices: DataFrame) -> DataFrame:
    """Whole history of the adjusted close (else close) with a row number per symbol."""
    px = prices.select("symbol", "trade_date", F.coalesce("adj_close", "close").alias("px"))
    return with_bar_index(px)


def rebalance_dates(prices: DataFrame, freq: str = "monthly") -> DataFrame:
    """Month ends or Fridays inside the span of all prices: one row per date."""
    if freq not in ("monthly", "weekly"):
        raise ValueError(f"portfolios are rebalanced monthly or weekly, not {freq!r}")
    span = prices.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).filter("a is not null")
    if freq == "monthly":
        months = F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))
        dates = span.select("a", "b", F.explode(months).alias("m")).select("a", "b", F.last_day("m").alias("rebalance_date"))
        return dates.filter(F.col("rebalance_date").between(F.col("a"), F.col("b"))).select("rebalance_date")
    first_friday = F.date_add("a", F.pmod(F.lit(6) - F.dayofweek("a"), F.lit(7)))
    weeks = F.when(first_friday <= F.col("b"), F.sequence(first_friday, F.col("b"), F.expr("interval 7 days")))
    return span.select(F.explode(weeks).alias("rebalance_date"))


def previous_weekday(date: Column) -> Column:
    shift = F.when(F.dayofweek(date) == 1, 2).when(F.dayofweek(date) == 7, 1).otherwise(0)
    return F.date_sub(date, shift)


def recent_settlement_dates(days: DataFrame, months: int, today: str = "today") -> DataFrame:
    """For each row: the settlement dates (15th and month end, moved back to a weekday) of the last
    ``months`` months up to its ``today``, with their rank from the newest."""
    start = F.add_months(F.trunc(today, "month"), -(months - 1))
    month = F.explode(F.sequence(start, F.trunc(today, "month"), F.expr("interval 1 month"))).alias("_m")
    pair = F.array_distinct(F.array(previous_weekday(F.date_add("_m", 14)), previous_weekday(F.last_day("_m"))))
    dates = days.select(*days.columns, month).select(*days.columns, F.explode(pair).alias("settlement_date"))
    return dates.filter(F.col("settlement_date") <= F.col(today))


def recent_quarters(days: DataFrame, n: int, today: str = "today") -> DataFrame:
    """For each row: ``n`` calendar-quarter labels ending at its ``today``; age 0 is the newest."""
    ages = days.select(*days.columns, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("age"))
    start = F.add_months(F.trunc(today, "quarter"), F.col("age") * -3)
    return ages.withColumn("quarter_label", F.concat(F.year(start).cast("string"), F.lit("Q"), F.quarter(start).cast("string")))
