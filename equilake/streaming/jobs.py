"""Structured Streaming forms of the incremental jobs.

Each one is the batch operator fed by micro-batches, so a replay of the stream gives the batch
answer. State is bounded by watermarks or by the number of symbols, and raw ticks are combined
map-side before any state is touched.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from equilake.operators.upsert import heal_prices, insert_news
from equilake.streaming.months import MonthTable

def bars_from_ticks(ticks: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """OHLCV bars of (symbol, ts, price, volume) ticks; works on a batch and on a stream.

    Open and close are the prices at the first and last tick, ties broken by the smaller and larger
    price, so the bar does not depend on arrival order. All aggregates combine map-side.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    moment = F.struct("ts", "price")
    bars = ticks.groupBy("symbol", window.alias("w")).agg(
        F.min(moment).alias("_open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(moment).alias("_close"), F.sum("volume").alias("volume"))
    return bars.select(
        "symbol", F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), F.col("_open.price").alias("open"), "high", "low",
        F.col("_close.price").alias("close"), "volume")


def stream_bars(ticks: DataFrame, width: str = "1 day", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    return bars_from_ticks(ticks.withWatermark("ts", delay), width, slide)


def session_bars(ticks: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """One bar per burst of ticks."""
    moment = F.struct("ts", "price")
    bars = ticks.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(
        F.min(moment).alias("_open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(moment).alias("_close"), F.sum("volume").alias("volume"))
    return bars.select(
        "symbol", F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), F.col("_open.price").alias("open"), "high", "low",
        F.col("_close.price").alias("close"), "volume")


def stream_dedupe(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First event per key within the watermark; state older than the delay is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def freshness(events: DataFrame, time: str = "ts") -> DataFrame:
    """Newest clock value per (scope, symbol) of a table."""
    return events.groupBy("scope", "symbol").agg(F.max(time).alias("latest"))


def stream_freshness(events: DataFrame, time: str = "ts", forget: str | None = None) -> DataFrame:
    """Newest clock value per (scope, symbol); run in update mode, one small row of state per key.

    ``forget`` bounds the state: rows are kept by days (of event time), and a day is dropped when the watermark, so far behind the newest
    event, has passed it. A reader takes the newest of a key's rows.
    """
    if forget is None:
        return freshness(events, time)
    days = events.withWatermark(time, forget).groupBy("scope", "symbol", F.window(time, "1 day").alias("day"))
    return days.agg(F.max(time).alias("latest")).select("scope", "symbol", "latest")


def _month_loop(stream: DataFrame, table: MonthTable, checkpoint: str, step: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], name: str) -> StreamingQuery:
    """``table.apply`` per micro-batch. A batch replayed after a failure finds its epoch in the manifest and changes nothing."""

    def apply(batch: DataFrame, epoch: int) -> None:
        table.apply(batch, step, name, epoch)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_heal_prices(bars: DataFrame, table: MonthTable, checkpoint: str, heal_days: int = 7, name: str = "bars") -> StreamingQuery:
    """Incremental bars with the trailing correction window of ``heal_prices``; only the months of the arriving bars are read and rewritten.
    ``name`` goes with the checkpoint: a new checkpoint needs a new name."""
    return _month_loop(bars, table, checkpoint, lambda stored, new, newest: heal_prices(stored, new, heal_days, newest)[0], name)


def stream_news(news: DataFrame, table: MonthTable, checkpoint: str, name: str = "news") -> StreamingQuery:
    """Headlines not yet stored; a headline's key holds its instant, so its month is the only one that can have it."""
    return _month_loop(news, table, checkpoint, lambda stored, new, _newest: insert_news(stored, new), name)


# ----- signal monitor -------------------------------------------------------------------------


def resolve_signals(signals: DataFrame, quotes: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """Signals with status open, target_hit, stopped_out or expired after ``quotes``.

    ``signals``: signal_id, symbol, direction (buy or sell), target_price, stop_loss, created_at,
    expires_at, status, closed_at. ``quotes``: symbol, ts, price. A stop wins over a target at the
    same instant; a signal expires once the clock of its symbol (or ``now``) passes its horizon.

    A signal is looked up by the days of its life: extremes of a day tell the first day that can close it, those of the minutes the first minute,
    and only that minute is examined tick by tick. All joins are by (symbol, day) or (symbol, minute), so a symbol with most
    ticks and most signals is spread over its days, and a signal meets a row a day and the minutes of two days.
    """
    minute = quotes.withColumn("minute", F.date_trunc("minute", "ts")).groupBy("symbol", "minute").agg(
        F.max("price").alias("hi"), F.min("price").alias("lo"), F.max("ts").alias("last_ts")).withColumn("day", F.to_date("minute"))
    day = minute.groupBy("symbol", "day").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("last_ts").alias("last_ts"))
    clock = day.groupBy("symbol").agg(F.max("last_ts").alias("clock"))
    active = signals.filter("status = 'open' and created_at <= expires_at")
    buy = F.col("direction") == "buy"

    def stopped(low, high):
        return F.coalesce(F.when(buy, low <= F.col("stop_loss")).otherwise(high >= F.col("stop_loss")), F.lit(False))

    def reached(low, high):
        return F.coalesce(F.when(buy, high >= F.col("target_price")).otherwise(low <= F.col("target_price")), F.lit(False))

    touches = stopped(F.col("lo"), F.col("hi")) | reached(F.col("lo"), F.col("hi"))
    keys = ["signal_id", "symbol", "direction", "target_price", "stop_loss", "created_at", "expires_at"]

    def first_two(touched: DataFrame, unit: str, start: Column) -> DataFrame:
        """Of the units a signal is touched in: the one it is made in, and the first one after. Both may hold ticks outside its life: the first at its
        beginning, the second if it is its last; any other is certain to hold a hit."""
        picked = touched.groupBy(*keys).agg(F.min(F.when(F.col(unit) > start, F.col(unit))).alias("u1"), F.min(F.when(F.col(unit) == start, F.col(unit))).alias("u0"))
        return picked.select(*keys, F.explode(F.array_compact(F.array("u0", "u1"))).alias(unit))

    lives = active.select(*keys, F.explode(F.sequence(F.to_date("created_at"), F.to_date("expires_at"))).alias("day"))
    days = first_two(lives.join(day.drop("last_ts"), ["symbol", "day"]).filter(touches), "day", F.to_date("created_at"))
    start = F.date_trunc("minute", "created_at")
    in_life = (F.col("minute") >= start) & (F.col("minute") <= F.col("expires_at"))
    spans = first_two(days.join(minute.drop("last_ts"), ["symbol", "day"]).filter(in_life & touches), "minute", start)
    ticks = quotes.withColumn("minute", F.date_trunc("minute", "ts"))
    alive = (F.col("ts") >= F.col("created_at")) & (F.col("ts") <= F.col("expires_at"))
    px = F.col("price")
    hits = spans.join(ticks, ["symbol", "minute"]).filter(alive & (stopped(px, px) | reached(px, px)))
    first = hits.groupBy("signal_id").agg(F.min(F.struct("ts", F.when(stopped(px, px), 0).otherwise(1).alias("k"))).alias("h"))
    out = signals.join(first, "signal_id", "left").join(clock, "symbol", "left")
    time = F.greatest(F.col("clock"), F.lit(now).cast("timestamp")) if now is not None else F.col("clock")
    expired = F.coalesce(time > F.col("expires_at"), F.lit(False))
    status = (
        F.when(F.col("status") != "open", F.col("status")).when(F.col("h.k") == 0, "stopped_out").when(F.col("h.k") == 1, "target_hit")
        .when(expired, "expired").otherwise("open"))
    closed = F.when(F.col("status") != "open", F.col("closed_at")).when(F.col("h").isNotNull(), F.col("h.ts")).when(expired, F.col("expires_at"))
    return out.withColumns({"_s": status, "_c": closed}).drop("h", "clock", "status", "closed_at").withColumnsRenamed({"_s": "status", "_c": "closed_at"}).select(*signals.columns)
