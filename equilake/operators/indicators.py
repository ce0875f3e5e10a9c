"""Per-symbol windows over daily bars.

(symbol, trade_date) is the key of a bar table, so a window partition is bounded by the trading
calendar whatever the size of the universe. Columns added by several functions share one exchange
and one sort. Means and deviations come from running sums and a lag, so the cost per bar does not
depend on the window length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from equilake.functions.scalars import rsi_value, safe_div

YEAR_BARS = 252


def by_date(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("trade_date")


def running(*keys: str) -> WindowSpec:
    return by_date(*keys).rowsBetween(Window.unboundedPreceding, 0)


def with_bar_index(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumn("bar_idx", F.row_number().over(by_date(*keys)))


def with_sma(df: DataFrame, col: str, spans: dict[str, int], *keys: str) -> DataFrame:
    """Simple means. NULL before the window fills, and after any missing value for good."""
    total, gaps = f"_{col}_sum", f"_{col}_gaps"
    df = df.withColumns({
        "_i": F.row_number().over(by_date(*keys)),
        total: F.sum(col).over(running(*keys)),
        gaps: F.sum(F.col(col).isNull().cast("int")).over(running(*keys)),
    })
    w = by_date(*keys)
    out = {
        name: F.when(
            (F.col("_i") >= n) & (F.col(gaps) == 0),
            (F.col(total) - F.coalesce(F.lag(total, n).over(w), F.lit(0.0))) / n,
        )
        for name, n in spans.items()
    }
    return df.withColumns(out).drop("_i", total, gaps)


def rolling(agg, col: str, n: int, shift: int = 0, *keys: str) -> Column:
    """Extreme of ``n`` bars ending ``shift`` bars back; NULL while incomplete or any is missing."""
    frame = by_date(*keys).rowsBetween(-(n - 1) - shift, -shift)
    return F.when(F.count(col).over(frame) == n, agg(col).over(frame))


def with_bollinger(df: DataFrame, col: str, n: int = 20, k: float = 2.0, *keys: str) -> DataFrame:
    """Mean and mean ± k population deviations of n bars: middle, upper, lower."""
    frame = by_date(*keys).rowsBetween(-(n - 1), 0)
    full = F.count(col).over(frame) == n
    df = df.withColumns({
        "middle": F.when(full, F.avg(col).over(frame)),
        "_sd": F.when(full, F.stddev_pop(col).over(frame)),
    })
    return df.withColumns({
        "upper": F.col("middle") + k * F.col("_sd"), "lower": F.col("middle") - k * F.col("_sd"),
    }).drop("_sd")


def with_donchian(df: DataFrame, n: int = 20, shift: int = 0, prefix: str = "channel_", *keys: str) -> DataFrame:
    df = df.withColumns({
        f"{prefix}upper": rolling(F.max, "high", n, shift, *keys),
        f"{prefix}lower": rolling(F.min, "low", n, shift, *keys),
    })
    return df.withColumn(f"{prefix}middle", (F.col(f"{prefix}upper") + F.col(f"{prefix}lower")) / 2)


def with_drawdown(df: DataFrame, col: str, *keys: str) -> DataFrame:
    """Running peak and relative drawdown (NULL where the peak is zero)."""
    return df.withColumn("peak", F.max(col).over(running(*keys))).withColumn(
        "drawdown", safe_div(F.col(col) - F.col("peak"), F.col("peak")))


def max_drawdown(df: DataFrame, col: str, keys: Sequence[str] = ("symbol",), date: str = "trade_date") -> DataFrame:
    """Deepest drawdown per key with its first trough and first peak date; zero and no dates when flat."""
    dd = with_drawdown(df, col, *keys)
    # The peak of a bar is first reached at the earliest date with that running maximum.
    dd = dd.withColumn("_peak_date", F.min(date).over(Window.partitionBy(*keys, "peak")))
    best = F.min_by(F.struct("drawdown", date, "_peak_date"), F.struct(F.col("drawdown"), F.col(date)))
    worst = dd.filter(F.col("drawdown").isNotNull()).groupBy(*keys).agg(best.alias("_b"))
    deep = F.col("_b.drawdown") * 100 < -1e-9
    return worst.select(
        *keys,
        F.when(deep, F.col("_b.drawdown") * 100).otherwise(0.0).alias("max_drawdown_pct"),
        F.when(deep, F.col("_b._peak_date")).alias("peak_date"),
        F.when(deep, F.col(f"_b.{date}")).alias("trough_date"),
    )


def trailing_return(col: str, k: int, *keys: str) -> Column:
    """Percent change from k bars ago; NULL when that price is missing or not positive."""
    base = F.lag(col, k).over(by_date(*keys))
    return F.when(base > 0, (safe_div(F.col(col), base) - 1) * 100)


def previous_close(prices: DataFrame) -> DataFrame:
    """Latest and second-newest close per symbol from the top two bars."""
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    top = prices.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
    return top.groupBy("symbol").agg(
        F.max("trade_date").alias("price_date"),
        F.max(F.when(F.col("_rn") == 1, F.col("close"))).alias("latest_close"),
        F.max(F.when(F.col("_rn") == 2, F.col("close"))).alias("prev_close"),
    )


# Means from running sums that differ by less than this share are equal; means of prices in tenths of a cent differ by far more.
SMA_ROUNDING = 1e-10


def cross_flag(a: str, b: str, direction: str, *keys: str, rounding: float = 0.0) -> Column:
    """True on bars where ``a`` moves from at-or-below to above ``b`` (``up``), or the reverse.

    Values that differ by no more than the share ``rounding`` count as equal, so a tie does not hang on the order of a sum.
    """
    w = by_date(*keys)
    pa, pb = F.lag(a).over(w), F.lag(b).over(w)

    def above(x: Column, y: Column) -> Column:
        return x - y > F.greatest(F.abs(x), F.abs(y)) * rounding if rounding else x > y

    if direction == "up":
        return F.coalesce(~above(pa, pb) & above(F.col(a), F.col(b)), F.lit(False))
    return F.coalesce(~above(pb, pa) & above(F.col(b), F.col(a)), F.lit(False))


def with_age(df: DataFrame, *keys: str) -> DataFrame:
    """``age`` = 1 on the newest bar, counting back."""
    return df.withColumn("age", F.row_number().over(Window.partitionBy(*(keys or ("symbol",))).orderBy(F.desc("trade_date"))))


def last_crosses(df: DataFrame, a: str, b: str, lookback: int | None, *keys: str, rounding: float = 0.0) -> DataFrame:
    """Newest up and down cross per symbol within ``lookback`` bars, and the later of the two (ties: up)."""
    flags = with_age(df, *keys).withColumns({"_up": cross_flag(a, b, "up", *keys, rounding=rounding), "_down": cross_flag(a, b, "down", *keys, rounding=rounding)})
    recent = F.lit(True) if lookback is None else F.col("age") <= lookback
    out = flags.groupBy(*(keys or ("symbol",))).agg(
        F.max(F.when(recent & F.col("_up"), F.col("trade_date"))).alias("up_date"),
        F.max(F.when(recent & F.col("_down"), F.col("trade_date"))).alias("down_date"),
    )
    up_wins = F.col("up_date").isNotNull() & (F.col("down_date").isNull() | (F.col("up_date") >= F.col("down_date")))
    return out.withColumns({
        "cross_date": F.when(up_wins, F.col("up_date")).otherwise(F.col("down_date")),
        "cross_direction": F.when(up_wins, "up").when(F.col("down_date").isNotNull(), "down"),
    })


def volume_spikes(bars: DataFrame, n: int = 20, mult: float = 2.0, lookback: int = 30) -> DataFrame:
    """Recent days whose volume exceeds ``mult`` times the n-bar mean that includes the day.

    The first ``n`` bars of a series never count.
    """
    df = with_age(with_bar_index(bars.withColumn("_v", F.coalesce(F.col("volume").cast("double"), F.lit(0.0)))))
    df = with_sma(df, "_v", {"avg_volume": n})
    hit = (F.col("age") <= lookback) & (F.col("bar_idx") > n) & (F.col("avg_volume") != 0) & (F.col("_v") > F.col("avg_volume") * mult)
    return df.filter(hit).select(
        "symbol", "trade_date", F.col("_v").cast("bigint").alias("volume"), safe_div("_v", "avg_volume").alias("multiple"))


def filled(col: Column, *keys: str) -> Column:
    """Forward-fill, then back-fill the head."""
    w = by_date(*keys)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(
        F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(col, ignorenulls=True).over(whole))


def with_price_factors(prices: DataFrame) -> DataFrame:
    """Momentum, reversal and realised volatility at every bar, by row offset.

    Offsets count all rows, also those without a price.
    """
    w = by_date()
    px = {n: F.lag("px", n).over(w) for n in (252, 126, 21)}
    window63 = w.rowsBetween(-63, 0)
    priced = F.when(F.col("px") > 0, F.col("px"))
    # Gaps drop out of the window, so returns span consecutive priced rows inside it.
    ln = F.ln(priced)
    prior = F.last(ln, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = prices.withColumns({"_ln": ln, "_prior": prior}).withColumn("_ret", F.col("_ln") - F.col("_prior"))
    # The first priced row of the window has no predecessor inside it: take its return out again.
    returns = F.count("_ln").over(window63) - 1
    leading = F.first(F.when(F.col("_ln").isNotNull(), F.struct(F.col("_ret").alias("r"))), ignorenulls=True).over(window63)
    df = df.withColumns({
        "_n": returns, "_lead": leading["r"],
        "_s": F.sum("_ret").over(window63), "_q": F.sum(F.col("_ret") * F.col("_ret")).over(window63),
    })
    s = F.coalesce(F.col("_s"), F.lit(0.0)) - F.coalesce(F.col("_lead"), F.lit(0.0))
    q = F.coalesce(F.col("_q"), F.lit(0.0)) - F.coalesce(F.col("_lead") * F.col("_lead"), F.lit(0.0))
    variance = F.try_divide(q - F.try_divide(s * s, F.col("_n")), F.col("_n") - 1)
    enough = (F.col("bar_idx") >= 64) & (F.col("_n") >= 29)
    vol = F.when(enough, F.sqrt(F.greatest(variance, F.lit(0.0))) * F.sqrt(F.lit(252.0)))
    return df.withColumns({
        "momentum_12_1": safe_div(px[21], px[252]) - 1,
        "momentum_6_1": safe_div(px[21], px[126]) - 1,
        "reversal_1m": -(safe_div(F.col("px"), px[21]) - 1),
        "realized_vol_3m": vol,
    }).drop("_ln", "_prior", "_ret", "_n", "_lead", "_s", "_q")


def with_true_range(bars: DataFrame, *keys: str) -> DataFrame:
    previous = F.lag("close").over(by_date(*keys))
    wide = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))
    return bars.withColumn("true_range", F.when(previous.isNull(), F.col("high") - F.col("low")).otherwise(wide))


def with_finite_rsi(bars: DataFrame, n: int = 14, col: str = "close", *keys: str) -> DataFrame:
    """RSI over exactly n changes: what a strategy that looks at n + 1 closes computes."""
    w = by_date(*keys)
    frame = w.rowsBetween(-(n - 1), 0)
    df = bars.withColumn("_d", F.col(col) - F.lag(col).over(w))
    df = df.withColumns({
        "_g": F.avg(F.greatest(F.col("_d"), F.lit(0.0))).over(frame),
        "_l": F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(frame),
        "_c": F.count("_d").over(frame),
    })
    return df.withColumn("rsi", F.when(F.col("_c") == n, rsi_value(F.col("_g"), F.col("_l"), "engine"))).drop("_d", "_g", "_l", "_c")


def finite_macd_weights(fast: int, slow: int, signal: int) -> tuple[list[float], list[float]]:
    """Weights of the last slow + signal closes (oldest first) in the MACD and signal line.

    Over a slice of fixed length the seeded averages are fixed linear combinations of the closes,
    so a strategy that only sees the slice needs dot products rather than a recurrence.
    """
    length = slow + signal

    def ema_rows(span: int) -> list[list[float] | None]:
        k = 2.0 / (span + 1)
        rows: list[list[float] | None] = [None] * length
        rows[span - 1] = [1.0 / span if i < span else 0.0 for i in range(length)]
        for t in range(span, length):
            rows[t] = [(1 - k) * p + (k if i == t else 0.0) for i, p in enumerate(rows[t - 1])]
        return rows

    fast_rows, slow_rows = ema_rows(fast), ema_rows(slow)
    lines = [[a - b for a, b in zip(fast_rows[t], slow_rows[t])] for t in range(slow - 1, length)]
    k = 2.0 / (signal + 1)
    sig = [sum(line[i] for line in lines[:signal]) / signal for i in range(length)]
    for line in lines[signal:]:
        sig = [(1 - k) * s + k * x for s, x in zip(sig, line)]
    return lines[-1], sig
