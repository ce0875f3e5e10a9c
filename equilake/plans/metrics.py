"""Trade and performance statistics per run. A run's curve has one row per trading day."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilake.operators import indicators as ind

YEAR = 252.0


def trade_summary(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, win rate, averages, profit factor (infinite without losses), extremes, holding days."""
    win, loss = F.col("net_pnl") > 0, F.col("net_pnl") <= 0
    n, lost = F.count(F.lit(1)), F.sum(F.when(loss, F.col("net_pnl")))
    won = F.coalesce(F.sum(F.when(win, F.col("net_pnl"))), F.lit(0.0))
    return trades.groupBy(*keys).agg(
        n.alias("total_trades"), F.count_if(win).alias("winning_trades"), F.count_if(loss).alias("losing_trades"), (F.count_if(win) / n).alias("win_rate"),
        F.coalesce(F.avg(F.when(win, F.col("net_pnl"))), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(loss, F.col("net_pnl"))), F.lit(0.0)).alias("avg_loss"),
        F.when(lost != 0, won / F.abs(lost)).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        F.max("net_pnl").alias("largest_win"), F.min("net_pnl").alias("largest_loss"), F.avg("holding_days").alias("avg_holding_days"), F.sum("net_pnl").alias("total_pnl"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function as a Column, to about 15 digits.

    erf(z) = 2 / sqrt(pi) * exp(-z z) * sum of 2^n z^(2n+1) / (1 3 5 ... (2n+1)): all terms are positive, so nothing cancels. Beyond
    z = 6 the tail is below a double's precision.
    """
    z = F.abs(x) / F.lit(math.sqrt(2.0))
    start = F.struct(z.alias("term"), z.alias("total"))

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * z * z * F.lit(2.0) / (F.lit(2.0) * n + F.lit(1.0))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, add, lambda acc: acc["total"])
    erf = F.when(z >= 6.0, F.lit(1.0)).otherwise(F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-z * z) * series)
    return F.when(F.isnan(x), F.lit(None)).otherwise((F.lit(1.0) + F.signum(x) * erf) / 2)


def with_returns(equity: DataFrame, keys: Sequence[str], col: str = "equity") -> DataFrame:
    w = ind.by_date(*keys)
    return equity.withColumns({"bar_no": F.row_number().over(w), "ret": F.try_divide(col, F.lag(col).over(w)) - 1})


def _or_zero(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.lit(0.0))


CURVE = ("equity", "bar_no", "ret", "peak", "drawdown")


def with_curve(equity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The returns and drawdown of a curve, unless it brings them (``grid_curves``)."""
    if {"ret", "bar_no", "drawdown"} <= set(equity.columns):
        return equity
    return ind.with_drawdown(with_returns(equity, keys), "equity", *keys)


def performance_metrics(equity: DataFrame, keys: Sequence[str], risk_free: float = 0.0, extra: dict[str, Column] | None = None) -> DataFrame:
    """Returns, drawdown, Sharpe, Sortino, Calmar, PSR, expectancy; population deviations throughout.

    Runs with fewer than two points give no row. ``extra``: more aggregates of the curve's rows.
    """
    daily_rf = (1 + risk_free) ** (1 / YEAR) - 1
    df = with_curve(equity, keys)
    extra = extra or {}
    below = F.when(F.col("ret") < daily_rf, F.col("ret") - daily_rf)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_points"), F.count("ret").alias("_n"), F.min_by("equity", "trade_date").alias("initial_equity"),
        F.max_by("equity", "trade_date").alias("final_equity"), F.datediff(F.max("trade_date"), F.min("trade_date")).alias("_days"),
        F.min("drawdown").alias("max_drawdown"), F.avg("ret").alias("_mean"), F.stddev_pop("ret").alias("_sd"), F.count(below).alias("_down_n"),
        F.stddev_pop(below).alias("_down_sd"), F.count_if(F.col("ret") > 0).alias("_wins"), F.avg(F.when(F.col("ret") > 0, F.col("ret"))).alias("_avg_win"),
        F.avg(F.when(F.col("ret") < 0, F.col("ret"))).alias("_avg_loss"), F.skewness("ret").alias("_skew"), F.kurtosis("ret").alias("_kurt"),
        *[c.alias(n) for n, c in extra.items()],
    ).filter("_points >= 2")
    growth = F.try_divide("final_equity", "initial_equity")
    annual = F.when(F.col("_days") <= 0, 0.0).when(growth > 0, F.pow(growth, F.try_divide(F.lit(365.0), F.col("_days").cast("double"))) - 1).otherwise(-1.0)
    out = agg.withColumns({
        "total_return": F.coalesce(growth - 1, F.lit(0.0)), "cagr": annual,
        "sharpe": _or_zero(F.col("_sd") > 0, F.try_divide(F.col("_mean") - daily_rf, "_sd") * math.sqrt(YEAR)),
        "sortino": _or_zero((F.col("_down_n") > 0) & (F.col("_down_sd") > 0), F.try_divide(F.col("_mean") - daily_rf, "_down_sd") * math.sqrt(YEAR)),
        "win_rate": _or_zero(F.col("_n") > 0, F.try_divide("_wins", "_n")), "volatility": F.col("_sd") * math.sqrt(YEAR),
    })
    out = out.withColumn("calmar", _or_zero(F.col("max_drawdown") != 0, F.try_divide("cagr", F.abs("max_drawdown"))))
    expectancy = F.col("win_rate") * F.col("_avg_win") - (1 - F.col("win_rate")) * F.abs("_avg_loss")
    spread = 1 - F.col("_skew") * F.col("sharpe") + (F.col("_kurt") + 2) / 4 * F.col("sharpe") * F.col("sharpe")
    score = F.when(
        (F.col("_n") > 2) & (F.col("_sd") > 0),
        F.col("sharpe") * F.sqrt((F.col("_n") - 1).cast("double")) / F.sqrt(F.greatest(F.lit(1e-10), spread)))
    out = out.withColumns({"expectancy": F.coalesce(expectancy, F.lit(0.0)), "psr_score": score})
    out = out.withColumn("psr", F.coalesce(normal_cdf(F.col("psr_score")), F.lit(0.0)))
    return out.select(
        *keys, "total_return", "cagr", "max_drawdown", "sharpe", "sortino", "calmar", "psr_score", "psr", "expectancy", "win_rate",
        F.col("_n").alias("trading_days"), "initial_equity", "final_equity", "volatility", *extra)


def relative_metrics(equity: DataFrame, benchmark: DataFrame, keys: Sequence[str], risk_free: float = 0.0) -> DataFrame:
    """Alpha, beta, information ratio, tracking error and Treynor against one benchmark series.

    The two return series are matched by position and cut to the shorter one. The benchmark has
    one row per trading day, so it is small enough to broadcast whatever the number of runs.
    """
    w = Window.orderBy("trade_date")
    # One row a day, whatever table the caller gives: as many rows as the calendar has days, which bounds the window and the broadcast.
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("the benchmark has several rows a day: give one series"))).otherwise(F.max("close"))
    bench = benchmark.groupBy("trade_date").agg(one.cast("double").alias("b")).withColumns({
        "bar_no": F.row_number().over(w), "bret": F.try_divide("b", F.lag("b").over(w)) - 1})
    ends = bench.agg(F.min_by("b", "trade_date").alias("b0"), F.max_by("b", "trade_date").alias("b1"))
    df = with_curve(equity, keys).join(F.broadcast(bench.select("bar_no", "bret")), "bar_no", "left")
    # One pass: the curve's ends from all rows, the rest from those with both returns.
    both = F.col("ret").isNotNull() & F.col("bret").isNotNull()
    ret, bret, gap = F.when(both, F.col("ret")), F.when(both, F.col("bret")), F.when(both, F.col("ret") - F.col("bret"))
    out = df.groupBy(*keys).agg(
        F.min_by("equity", "trade_date").alias("e0"), F.max_by("equity", "trade_date").alias("e1"), F.datediff(F.max("trade_date"), F.min("trade_date")).alias("days"),
        F.count(gap).alias("_both"), F.covar_samp(ret, bret).alias("cov"), F.var_samp(bret).alias("var"), F.avg(gap).alias("gap"), F.stddev_pop(gap).alias("gap_sd"),
    ).filter("_both > 0").join(F.broadcast(ends))
    growth = F.try_divide("e1", "e0")
    annual = F.when(F.col("days") <= 0, 0.0).when(growth > 0, F.pow(growth, F.try_divide(F.lit(365.0), F.col("days").cast("double"))) - 1).otherwise(-1.0)
    out = out.withColumns({
        "benchmark_return": F.try_divide("b1", "b0") - 1, "beta": _or_zero(F.col("var") > 0, F.try_divide("cov", "var")),
        "information_ratio": _or_zero(F.col("gap_sd") > 0, F.try_divide("gap", "gap_sd") * math.sqrt(YEAR)),
        "tracking_error": _or_zero(F.col("gap_sd") > 0, F.col("gap_sd") * math.sqrt(YEAR))})
    return out.select(
        *keys, "benchmark_return", (growth - 1 - F.col("benchmark_return")).alias("alpha"), "beta", "information_ratio", "tracking_error",
        _or_zero(F.col("beta") != 0, F.try_divide(annual - risk_free, "beta")).alias("treynor"))


def exposure_turnover(positions: DataFrame, equity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long and short exposure and turnover per (keys, date) of ``equity``.

    ``positions``: keys, symbol, trade_date, market_value (signed, zero when flat) on the symbol's bars;
    ``equity``: keys, trade_date, equity. A symbol without a bar on a date counts with the value of its last bar, so what is summed
    are changes of value, day by day: nothing is filled in per symbol. Turnover is half the absolute change in holdings over equity.
    """
    w = Window.partitionBy(*keys, "symbol").orderBy("trade_date")
    last = F.coalesce(F.lag("market_value").over(w), F.lit(0.0))
    long_, short = (lambda x: F.greatest(x, F.lit(0.0))), (lambda x: F.least(x, F.lit(0.0)))
    df = positions.withColumns({"_move": F.abs(F.col("market_value") - last), "_long": long_(F.col("market_value")) - long_(last), "_short": short(F.col("market_value")) - short(last)})
    changes = df.groupBy(*keys, "trade_date").agg(F.sum("_long").alias("_long"), F.sum("_short").alias("_short"), F.sum("_move").alias("moved"))
    # One row a day and key: bounded by the calendar.
    days = equity.select(*keys, "trade_date", "equity").join(changes, [*keys, "trade_date"], "full")
    sofar = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    out = days.withColumns({"long_value": F.sum("_long").over(sofar), "short_value": F.sum("_short").over(sofar), "moved": F.coalesce("moved", F.lit(0.0))}).filter("equity > 0")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("long_value", "short_value")})
    return out.select(
        *keys, "trade_date", F.try_divide("long_value", "equity").alias("long_exposure"), F.try_divide("short_value", "equity").alias("short_exposure"),
        F.try_divide("moved", F.col("equity") * 2).alias("turnover"))
