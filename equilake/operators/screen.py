"""Fundamental and technical screens over the whole universe in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilake.functions.predicates import ScreenError, check_fields
from equilake.operators.indicators import YEAR_BARS, cross_flag, with_age
from equilake.operators.recurrence import Recurrence, with_recurrences
from equilake.operators.state import symbol_state

Predicate = tuple[str, Sequence[float]]

# Predicate -> default arguments (None: must be given).
TECHNICAL = {
    "above_sma": (None,), "below_sma": (None,), "rsi_oversold": (1, 30.0), "rsi_overbought": (1, 70.0),
    "macd_golden_cross": (5,), "macd_death_cross": (5,), "near_52w_high": (5.0,), "near_52w_low": (5.0,), "volume_spike": (20, 2.0),
}
_RECURRENT = ("rsi_oversold", "rsi_overbought", "macd_golden_cross", "macd_death_cross")


def resolve(predicates: Sequence[Predicate]) -> list[tuple[str, list[float]]]:
    """Check names and arguments and fill defaults."""
    if not predicates:
        raise ScreenError("no technical predicate")
    out = []
    for name, args in predicates:
        if name not in TECHNICAL:
            raise ScreenError(f"unknown predicate {name!r} (valid: {', '.join(sorted(TECHNICAL))})")
        defaults = TECHNICAL[name]
        if len(args) > len(defaults):
            raise ScreenError(f"too many arguments for {name}")
        if any(isinstance(a, str) for a in args):
            raise ScreenError(f"non-numeric argument for {name}")
        full = [*args, *defaults[len(args):]]
        if any(a is None for a in full):
            raise ScreenError(f"{name} needs {len(defaults)} argument(s)")
        if name in ("above_sma", "below_sma", "volume_spike") and full[0] <= 0:
            raise ScreenError(f"{name} needs a positive window")
        out.append((name, full))
    return out


def _flag(name: str, args: list[float]) -> Column:
    """Aggregate over one symbol's bars (``age`` 1 = newest, ``bars`` = how many) to a nullable flag."""
    last_close = F.max(F.when(F.col("age") == 1, F.col("close")))
    bars = F.max("bars")
    if name in ("above_sma", "below_sma"):
        n = int(args[0])
        mean = F.avg(F.when(F.col("age") <= n, F.col("close")))
        # The running-sum mean is poisoned by any gap in the whole history.
        complete = (bars >= n) & (F.count("close") == bars)
        return complete & ((last_close > mean) if name == "above_sma" else (last_close < mean))
    if name == "volume_spike":
        n, mult = int(args[0]), float(args[1])
        mean = F.avg(F.when(F.col("age") <= n, F.col("volume0")))
        return (bars >= n + 1) & (F.max(F.when(F.col("age") == 1, F.col("volume0"))) > mean * mult)
    if name in ("near_52w_high", "near_52w_low"):
        year = F.when(F.col("age") <= YEAR_BARS, F.col("close"))
        complete = (bars >= YEAR_BARS) & (F.count(year) == YEAR_BARS)
        share = float(args[0]) / 100.0
        return complete & (
            (last_close >= F.max(year) * (1 - share)) if name == "near_52w_high" else (last_close <= F.min(year) * (1 + share)))
    if name in ("rsi_oversold", "rsi_overbought"):
        recent = F.when(F.col("age") <= max(int(args[0]), 1), F.col("rsi14"))
        return (F.min(recent) < args[1]) if name == "rsi_oversold" else (F.max(recent) > args[1])
    flag = "golden" if name == "macd_golden_cross" else "death"
    return F.max(F.when(F.col("age") <= int(args[0]), F.col(flag)))


def technical_flags(bars: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    """One Boolean column per predicate and ``passes``, per symbol.

    Only the newest row number and the bar count need a window; means and extremes of the last n
    bars are then plain aggregates. Wilder RSI and MACD, when asked for, come from one Arrow pass.
    """
    wanted = resolve(predicates)
    df = bars.select("symbol", "trade_date", "close", F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("volume0"))
    if any(name in _RECURRENT for name, _ in wanted):
        df = with_recurrences(df, [Recurrence("rsi14", "rsi"), Recurrence("macd", "macd")], keep=("close", "volume0"))
        df = df.withColumns({"golden": cross_flag("macd_line", "macd_signal", "up"), "death": cross_flag("macd_line", "macd_signal", "down")})
    df = with_age(df).withColumn("bars", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    names = [f"{n}_{'_'.join(str(a) for a in args)}".replace(".", "p") for n, args in wanted]
    flags = df.groupBy("symbol").agg(*[F.coalesce(_flag(n, a), F.lit(False)).alias(c) for (n, a), c in zip(wanted, names)])
    passes = F.lit(True)
    for c in names:
        passes = passes & F.col(c)
    return flags.withColumn("passes", passes)


def fundamental_screen(state: DataFrame, predicate: Column) -> DataFrame:
    """Rows of the symbol state that pass. The predicate is an ordinary filter to the optimizer."""
    check_fields(state)
    return state.filter(predicate)


def run_screen(warehouse, predicate: Column | None = None, technical: Sequence[Predicate] | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Symbols that pass both parts, in order.

    Fundamentals go first, so price windows are computed for the survivors only.
    """
    if predicate is None and not technical:
        raise ScreenError("give a predicate, technical predicates, or both")
    candidates = (symbols if symbols is not None else warehouse["universe"]).select("symbol").distinct()
    if predicate is not None:
        state = symbol_state(candidates, warehouse["profiles"], warehouse["financial_ratios"], warehouse["daily_prices"])
        candidates = fundamental_screen(state, predicate).select("symbol")
    if technical:
        bars = warehouse["daily_prices"].join(candidates, "symbol", "left_semi")
        candidates = technical_flags(bars, technical).filter("passes").select("symbol")
    return candidates.orderBy("symbol")


def diff_runs(runs: DataFrame, from_id: str, to_id: str) -> DataFrame:
    """Symbols of two stored runs with status added, removed or kept; an unknown run is an error when the result is read.

    ``runs`` holds one row per (run_id, symbol); a run that matched nothing is one row with a NULL symbol. Nothing runs while the plan is made: one
    aggregation by symbol tells who is in which run, and one row made from it tells whether both runs exist.
    """
    asked = runs.filter(F.col("run_id").isin(from_id, to_id))
    held = asked.groupBy("symbol").agg(F.max(F.col("run_id") == from_id).alias("a"), F.max(F.col("run_id") == to_id).alias("b"))
    found = held.agg(F.max("a").alias("has_a"), F.max("b").alias("has_b"))

    def missing(flag: str, run: str) -> Column:
        return F.when(~F.coalesce(flag, F.lit(False)), F.raise_error(F.lit(f"no stored run has the id {run}")).cast("boolean"))

    checked = found.select(F.coalesce(missing("has_a", from_id), missing("has_b", to_id), F.lit(True)).alias("known")).filter("known")
    status = F.when(~F.col("a"), "added").when(~F.col("b"), "removed").otherwise("kept")
    rows = held.filter("symbol is not null").select("symbol", status.alias("status"))
    return checked.join(rows, F.lit(True), "left").filter("symbol is not null").select("symbol", "status")
