"""Set-based backtests: many symbols × strategies × parameter sets in one plan.

A long/flat strategy of fixed size needs no event loop. Entry is ignored while in a position and
exit while flat, so the decided position is the last of entry and exit; orders fill at the next
bar's open, so the held position is the decided one a bar later, and a fill is a change in it.
Rows of given signals take windows over (symbol, run). A grid takes windows over symbol with the runs' columns side by side,
so the bars are sorted once whatever the number of runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilake.operators import indicators as ind
from equilake.operators import prefix
from equilake.operators.prefix import affine_scan, lag_scan, numbered, numbered_in_windows, sum_scan
from equilake.session import store

RUN = ("symbol", "run_id")


class BacktestError(ValueError):
    """Unknown strategy, fee or slippage model."""


# ----- pluggable models -----------------------------------------------------------------------

Fee = Callable[[Column, Column], Column]
Slippage = Callable[[Column, Column, Column, Column], Column]


def fee_zero() -> Fee:
    return lambda price, quantity: F.lit(0.0)


def fee_per_share(per_share: float = 0.005, minimum: float = 1.0, max_share: float = 0.005) -> Fee:
    """Per share, capped at a share of the trade value, but never below the minimum."""
    return lambda price, quantity: F.greatest(F.lit(minimum), F.least(quantity * per_share, price * quantity * max_share))


def fee_percentage(rate: float = 0.001) -> Fee:
    return lambda price, quantity: price * quantity * rate


# Monthly share volume up to which a rate per share applies.
TIERS = ((300_000.0, 0.0035), (3_000_000.0, 0.0020), (20_000_000.0, 0.0015), (None, 0.0010))


def tiered_fees(fills: DataFrame, keys: Sequence[str], order: Sequence[str], month: Column, tiers=TIERS, minimum: float = 0.35, max_share: float = 0.01) -> DataFrame:
    """Adds ``month_volume`` and ``commission`` by cumulative volume of the month, tested before the fill is added.

    ``order`` is a total order of the fills of ``keys``. Volumes are a prefix scan, so an account may hold half of all fills, also of one day.
    """
    rows, most = numbered(fills.withColumn("_month", month), [*keys, "_month"], list(order))
    rows = sum_scan(rows, [*keys, "_month"], most, {"_upto": "quantity"})
    volume = F.col("_upto") - F.col("quantity")
    rate = F.lit(tiers[-1][1])
    for threshold, tier_rate in reversed([t for t in tiers if t[0] is not None]):
        rate = F.when(volume <= threshold, tier_rate).otherwise(rate)
    fee = F.greatest(F.lit(minimum), F.least(F.col("quantity") * rate, F.col("price") * F.col("quantity") * max_share))
    return rows.withColumns({"month_volume": volume, "commission": fee}).drop("_month", "_upto", "place")


def slippage_zero() -> Slippage:
    return lambda price, sign, quantity, volume: price


def slippage_fixed(rate: float = 0.0005) -> Slippage:
    return lambda price, sign, quantity, volume: price * (1 + sign * rate)


def slippage_impact(base: float = 0.0001, impact: float = 0.1) -> Slippage:
    """Half the spread plus a square-root share of the bar's volume (a million when unknown)."""

    def adjust(price: Column, sign: Column, quantity: Column, volume: Column) -> Column:
        traded = F.when(volume > 0, volume.cast("double")).otherwise(F.lit(1_000_000.0))
        return price * (1 + sign * (base + impact * F.sqrt(quantity / traded)))

    return adjust


FEES: dict[str, Callable[[], Fee]] = {"zero": fee_zero, "per-share": fee_per_share, "percentage": fee_percentage}


def get_fee(name: str) -> Fee:
    if name not in FEES:
        raise BacktestError(f"no fee model is called {name!r}; there are {', '.join(sorted(FEES))}")
    return FEES[name]()


# ----- strategies -----------------------------------------------------------------------------

Strategy = Callable[..., DataFrame]
_STRATEGIES: dict[str, Strategy] = {}


def register_strategy(name: str, fn: Strategy) -> Strategy:
    """``fn(bars, **params)`` returns the bars with Boolean ``entry`` and ``exit``.

    Use windows; a truly path-dependent rule may use ``applyInPandas`` per symbol inside ``fn``.
    """
    _STRATEGIES[name] = fn
    return fn


def strategy(name: str) -> Strategy:
    if name not in _STRATEGIES:
        raise BacktestError(f"no strategy is called {name!r}; there are {', '.join(sorted(_STRATEGIES))}")
    return _STRATEGIES[name]


def _flags(df: DataFrame, entry: Column, exit_: Column, drop: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({"entry": F.coalesce(entry, F.lit(False)), "exit": F.coalesce(exit_, F.lit(False))}).drop(*drop)


def sma_crossover(bars: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    # Both means come from the last ``slow`` closes, so neither exists before that many bars.
    df = ind.with_sma(ind.with_bar_index(bars), "close", {"_f": fast, "_s": slow})
    df = df.withColumn("_f", F.when(F.col("bar_idx") >= slow, F.col("_f")))
    up, down = (ind.cross_flag("_f", "_s", d, rounding=ind.SMA_ROUNDING) for d in ("up", "down"))
    return _flags(df, up, down, ("_f", "_s", "bar_idx"))


def macd_crossover(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, above_zero_only: bool = False) -> DataFrame:
    """The strategy sees slow + signal closes per bar: fixed weights over that slice, no recurrence."""
    w = ind.by_date()
    length = slow + signal
    line_w, signal_w = ind.finite_macd_weights(fast, slow, signal)
    slice_ = F.collect_list("close").over(w.rowsBetween(-(length - 1), 0))
    full = F.size("_c") == length

    def dot(weights: list[float]) -> Column:
        products = F.zip_with("_c", F.array(*[F.lit(float(x)) for x in weights]), lambda c, k: c * k)
        return F.when(full, F.aggregate(products, F.lit(0.0), lambda a, x: a + x))

    df = bars.withColumn("_c", slice_).withColumns({"_m": dot(line_w), "_g": dot(signal_w)})
    entry = ind.cross_flag("_m", "_g", "up")
    if above_zero_only:
        entry = entry & (F.col("_m") > 0)
    return _flags(df, entry, ind.cross_flag("_m", "_g", "down"), ("_c", "_m", "_g"))


def bollinger_reversion(bars: DataFrame, period: int = 20, num_std: float = 2.0, exit_at_middle: bool = True) -> DataFrame:
    df = ind.with_bollinger(bars, "close", period, num_std)
    exit_ = F.col("close") >= F.col("middle") if exit_at_middle else F.col("close") > F.col("upper")
    return _flags(df, F.col("close") < F.col("lower"), exit_, ("middle", "upper", "lower"))


def rsi_reversion(bars: DataFrame, period: int = 14, oversold: float = 30.0, overbought: float = 70.0) -> DataFrame:
    df = ind.with_finite_rsi(bars, period)
    return _flags(df, F.col("rsi") < oversold, F.col("rsi") > overbought, ("rsi",))


def donchian_breakout(bars: DataFrame, entry_period: int = 20, exit_period: int = 10) -> DataFrame:
    """Channels exclude the current bar; nothing happens before entry_period + 1 bars."""
    df = ind.with_bar_index(bars)
    df = df.withColumns({
        "_u": ind.rolling(F.max, "high", entry_period, 1), "_l": ind.rolling(F.min, "low", exit_period, 1) if exit_period <= entry_period else F.lit(None).cast("double")})
    ready = F.col("bar_idx") > entry_period
    return _flags(df, ready & (F.col("close") > F.col("_u")), ready & (F.col("close") < F.col("_l")), ("_u", "_l", "bar_idx"))


def buy_and_hold(bars: DataFrame) -> DataFrame:
    df = ind.with_bar_index(bars)
    return _flags(df, F.col("bar_idx") == 1, F.lit(False), ("bar_idx",))


for _name, _fn in (
    ("sma_crossover", sma_crossover), ("macd_crossover", macd_crossover), ("bollinger_reversion", bollinger_reversion),
    ("rsi_reversion", rsi_reversion), ("donchian_breakout", donchian_breakout), ("buy_and_hold", buy_and_hold),
):
    register_strategy(_name, _fn)


@dataclass(frozen=True)
class Run:
    """One cell of a grid: a strategy with parameters and a position size."""

    run_id: str
    strategy: str
    params: Mapping[str, object] = field(default_factory=dict)
    size: int = 100


def strategy_signals(bars: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """Entry and exit of every run on every bar: columns run_id, size, entry, exit.

    The signals of all runs are computed side by side over one exchange and sort of the bars and
    then unfolded, so a grid costs rows only where it needs them.
    """
    return _unfolded(_side_by_side(bars, runs), bars.columns, runs, ["entry", "exit"])


def _side_by_side(bars: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """The bars with ``entry{i}`` and ``exit{i}`` of the i-th run."""
    if len({r.run_id for r in runs}) != len(runs):
        raise BacktestError("run ids must be unique")
    df = bars
    for i, run in enumerate(runs):
        df = strategy(run.strategy)(df, **run.params).withColumnsRenamed({"entry": f"entry{i}", "exit": f"exit{i}"})
    return df


def _unfolded(wide: DataFrame, kept: Sequence[str], runs: Sequence[Run], columns: Sequence[str]) -> DataFrame:
    """A row a bar and run: the ``kept`` columns, run_id, size and the run's own ``columns``."""
    cells = [
        F.struct(F.lit(run.run_id).alias("run_id"), F.lit(run.size).alias("size"), *[F.col(f"{c}{i}").alias(c) for c in columns]) for i, run in enumerate(runs)]
    return wide.select(*kept, F.explode(F.array(*cells)).alias("r")).select(*kept, *[f"r.{c}" for c in ("run_id", "size", *columns)])


# ----- positions, fills, equity ---------------------------------------------------------------


def positions_from_signals(signals: DataFrame, fee: Fee | None = None, slippage: Slippage | None = None) -> DataFrame:
    """Adds position held after the open, the fill of the bar (signed), its price and commission."""
    fee, slippage = fee or fee_per_share(), slippage or slippage_fixed()
    w = ind.by_date(*RUN)
    decided = F.last(F.when(F.col("entry"), 1).when(F.col("exit"), 0), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = signals.withColumn("_d", F.coalesce(decided, F.lit(0)))
    df = df.withColumn("position", F.coalesce(F.lag("_d").over(w), F.lit(0)) * F.col("size"))
    df = df.withColumn("fill_qty", F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0)))
    sign, quantity = F.signum(F.col("fill_qty").cast("double")), F.abs("fill_qty").cast("double")
    price = F.when(F.col("fill_qty") != 0, slippage(F.col("open"), sign, quantity, F.col("volume")))
    df = df.withColumn("fill_price", price)
    commission = F.when(F.col("fill_qty") != 0, fee(F.col("fill_price"), quantity)).otherwise(0.0)
    return df.withColumn("commission", commission).drop("_d")


def fills_of(positions: DataFrame) -> DataFrame:
    return positions.filter("fill_qty <> 0").select(*RUN, "trade_date", "fill_qty", "fill_price", "commission")


def equity_curve(positions: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """Cash from signed fills and fees plus holdings at the close, bar by bar."""
    w = ind.running(*RUN)
    flow = F.coalesce(F.col("fill_qty") * F.col("fill_price"), F.lit(0.0)) + F.col("commission")
    df = positions.withColumn("cash", F.lit(cash) - F.sum(flow).over(w))
    df = df.withColumn("market_value", F.col("position") * F.col("close"))
    return df.withColumn("equity", F.col("cash") + F.col("market_value"))


_POSITION = ("position", "fill_qty", "fill_price", "commission")
ACCOUNT = ("market_value", "equity", "last_equity", "last_value")
_CURVE = (*_POSITION, "market_value", "equity", "bar_no", "last_equity", "last_value", "ret", "peak", "drawdown")


def grid_positions(bars: DataFrame, runs: Sequence[Run], fee: Fee | None = None, slippage: Slippage | None = None) -> DataFrame:
    """``positions_from_signals`` of all runs: the windows of all runs share one sort of the bars, and rows are unfolded last."""
    return _unfolded(_grid(bars, runs, fee, slippage), ("symbol", "trade_date"), runs, _POSITION)


def grid_curves(
    bars: DataFrame, runs: Sequence[Run], cash: float = 100_000.0, fee: Fee | None = None, slippage: Slippage | None = None, columns: Sequence[str] = _CURVE,
) -> DataFrame:
    """``equity_curve`` of all runs, with bar_no, ret, peak and drawdown of the curve and equity and market value of the bar before (null on the first).

    A sort by (symbol, run) would hold a row a bar and run; here every window of every run works on the sorted bars, and the rows are unfolded
    where they are combined. ``columns`` are those that are unfolded.
    """
    df = _grid(bars, runs, fee, slippage)
    sofar, w, every = ind.running(), ind.by_date(), range(len(runs))
    flow = {i: F.coalesce(F.col(f"fill_qty{i}") * F.col(f"fill_price{i}"), F.lit(0.0)) + F.col(f"commission{i}") for i in every}
    df = df.withColumns({f"cash{i}": F.lit(cash) - F.sum(flow[i]).over(sofar) for i in every})
    df = df.withColumns({f"market_value{i}": F.col(f"position{i}") * F.col("close") for i in every})
    df = df.withColumns({f"equity{i}": F.col(f"cash{i}") + F.col(f"market_value{i}") for i in every})
    made: dict[str, Column] = {}
    for i in every:
        made |= {
            f"last_equity{i}": F.lag(f"equity{i}").over(w), f"last_value{i}": F.lag(f"market_value{i}").over(w), f"peak{i}": F.max(f"equity{i}").over(sofar),
            f"bar_no{i}": F.row_number().over(w)}
    df = df.withColumns(made)
    made = {}
    for i in every:
        equity, peak = F.col(f"equity{i}"), F.col(f"peak{i}")
        made |= {f"ret{i}": F.try_divide(equity, f"last_equity{i}") - 1, f"drawdown{i}": F.try_divide(equity - peak, peak)}
    return _unfolded(df.withColumns(made), ("symbol", "trade_date"), runs, columns)


def _grid(bars: DataFrame, runs: Sequence[Run], fee: Fee | None, slippage: Slippage | None) -> DataFrame:
    """The bars with position, fill, price and commission of every run side by side; see ``positions_from_signals``."""
    fee, slippage = fee or fee_per_share(), slippage or slippage_fixed()
    w, every = ind.by_date(), range(len(runs))
    df = _side_by_side(bars, runs)
    decided = {f"_d{i}": F.last(F.when(F.col(f"entry{i}"), 1).when(F.col(f"exit{i}"), 0), ignorenulls=True).over(ind.running()) for i in every}
    df = df.withColumns(decided)
    held = lambda i, n: F.coalesce(F.lag(f"_d{i}", n).over(w), F.lit(0)) * F.lit(runs[i].size)
    moves: dict[str, Column] = {}
    for i in every:
        moves |= {f"position{i}": held(i, 1), f"_from{i}": held(i, 2)}
    df = df.withColumns(moves).withColumns({f"fill_qty{i}": F.col(f"position{i}") - F.col(f"_from{i}") for i in every})
    for made in ("fill_price", "commission"):
        columns: dict[str, Column] = {}
        for i in every:
            moved = F.col(f"fill_qty{i}")
            quantity = F.abs(moved).cast("double")
            if made == "fill_price":
                columns[f"fill_price{i}"] = F.when(moved != 0, slippage(F.col("open"), F.signum(moved.cast("double")), quantity, F.col("volume")))
            else:
                columns[f"commission{i}"] = F.when(moved != 0, fee(F.col(f"fill_price{i}"), quantity)).otherwise(0.0)
        df = df.withColumns(columns)
    return df


def account_days(curves: DataFrame, keys: Sequence[str] = ("run_id",), cash: float = 100_000.0, one_account: bool = False) -> DataFrame:
    """``portfolio_curve`` and ``exposure_turnover`` of the rows of ``grid_curves`` in one pass: keys, trade_date, equity, long_exposure, short_exposure, turnover."""
    steps = F.sum(F.col("equity") - F.coalesce("last_equity", F.lit(cash)))
    value, last = F.col("market_value"), F.coalesce("last_value", F.lit(0.0))
    long_, short = (lambda x: F.greatest(x, F.lit(0.0))), (lambda x: F.least(x, F.lit(0.0)))
    days = curves.groupBy(*keys, "trade_date").agg(
        steps.alias("_step"), F.count_if(F.col("last_equity").isNull()).alias("_first"), F.sum(long_(value) - long_(last)).alias("_long"),
        F.sum(short(value) - short(last)).alias("_short"), F.sum(F.abs(value - last)).alias("_moved"))
    every = Window.partitionBy(*keys)
    sofar = every.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    start = F.lit(cash) if one_account else F.sum("_first").over(every) * F.lit(cash)
    out = days.withColumns({"equity": start + F.sum("_step").over(sofar), "_long": F.sum("_long").over(sofar), "_short": F.sum("_short").over(sofar)})
    positive = F.when(F.col("equity") > 0, F.col("equity"))
    return out.select(
        *keys, "trade_date", "equity", (F.col("_long") / positive).alias("long_exposure"), (F.col("_short") / positive).alias("short_exposure"),
        (F.col("_moved") / (positive * 2)).alias("turnover"))


def portfolio_curve(equity: DataFrame, keys: Sequence[str] = ("run_id",), cash: float = 100_000.0, one_account: bool = False) -> DataFrame:
    """keys, trade_date, equity of all symbols of a run together: an account of ``cash`` for each symbol, or ``one_account`` of ``cash`` for all.

    On a date without a bar a symbol counts with its last equity (before its first bar, with its cash). That is the sum of
    all changes up to the date, so nothing is filled in: a row a bar is combined by date, then summed along the calendar.
    """
    w = Window.partitionBy(*keys, "symbol").orderBy("trade_date")
    before = F.col("last_equity") if "last_equity" in equity.columns else F.lag("equity").over(w)
    steps = equity.select(*keys, "trade_date", (F.col("equity") - F.coalesce(before, F.lit(cash))).alias("_step"), before.isNull().cast("bigint").alias("_first"))
    days = steps.groupBy(*keys, "trade_date").agg(F.sum("_step").alias("_step"), F.sum("_first").alias("_first"))
    every = Window.partitionBy(*keys)
    sofar = every.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    start = F.lit(cash) if one_account else F.sum("_first").over(every) * F.lit(cash)
    return days.select(*keys, "trade_date", (start + F.sum("_step").over(sofar)).alias("equity"))


def round_trips(positions: DataFrame) -> DataFrame:
    """Closed long trades of the long/flat runs: each exit fill with the entry fill before it."""
    w = Window.partitionBy(*RUN).orderBy("trade_date")
    df = fills_of(positions)
    df = df.withColumns({
        "entry_time": F.lag("trade_date").over(w), "entry_price": F.lag("fill_price").over(w), "_fee": F.lag("commission").over(w)})
    quantity = -F.col("fill_qty")
    closed = df.filter("fill_qty < 0")
    pnl = quantity * (F.col("fill_price") - F.col("entry_price"))
    commission = F.col("commission") + F.col("_fee")
    return closed.select(
        *RUN, "entry_time", "entry_price", F.col("trade_date").alias("exit_time"), F.col("fill_price").alias("exit_price"), quantity.alias("quantity"),
        pnl.alias("pnl"), commission.alias("commission"), (pnl - commission).alias("net_pnl"),
        (F.try_divide("fill_price", "entry_price") - 1).alias("return_pct"), F.datediff("trade_date", "entry_time").alias("holding_days"))


# ----- average cost from any fills ------------------------------------------------------------


def position_ledger(fills: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Quantity, average cost and realised P&L (net of fees) after every signed fill.

    Input: ``keys`` (not null), ``order`` columns (a total order within the keys), ``quantity`` (signed), ``price``, ``commission``.

    Positions are a running sum. Average cost is a linear recurrence c' = a c + b whose a and b depend only on the positions
    around a fill, so both are prefix scans: windows over keys of a few thousand fills, else blocks of fills, so a key may hold half of
    all fills. Nothing leaves the JVM.
    """
    return _ledger(fills, list(keys), list(order))[0].drop("_block")


def _ledger(fills: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, int]:
    """``position_ledger``, and the most fills of a key or a bound of them."""
    rows, most = numbered_in_windows(fills, keys, order)
    df = sum_scan(rows, keys, most, {"position": "quantity"})
    held = F.col("position") - F.col("quantity")
    same = F.signum(held) == F.signum(F.col("quantity"))
    df = df.withColumns({"_held": held, "_adds": (held != 0) & same, "_starts": (held == 0) | (~same & (F.abs("quantity") > F.abs(held)))})
    total = F.abs("_held") + F.abs("quantity")
    a = F.when(F.col("_starts"), 0.0).when(F.col("_adds"), F.try_divide(F.abs("_held"), total)).otherwise(1.0)
    b = F.when(F.col("_starts"), F.col("price")).when(F.col("_adds"), F.try_divide(F.col("price") * F.abs("quantity"), total)).otherwise(0.0)
    df = affine_scan(df.withColumns({"_a": a, "_b0": b}), keys, most, "_a", "_b0")
    # Every key starts from no position, so its first map is constant and B is the cost.
    df = lag_scan(df.withColumnRenamed("B", "avg_cost"), keys, most, "avg_cost", "_prior")
    closes = (F.col("_held") != 0) & ~F.col("_adds") & (F.col("quantity") != 0)
    closed = F.least(F.abs("quantity"), F.abs("_held"))
    gross = F.when(closes, closed * (F.col("price") - F.col("_prior")) * F.signum("_held")).otherwise(0.0)
    df = df.withColumns({
        "closed_qty": F.when(closes, closed).otherwise(0.0), "entry_cost": F.when(closes, F.col("_prior")), "realized_pnl": gross - F.col("commission"),
    }).drop("_held", "_adds", "_starts", "_a", "_b0", "A", "_prior")
    return df, most


def closing_trades_of(fills: DataFrame, keys: Sequence[str], order: Sequence[str], date: str = "trade_date") -> DataFrame:
    """``closing_trades`` of the position ledger of the fills; see there and ``position_ledger``."""
    ledger, most = _ledger(fills, list(keys), list(order))
    return closing_trades(ledger, keys, date, most)


def closing_trades(ledger: DataFrame, keys: Sequence[str], date: str = "trade_date", most: int | None = None) -> DataFrame:
    """Round trips from a position ledger: a row for each fill that closes something, fully or in part. ``most``: the most fills of a key, if known.

    entry_time is the fill that opened the position (or turned it round). The fees of the opening and of all additions since the last closing fill, with the
    closing fill's own, are the trip's commission; what is left of a position starts with none. quantity is what was closed, held what was open.
    """
    keys = list(keys)
    held = F.col("position") - F.col("quantity")
    closes = F.col("closed_qty") > 0
    starts = (F.col("quantity") != 0) & (F.signum("position") != F.signum(held)) & (F.col("position") != 0)
    rows = ledger.withColumns({"_closes": closes.cast("bigint"), "_starts": starts.cast("bigint")})
    if most is None:
        most = (rows.agg(F.max("place")).first()[0] or 0) + 1
    if most <= 1 << prefix.SUM_BITS:
        # The fills of a key are together already: the trip's number and the last opening before a fill, then the trip's fees.
        sofar = prefix.in_key(rows, keys).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({
            "_trip": F.coalesce(F.sum("_closes").over(sofar), F.lit(0)), "entry_time": F.last(F.when(F.col("_starts") == 1, F.col(date)), ignorenulls=True).over(sofar)})
        done = rows.withColumn("_fees", F.sum("commission").over(Window.partitionBy(*keys, "_trip"))).where("_closes = 1")
    else:
        rows = sum_scan(rows, keys, most, {"_trip": "_closes", "_leg": "_starts"})
        rows = rows.withColumns({"_trip": F.col("_trip") - F.col("_closes"), "_before": F.col("_leg") - F.col("_starts")})
        # A trip's fees are summed by its number and a position's opening is found by its number: groups, not windows.
        fees = rows.groupBy(*keys, "_trip").agg(F.sum("commission").alias("_fees"))
        opened = rows.where("_starts = 1").select(*keys, F.col("_leg").alias("_before"), F.col(date).alias("entry_time"))
        done = rows.where("_closes = 1").join(fees, [*keys, "_trip"]).join(opened, [*keys, "_before"], "left")
    long = held > 0
    pnl = F.col("closed_qty") * (F.col("price") - F.col("entry_cost")) * F.signum(held)
    back = F.when(F.col("entry_cost") == 0, 0.0).otherwise(F.when(long, F.try_divide("price", "entry_cost")).otherwise(F.try_divide("entry_cost", "price")) - 1)
    return done.select(
        *keys, "entry_time", F.col(date).alias("exit_time"), F.when(long, "LONG").otherwise("SHORT").alias("direction"), F.col("closed_qty").alias("quantity"), F.abs(held).alias("held"),
        F.col("entry_cost").alias("entry_price"), F.col("price").alias("exit_price"), pnl.alias("pnl"), F.col("_fees").alias("commission"), (pnl - F.col("_fees")).alias("net_pnl"),
        back.alias("return_pct"), F.datediff(date, "entry_time").alias("holding_days"))


# ----- the whole run --------------------------------------------------------------------------


def run_backtests(
    bars: DataFrame, runs: Sequence[Run], cash: float = 100_000.0, fee: Fee | None = None, slippage: Slippage | None = None,
    benchmark: DataFrame | None = None, risk_free: float = 0.0,
) -> dict[str, DataFrame]:
    """Equity, trades and metrics of every (symbol, run). ``benchmark`` has trade_date and close."""
    from equilake.plans import metrics

    positions = grid_positions(bars, runs, fee, slippage)
    equity = grid_curves(bars, runs, cash, fee, slippage)
    trades = round_trips(positions)
    # A long/flat run closes one trip with each selling fill.
    sold = F.when(F.col("fill_qty") < 0, F.col("trade_date"))
    curves = grid_curves(bars, runs, cash, fee, slippage, (*metrics.CURVE, "fill_qty"))
    perf = metrics.performance_metrics(curves, RUN, risk_free, {"last_exit": F.max(sold), "closed_trades": F.count(sold)})
    if benchmark is not None:
        perf = perf.join(metrics.relative_metrics(equity, benchmark, RUN, risk_free), list(RUN), "left")
    return {"positions": positions, "equity": equity, "trades": trades, "metrics": perf, "trade_summary": metrics.trade_summary(trades, RUN)}


def run_accounts(
    bars: DataFrame, runs: Sequence[Run], cash: float = 100_000.0, fee: Fee | None = None, slippage: Slippage | None = None, benchmark: DataFrame | None = None, risk_free: float = 0.0,
) -> dict[str, DataFrame]:
    """Every run as one account that trades all symbols out of one cash balance: its curve, exposure and turnover, trades and metrics by run_id.

    Orders have a fixed size and are not refused for want of cash, so cash may go below zero; a symbol's flows do not depend on another's.
    """
    from equilake.plans import metrics

    days = store(account_days(grid_curves(bars, runs, cash, fee, slippage, ACCOUNT), ("run_id",), cash, one_account=True), "account")
    equity = days.select("run_id", "trade_date", "equity")
    trades = round_trips(grid_positions(bars, runs, fee, slippage))
    perf = metrics.performance_metrics(equity, ("run_id",), risk_free)
    if benchmark is not None:
        perf = perf.join(metrics.relative_metrics(equity, benchmark, ("run_id",), risk_free), "run_id", "left")
    exposure = days.filter("equity > 0").drop("equity")
    return {"equity": equity, "exposure": exposure, "trades": trades, "metrics": perf, "trade_summary": metrics.trade_summary(trades, ("run_id",))}


def compare_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The n newest stored runs (run_id, created_at, metrics ...), newest first, then by run_id."""
    return runs.orderBy(F.desc("created_at"), F.asc("run_id")).limit(n)
