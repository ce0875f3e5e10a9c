"""Order matching, stops, margin, sizing and risk limits as table jobs.

"First later bar on which a condition holds" is answered without pairing every order with every later bar. A symbol's
history is one row that holds its years, those their months and those their bars, each with its extremes. An order or position meets it in one
join and opens only the units whose extremes could answer, up to the first answer. Nothing is cut off: an order that fills years later is still found.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilake.functions.scalars import safe_div
from equilake.plans.backtest import Fee, Slippage, fee_per_share, slippage_fixed
from equilake.session import store

LONG, SHORT = "LONG", "SHORT"


def _block(date: str) -> Column:
    return F.trunc(date, "month")


def _is_long() -> Column:
    return F.col("direction") == LONG


def _sign() -> Column:
    return F.when(_is_long(), F.lit(1.0)).otherwise(F.lit(-1.0))


def _fills(high: Column, low: Column) -> Column:
    """Whether an order can fill given a bar's (or a month's) high and low."""
    kind = F.col("order_type")
    limit = F.when(_is_long(), low <= F.col("limit_price")).otherwise(high >= F.col("limit_price"))
    stop = F.when(_is_long(), high >= F.col("stop_price")).otherwise(low <= F.col("stop_price"))
    return F.coalesce(
        F.when(kind == "MARKET", F.lit(True)).when(kind == "LIMIT", limit).when(kind == "STOP", stop).when(kind == "STOP_LIMIT", stop & limit), F.lit(False))


def match_orders(orders: DataFrame, bars: DataFrame, fee: Fee | None = None, slippage: Slippage | None = None, expiry_days: int | None = None) -> DataFrame:
    """Fill date, price and commission of every order; NULL while it is still open.

    ``orders``: order_id, symbol, order_date, direction, quantity, order_type, limit_price, stop_price.
    A limit improves to the open when the bar opens beyond it; a stop fills at the worse of stop and
    open, with slippage; a stop-limit has to trigger again on the bar that fills it.
    """
    fee, slippage = fee or fee_per_share(), slippage or slippage_fixed()
    last_day = F.date_add("order_date", expiry_days) if expiry_days is not None else F.lit(dt.date(9999, 12, 31))
    df = orders.withColumns({"_own": _block("order_date"), "_own_year": F.trunc("order_date", "year"), "_last_day": last_day})
    bar_type = f"struct<trade_date:date,high:double,low:double,{','.join(f'{c}:{bars.schema[c].dataType.simpleString()}' for c in ('open', 'volume'))}>"
    none = F.lit(None).cast(bar_type)

    def fits(x: Column, own: str) -> Column:
        return (x["start"] >= F.col(own)) & (x["start"] <= F.col("_last_day")) & _fills(x["high"], x["low"])

    def in_month(acc: Column, m: Column) -> Column:
        inside = F.filter(m["parts"], lambda b: (b["trade_date"] > F.col("order_date")) & (b["trade_date"] <= F.col("_last_day")) & _fills(b["high"], b["low"]))
        return F.when(acc.isNotNull(), acc).when(fits(m, "_own"), F.try_element_at(inside, F.lit(1)).cast(bar_type)).otherwise(none)

    def in_year(acc: Column, y: Column) -> Column:
        return F.when(acc.isNotNull(), acc).when(fits(y, "_own_year"), F.aggregate(y["parts"], none, in_month)).otherwise(none)

    out = df.join(_histories(bars, ("open", "volume")), "symbol", "left").select(*orders.columns, F.aggregate("years", none, in_year).alias("bar"))
    limit = F.when(_is_long(), F.least("limit_price", "bar.open")).otherwise(F.greatest("limit_price", "bar.open"))
    stop = F.when(_is_long(), F.greatest("stop_price", "bar.open")).otherwise(F.least("stop_price", "bar.open"))
    quantity = F.col("quantity").cast("double")
    slipped = {"MARKET": F.col("bar.open"), "STOP": stop}
    price = F.when(F.col("order_type").isin("LIMIT", "STOP_LIMIT"), limit)
    for kind, base in slipped.items():
        price = price.when(F.col("order_type") == kind, slippage(base, _sign(), quantity, F.col("bar.volume")))
    filled = F.col("bar").isNotNull()
    out = out.withColumns({"fill_date": F.col("bar.trade_date"), "fill_price": F.when(filled, price)})
    return out.withColumn("commission", F.when(filled, fee(F.col("fill_price"), quantity))).drop("bar")


def _histories(bars: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """A row a symbol: its ``years`` in order, each with its high, low and its months as ``parts``, and those with theirs and their bars.

    Stored, so that it meets positions in a plain join that AQE may split.
    """
    priced = bars.select("symbol", _block("trade_date").alias("block"), "trade_date", F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"), *more)
    extremes = [F.max("high").alias("high"), F.min("low").alias("low")]
    # By symbol from the start: all groupings work on that one exchange.
    months = priced.repartition("symbol").groupBy("symbol", "block").agg(*extremes, F.sort_array(F.collect_list(F.struct("trade_date", "high", "low", *more))).alias("parts"))
    years = months.groupBy("symbol", F.trunc("block", "year").alias("year")).agg(*extremes, F.sort_array(F.collect_list(F.struct(F.col("block").alias("start"), "high", "low", "parts"))).alias("parts"))
    return store(years.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(F.col("year").alias("start"), "high", "low", "parts"))).alias("years")), "histories")


_HIT = "struct<trade_date:date,reason:string,level:double>"


def stop_hits(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """First bar after entry on which a stop or target is touched, and the order it submits.

    ``positions``: position_id, symbol, entry_date, direction, quantity, and any of stop_loss,
    take_profit, trail_pct, trail_points, entry_price (start of the trailing extreme; may be NULL).
    A stop wins over a target on one bar; the trailing extreme is moved by the bar before the
    test. The hit submits a STOP or LIMIT order; filling it is ``match_orders`` on a later bar.

    A position meets its symbol's history in one join and walks along the years, carrying the best price so far. The months of a year
    and the bars of a month are looked at only where its extremes could touch a level, and nothing after the hit.
    """
    names = set(positions.columns)
    levels = ("stop_loss", "take_profit", "trail_pct", "trail_points", "entry_price")
    df = positions.withColumns({f"_{c}": F.col(c).cast("double") if c in names else F.lit(None).cast("double") for c in levels})
    # Computed once a position, not once a month.
    up = F.when(_is_long(), F.lit(1.0)).otherwise(F.lit(-1.0))
    df = df.withColumns({
        "_up": up, "_long": _is_long(), "_own": _block("entry_date"), "_own_year": F.trunc("entry_date", "year"), "_share": 1 - up * F.col("_trail_pct"),
        "_trailing": F.col("_trail_pct").isNotNull() | F.col("_trail_points").isNotNull(), "_by_pct": F.col("_trail_pct").isNotNull()})
    stop_loss, take_profit, trail_points, entry_price, up, share, trailing = (
        F.col(f"_{c}") for c in ("stop_loss", "take_profit", "trail_points", "entry_price", "up", "share", "trailing"))

    # Shorts are longs on mirrored prices: the best price is the low. Signed prices rise with what is better.
    def best(x: Column) -> Column:
        return F.when(F.col("_long"), x["high"]).otherwise(x["low"])

    def worst(x: Column) -> Column:
        return F.when(F.col("_long"), x["low"]).otherwise(x["high"])

    def touched(level: Column, price: Column) -> Column:
        """The adverse price has reached the level."""
        return F.coalesce(up * price <= up * level, F.lit(False))

    def trail_level(signed: Column) -> Column:
        extreme = up * signed
        return F.when(F.col("_by_pct"), extreme * share).otherwise(extreme - up * trail_points)

    def state(carried: Column, hit: Column) -> Column:
        return F.struct(carried.alias("carried"), hit.cast(_HIT).alias("hit"))

    def bar(acc: Column, b: Column) -> Column:
        carried = F.greatest(acc["carried"], up * best(b))
        trail = F.when(trailing, trail_level(carried))
        stop = touched(stop_loss, worst(b))
        target = F.coalesce(up * best(b) >= up * take_profit, F.lit(False))

        def found(reason: str, level: Column) -> Column:
            return F.struct(b["trade_date"].alias("trade_date"), F.lit(reason).alias("reason"), level.alias("level"))

        hit = F.when(stop, found("stop_loss", stop_loss)).when(target, found("take_profit", take_profit)).when(touched(trail, worst(b)), found("trailing", trail))
        return F.when(acc["hit"].isNotNull(), acc).otherwise(state(carried, hit))

    # A trail below zero falls as the extreme rises, so a month's extremes do not bound it.
    unbounded = F.coalesce(share < 0, F.lit(False))

    def unit(own: str, after: Callable[[Column], Column], inner: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        """The step over a month or year: into its parts (in the own one those after the entry) where a level could be touched, else past it."""
        def step(acc: Column, x: Column) -> Column:
            carried = F.greatest(acc["carried"], up * best(x))
            could = (
                (x["start"] == F.col(own)) | touched(stop_loss, worst(x)) | F.coalesce(up * best(x) >= up * take_profit, F.lit(False))
                | (trailing & (unbounded | touched(trail_level(carried), worst(x)))))
            parts = F.when(x["start"] == F.col(own), F.filter(x["parts"], after)).otherwise(x["parts"])
            return F.when(acc["hit"].isNotNull(), acc).when(could, F.aggregate(parts, acc, inner)).otherwise(state(carried, F.lit(None)))

        return step

    month = unit("_own", lambda b: b["trade_date"] > F.col("entry_date"), bar)
    year = unit("_own_year", lambda m: m["start"] >= F.col("_own"), month)
    start = state(up * F.when(entry_price > 0, entry_price), F.lit(None))
    walk = F.aggregate(F.filter("years", lambda y: y["start"] >= F.col("_own_year")), start, year, lambda acc: acc["hit"])
    out = df.join(_histories(bars), "symbol", "left").select(*positions.columns, walk.alias("hit"))
    order = F.when(F.col("hit.reason") == "take_profit", "LIMIT").when(F.col("hit").isNotNull(), "STOP")
    return out.withColumns({
        "hit_date": F.col("hit.trade_date"), "hit_reason": F.col("hit.reason"), "level": F.col("hit.level"), "exit_order_type": order,
        "exit_direction": F.when(F.col("hit").isNotNull(), F.when(_is_long(), SHORT).otherwise(LONG))}).drop("hit")


def slice_orders(orders: DataFrame, n: int) -> DataFrame:
    """n near-equal child orders, the first ones one larger; unchanged when the quantity is at most n."""
    n = max(1, n)
    pieces = F.when(F.col("quantity") <= n, F.lit(1)).otherwise(F.lit(n))
    sliced = orders.select("*", F.explode(F.sequence(F.lit(1), pieces)).alias("slice_no"))
    base, extra = F.floor(F.col("quantity") / n), F.col("quantity") % n
    child = F.when(F.col("quantity") <= n, F.col("quantity")).otherwise(base + F.when(F.col("slice_no") <= extra, 1).otherwise(0))
    return sliced.withColumn("slice_quantity", child.cast("bigint"))


# ----- margin ---------------------------------------------------------------------------------

# Account model -> (initial long, initial short, maintenance long, maintenance short).
MARGIN_RATES = {"reg_t": (0.50, 0.50, 0.25, 0.30), "portfolio": (0.15, 0.15, 0.10, 0.12), "cash": (1.0, None, 1.0, None)}


class RiskError(ValueError):
    """Unknown margin or sizing model."""


@dataclass(frozen=True)
class MarginModel:
    """Requirements of a position as expressions of its absolute value and of whether it is long."""

    initial: Callable[[Column, Column], Column]
    maintenance: Callable[[Column, Column], Column]
    shorts: bool = True


def fixed_rates(initial_long: float, initial_short: float | None, long: float, short: float | None) -> MarginModel:
    """A share of the value by side; None for a side the account may not hold."""
    def rate(up: float | None, down: float | None) -> Callable[[Column, Column], Column]:
        one = lambda x: F.lit(float("inf") if x is None else x)
        return lambda value, is_long: value * F.when(is_long, one(up)).otherwise(one(down))

    return MarginModel(rate(initial_long, initial_short), rate(long, short), initial_short is not None)


def margin_model(model: str | MarginModel) -> MarginModel:
    """A model of one's own, or a named one."""
    if isinstance(model, MarginModel):
        return model
    if model not in MARGIN_RATES:
        raise RiskError(f"no margin model is called {model!r}; there are {', '.join(sorted(MARGIN_RATES))}")
    return fixed_rates(*MARGIN_RATES[model])


def requirement(model: str | MarginModel, value: Column, is_long: Column, initial: bool) -> Column:
    """Requirement of a position value; infinite for what the account may not hold."""
    chosen = margin_model(model)
    return (chosen.initial if initial else chosen.maintenance)(F.abs(value), is_long)


def margin_status(positions: DataFrame, equity: DataFrame, keys: Sequence[str], model: str | MarginModel = "reg_t") -> DataFrame:
    """Maintenance requirement, excess, ratio and margin call per (keys) row of ``equity``.

    ``positions``: keys, symbol, quantity (signed), close. Accounts without positions are included.
    """
    held = positions.filter("quantity <> 0 and close is not null")
    need = held.groupBy(*keys).agg(F.sum(requirement(model, F.col("quantity") * F.col("close"), F.col("quantity") > 0, False)).alias("_need"))
    df = equity.select(*keys, "equity").join(need, list(keys), "left").withColumn("margin_required", F.coalesce("_need", F.lit(0.0)))
    needed = F.col("margin_required") > 0
    return df.select(
        *keys, "equity", "margin_required", (F.col("equity") - F.col("margin_required")).alias("margin_excess"),
        F.when(needed, safe_div("equity", "margin_required")).otherwise(F.lit(float("inf"))).alias("margin_ratio"),
        (needed & (F.col("equity") < F.col("margin_required"))).alias("margin_call"))


def margin_check(orders: DataFrame, status: DataFrame, keys: Sequence[str], model: str | MarginModel = "reg_t") -> DataFrame:
    """Approves orders whose initial requirement fits the excess.

    ``orders``: keys, direction, quantity, close (NULL: no bar, passes), held (signed quantity now).
    A cash account takes no short sale except to reduce a long.
    """
    df = orders.join(status.select(*keys, "margin_excess"), list(keys), "left")
    need = requirement(model, F.col("quantity") * F.col("close"), _is_long(), True)
    short = ~_is_long()
    reduces = F.coalesce(F.col("held") > 0, F.lit(False))
    fits = F.col("close").isNull() | (need <= F.col("margin_excess"))
    if not margin_model(model).shorts:
        reason = F.when(short & reduces, F.lit(None)).when(short, "short selling not allowed").when(~fits, "insufficient margin")
    else:
        reason = F.when(~fits, "insufficient margin")
    return df.withColumns({"initial_required": need, "margin_reason": reason}).withColumn("margin_approved", F.col("margin_reason").isNull())


def largest_position_to_close(status: DataFrame, positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """On a margin call: the largest holding by value, and the order that closes it."""
    called = status.filter("margin_call").select(*keys)
    held = positions.filter("quantity <> 0 and close is not null").join(called, list(keys), "left_semi")
    # Ties: alphabetical.
    rank = F.struct((-F.abs(F.col("quantity") * F.col("close"))).alias("v"), F.col("symbol"))
    biggest = held.groupBy(*keys).agg(F.min_by(F.struct("symbol", "quantity"), rank).alias("p"))
    return biggest.select(
        *keys, F.col("p.symbol").alias("symbol"), F.when(F.col("p.quantity") > 0, SHORT).otherwise(LONG).alias("direction"), F.abs("p.quantity").alias("quantity"))


# ----- sizing and limits ----------------------------------------------------------------------


def _whole(x: Column) -> Column:
    """Truncation towards zero."""
    return F.signum(x) * F.floor(F.abs(x))


def size_fixed_fraction(equity: Column, price: Column, fraction: float = 0.1, stop_distance: float | None = None, max_share: float = 0.25) -> Column:
    """Shares for a fraction of equity (or of risk, given a stop distance), capped by position share."""
    risk = equity * fraction
    wanted = _whole(safe_div(risk, price * stop_distance)) if stop_distance else _whole(safe_div(risk, price))
    capped = F.least(wanted, _whole(safe_div(equity * max_share, price)))
    return F.when(price > 0, capped).otherwise(0).cast("bigint")


def size_atr(equity: Column, price: Column, atr: Column, risk_share: float = 0.01, multiple: float = 2.0, max_share: float = 0.25) -> Column:
    """Shares that risk a share of equity per ``multiple`` ATRs; without an ATR, a plain fraction."""
    risk = equity * risk_share
    by_atr = F.greatest(F.least(_whole(safe_div(risk, atr * multiple)), _whole(safe_div(equity * max_share, price))), F.lit(0.0))
    plain = _whole(safe_div(risk, price))
    return F.when(price > 0, F.when(atr > 0, by_atr).otherwise(plain)).otherwise(0).cast("bigint")


def drawdown_breaker(equity: DataFrame, keys: Sequence[str], limit: float = 0.20) -> DataFrame:
    """Adds peak, drawdown and whether the breaker has tripped by each date; once tripped it stays."""
    w = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    df = equity.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(0.0)))
    df = df.withColumn("drawdown", F.when(F.col("peak") > 0, safe_div(F.col("peak") - F.col("equity"), "peak")))
    return df.withColumn("tripped", F.max(F.coalesce(F.col("drawdown") >= limit, F.lit(False))).over(w))


def tripped_on(curves: DataFrame, keys: Sequence[str], limit: float = 0.20) -> DataFrame:
    """The first date on which the breaker has tripped, for the keys where it has; ``curves`` bring the running peak of their equity."""
    peak = F.greatest("peak", F.lit(0.0))
    fallen = F.when(peak > 0, safe_div(peak - F.col("equity"), peak)) >= limit
    return curves.filter(fallen).groupBy(*keys).agg(F.min("trade_date").alias("tripped_on"))


def liquidation_orders(breaker: DataFrame, positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closing orders for everything held on the first tripped date of each key."""
    first = breaker.filter("tripped").groupBy(*keys).agg(F.min("trade_date").alias("trade_date"))
    held = positions.filter("quantity <> 0").join(first, [*keys, "trade_date"], "left_semi")
    return held.select(
        *keys, "trade_date", "symbol", F.when(F.col("quantity") > 0, SHORT).otherwise(LONG).alias("direction"), F.abs("quantity").alias("quantity"))


def breaker_check(orders: DataFrame) -> DataFrame:
    """After a trip only reducing orders pass. Needs ``tripped``, ``held`` and ``direction``."""
    held = F.coalesce(F.col("held"), F.lit(0))
    reducing = ((held > 0) & ~_is_long()) | ((held < 0) & _is_long())
    reason = F.when(F.coalesce("tripped", F.lit(False)) & ~reducing, "drawdown breaker")
    return orders.withColumn("breaker_reason", reason)


def position_limit(orders: DataFrame, max_share: float = 0.25) -> DataFrame:
    """Approves, shrinks or rejects an order by share of equity: ``allowed_quantity`` and ``limit_reason``.

    Needs quantity, direction, held, close, equity. An order without a bar or one that reduces the
    position passes.
    """
    held = F.coalesce(F.col("held"), F.lit(0)).cast("double")
    quantity = F.col("quantity").cast("double")
    most = F.when(F.col("close") > 0, _whole(safe_div(F.col("equity") * max_share, "close"))).otherwise(0.0)
    after = F.abs(held + _sign() * quantity)
    passes = F.col("close").isNull() | ((F.col("equity") > 0) & ((after <= F.abs(held)) | (after <= most)))
    room = F.greatest(most - F.abs(held), F.lit(0.0))
    reason = F.when(passes, F.lit(None)).when(F.col("equity") <= 0, "zero equity").when(room <= 0, "at position limit")
    allowed = F.when(passes, quantity).when((F.col("equity") > 0) & (room > 0), room).otherwise(0.0)
    return orders.withColumns({"allowed_quantity": allowed.cast("bigint"), "limit_reason": reason})


# A rule of one's own: the quantity it allows and, for a rejection, the reason, from the columns of the orders.
RiskRule = Callable[[], tuple[Column, Column]]


def check_orders(
    orders: DataFrame, status: DataFrame, keys: Sequence[str], model: str | MarginModel = "reg_t", max_share: float = 0.25, slices: int = 1, rules: Sequence[RiskRule] = (),
) -> DataFrame:
    """The order pipeline: breaker, position limit (may shrink), rules in order (may shrink), margin on the shrunk order, slicing.

    Every input order comes back, rejected ones with their reason and one row of quantity zero.
    """
    df = position_limit(breaker_check(orders), max_share).withColumn("asked_quantity", F.col("quantity"))
    df = df.withColumns({"quantity": F.col("allowed_quantity"), "limit_reason": F.coalesce("breaker_reason", "limit_reason")})
    for rule in rules:
        allowed, refused = rule()
        df = df.withColumns({"quantity": F.least("quantity", allowed.cast("bigint")), "limit_reason": F.coalesce("limit_reason", refused)})
    df = margin_check(df, status, keys, model)
    reason = F.coalesce("limit_reason", "margin_reason")
    df = df.withColumns({"reason": reason, "quantity": F.when(reason.isNull(), F.col("quantity")).otherwise(0)})
    return slice_orders(df, slices).drop("allowed_quantity", "breaker_reason", "limit_reason", "margin_reason", "margin_approved")
