"""Portfolio briefings and position clean-up for all accounts at once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilake.functions.portfolio import cost_basis, day_pnl, is_cash, prev_value, unrealized
from equilake.functions.scalars import as_double, nonzero, pct, pct_change, safe_div, sector_fund
from equilake.operators.indicators import previous_close
from equilake.operators.latest import latest_row, top_n_per_key
from equilake.operators.state import latest_holdings
from equilake.session import store

STALE_PRICE_DAYS = 3


def preferred_valuation(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per model, then the DCF if there is one, else the newest other model."""
    newest = latest_row(snapshots, ["symbol", "model_type"], ["created_at"])
    order = [F.desc(F.col("model_type") == "dcf"), F.desc("created_at"), F.asc("model_type")]
    return top_n_per_key(newest, ["symbol"], order, 1)


def symbol_facts(warehouse, decisions: DataFrame, symbols: DataFrame) -> DataFrame:
    """Everything a holding row needs about its symbol, one row for each of ``symbols`` (distinct).

    Every source is cut to those symbols before it is sorted or combined, so asking for one account reads the market
    once and shuffles little of it. Each part is grouped by symbol at its end, so Spark sees that it can't multiply rows
    and leaves out the parts whose columns nobody asks for.
    """
    def asked(name: str) -> DataFrame:
        return warehouse[name].join(symbols, "symbol", "left_semi")

    prices = previous_close(asked("daily_prices"))
    ratios = asked("financial_ratios").filter("period = 'FY'").groupBy("symbol").agg(
        F.max(F.struct("fiscal_date", "pe_ratio", "peg_ratio", "return_on_equity", "net_margin")).alias("_r")).select("symbol", "_r.*").drop("fiscal_date")
    value = preferred_valuation(asked("valuation_snapshots")).groupBy("symbol").agg(
        F.max(F.struct("model_type", "as_of", "fair_value_per_share", "upside_pct")).alias("valuation"))
    news = asked("news_items").groupBy("symbol").agg(
        F.max(F.struct("published_at", "url", "headline")).alias("latest_news"))
    decided = decisions.join(symbols, "symbol", "left_semi").groupBy("symbol").agg(F.max(
        F.struct("created_at", "decision_id", "side", "opened_at", "price_at_open", "confidence")).alias("decision"))
    out = symbols
    for part in (warehouse["profiles"].select("symbol", "sector"), prices, ratios, value, news, decided):
        out = out.join(part, "symbol", "left")
    return out


def holdings_view(warehouse, decisions: DataFrame, account: str | None = None, as_of: dt.date | None = None) -> DataFrame:
    """One row per current holding with market data, P&L and research context."""
    # Read by the rows, the totals and the list of symbols that cuts every source.
    held = store(latest_holdings(warehouse["holdings"], account, as_of), "held")
    symbols = store(held.select("symbol").distinct(), "symbols")
    df = held.join(symbol_facts(warehouse, decisions, symbols), "symbol", "left")
    df = df.withColumn("unrealized", unrealized())
    df = df.withColumns({
        "cost": cost_basis(), "day_change_pct": pct_change("latest_close", "prev_close"), "day_pnl": day_pnl(), "prev_value": prev_value()})
    totals = held.groupBy("account_id").agg(F.sum("market_value").alias("total_mv"))
    df = df.join(totals, "account_id", "left")
    return df.select(
        "account_id", "symbol", "as_of_date", "sector", "asset_category", "currency", "side", "quantity", "market_value",
        pct("market_value", "total_mv").alias("weight_pct"), "avg_cost", "cost", F.col("unrealized").alias("unrealized_pnl"),
        pct("unrealized", "cost").alias("unrealized_pnl_pct"), "latest_close", "prev_close", "price_date", "day_change_pct", "day_pnl", "prev_value",
        "pe_ratio", "peg_ratio", "return_on_equity", "net_margin", "valuation", "latest_news", "decision", "total_mv")


def sector_exposure(view: DataFrame) -> DataFrame:
    """Signed market value, weight, count and benchmark fund per (account, sector)."""
    grouped = view.groupBy("account_id", "sector").agg(
        F.sum("market_value").alias("market_value"), F.count(F.lit(1)).alias("holdings"), F.max("total_mv").alias("total_mv"))
    return grouped.select(
        "account_id", "sector", sector_fund("sector").alias("etf"), "market_value", pct("market_value", "total_mv").alias("weight_pct"), "holdings")


def portfolio_summary(view: DataFrame) -> DataFrame:
    """Totals per account. The currency is the most frequent one (ties: alphabetical)."""
    per_currency = view.groupBy("account_id", "currency").agg(
        F.count(F.lit(1)).alias("c"),
        *[F.sum(x).alias(x) for x in ("market_value", "unrealized_pnl", "cost", "day_pnl", "prev_value")],
        F.sum(F.when(is_cash(), F.col("market_value"))).alias("cash"), F.count_if(F.col("decision").isNotNull()).alias("decided"),
        F.max(is_cash()).alias("has_cash"), F.max("as_of_date").alias("as_of_date"))
    named = F.when(F.col("currency").isNotNull(), F.struct(-F.col("c"), F.col("currency")))
    total = per_currency.groupBy("account_id").agg(
        F.sum("c").alias("holdings_count"), F.max("as_of_date").alias("as_of_date"), F.sum("market_value").alias("total_market_value"),
        F.sum("unrealized_pnl").alias("total_unrealized_pnl"), F.sum("cost").alias("_cost"), F.sum("day_pnl").alias("day_pnl"),
        F.sum("prev_value").alias("_prev"), F.sum("cash").alias("cash"), F.min_by("currency", named).alias("currency"),
        F.count("currency").alias("currencies"), F.sum("decided").alias("decided_positions"), F.max("has_cash").alias("has_cash"))
    return total.select(
        "account_id", "as_of_date", "holdings_count", "total_market_value", "total_unrealized_pnl",
        pct("total_unrealized_pnl", nonzero("_cost")).alias("total_unrealized_pnl_pct"), "day_pnl", pct("day_pnl", nonzero("_prev")).alias("day_pnl_pct"),
        "cash", "currency", "currencies", "decided_positions", "has_cash")


def movers(view: DataFrame, by: str = "day_change_pct", n: int = 3) -> DataFrame:
    """Top and bottom n holdings per account by a measure, with their rank; NULLs take no part."""
    rows = view.filter(F.col(by).isNotNull()).select("account_id", "symbol", "day_change_pct", "day_pnl", "market_value")
    top = top_n_per_key(rows, ["account_id"], [F.desc(by), F.asc("symbol")], n, rank="rank").withColumn("list", F.lit("top"))
    bottom = top_n_per_key(rows, ["account_id"], [F.asc(by), F.desc("symbol")], n, rank="rank").withColumn("list", F.lit("bottom"))
    return top.unionByName(bottom)


def briefing_notes(view: DataFrame, summary: DataFrame, today: dt.date) -> DataFrame:
    """Data caveats as rows: stale prices per holding, and account-level notes."""
    stale = view.filter(F.datediff(F.lit(today), "price_date") > STALE_PRICE_DAYS).select(
        "account_id", "symbol", F.concat(F.lit("latest price "), F.col("price_date").cast("string"), F.lit(" is stale")).alias("note"))
    flags = F.array_compact(F.array(
        F.when(F.col("cash").isNull(), "no cash position is reported"),
        F.when(F.col("currencies") > 1, "market values of several currencies are added without conversion"),
        F.when(F.col("has_cash"), "the day's P&L leaves cash out")))
    account = summary.select("account_id", F.lit(None).cast("string").alias("symbol"), F.explode(flags).alias("note"))
    return stale.unionByName(account)


def morning_call(warehouse, decisions: DataFrame, today: dt.date, account: str | None = None, as_of: dt.date | None = None) -> dict[str, DataFrame]:
    """The briefing as tables keyed by account: holdings, summary, sectors, movers, contributors, notes."""
    view = holdings_view(warehouse, decisions, account, as_of)
    summary = portfolio_summary(view)
    return {
        "holdings": view, "summary": summary, "sectors": sector_exposure(view), "movers": movers(view),
        "contributors": movers(view, "day_pnl"), "notes": briefing_notes(view, summary, today),
    }


# ----- broker lots ----------------------------------------------------------------------------

LOT_KEY = ("accountId", "symbol", "reportDate")
_MONEY = ("positionValue", "costBasisMoney")


def _doubles_half(value: Column, total: Column) -> Column:
    """True when one row equals the sum of all the others."""
    return F.abs(value * 2 - total) < F.greatest(F.lit(1e-6), F.abs(total) * 1e-9)


def collapse_lots(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per (account, symbol, date) of broker attribute rows.

    A declared SUMMARY row is kept; else a row whose position and money both equal the sum of the
    other rows; else the lots are added up. ``order`` is a total order that decides "first".

    A row is moved once, as it came, to the task of its group. The totals are a window's, which keeps a large group on disk and no
    array of it; the aggregate reads the window's order. The lots themselves stay in ``rows``.
    """
    keys = [F.coalesce(F.col(k), F.lit("")) for k in LOT_KEY]
    names = [f"_k{i}" for i in range(len(LOT_KEY))]
    fields = rows.columns
    numeric = ("position", *_MONEY, "fifoPnlUnrealized", "percentOfNAV", "costBasisPrice")
    # Numbers and keys are derived after the shuffle, so they take no room in it.
    df = rows.repartition(*keys).select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], "*", *[as_double(c).alias(f"n_{c}") for c in numeric])
    whole, at = F.struct(*fields), F.struct(*order)
    is_summary = F.upper(F.coalesce("levelOfDetail", F.lit(""))) == "SUMMARY"
    weighted = F.col("n_position") * F.col("n_costBasisPrice")
    totals = {
        "lots": F.count(F.lit(1)), "has_summary": F.max(is_summary), **{f"t_{c}": F.sum(f"n_{c}") for c in numeric},
        "t_weighted": F.sum(weighted), "t_weight": F.sum(F.when(weighted.isNotNull(), F.col("n_position")))}
    group = Window.partitionBy(*names)
    df = df.withColumns({n: c.over(group) for n, c in {**totals, **{f"c_{c}": F.count(f"n_{c}") for c in ("position", *_MONEY)}}.items()})
    match = (F.col("lots") > 1) & ~F.col("has_summary") & (F.col("c_position") == F.col("lots")) & _doubles_half(F.col("n_position"), F.col("t_position"))
    for c in _MONEY:
        match = match & ((F.col(f"c_{c}") < F.col("lots")) | _doubles_half(F.col(f"n_{c}"), F.col(f"t_{c}")))
    df = df.groupBy(*names).agg(
        F.min_by(whole, at).alias("head"), F.min_by(whole, F.when(is_summary, at)).alias("summary"), F.min_by(whole, F.when(match, at)).alias("implicit"),
        *[F.max(n).alias(n) for n in totals])
    quantity = F.coalesce("t_position", F.lit(0.0))
    average = F.coalesce(
        F.when(quantity != 0, safe_div("t_costBasisMoney", quantity)),
        F.when(F.col("t_costBasisMoney").isNull() | (quantity == 0), safe_div("t_weighted", "t_weight")))
    side = F.when(quantity > 0, "Long").when(quantity < 0, "Short").otherwise(F.col("head.side"))
    replaced = {
        "position": quantity, "positionValue": F.col("t_positionValue"), "costBasisMoney": F.col("t_costBasisMoney"), "costBasisPrice": average,
        "fifoPnlUnrealized": F.col("t_fifoPnlUnrealized"), "percentOfNAV": F.col("t_percentOfNAV"), "side": side}
    added = F.struct(*[(replaced[c].cast("string") if c in replaced else F.col(f"head.{c}")).alias(c) for c in fields])
    chosen = F.when(F.col("lots") == 1, F.col("head")).when(F.col("has_summary"), F.col("summary")).when(
        F.col("implicit").isNotNull(), F.col("implicit")).otherwise(added)
    rule = F.when(F.col("lots") == 1, "single").when(F.col("has_summary"), "summary").when(
        F.col("implicit").isNotNull(), "implicit_summary").otherwise("added_up")
    return df.select(chosen.alias("r"), "lots", rule.alias("rule")).select("r.*", "lots", "rule")
