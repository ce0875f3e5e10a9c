"""Company research: scores, quality, history, technical snapshot, filings, earnings, bundles."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilake.functions.scalars import (
    excerpt, macd_bias, market_cap, near_extreme, net_revenue, raw_value, rsi_zone, safe_div, stock_type, surprise_pct, trend_bias,
)
from equilake.functions.scores import altman_struct, piotroski_struct, ratio
from equilake.operators import indicators as ind
from equilake.operators.latest import latest_row, top_n_per_key
from equilake.operators.recurrence import Recurrence, with_recurrences
from equilake.operators.state import combine_year
from equilake.plans.valuation import annual, wacc

TECHNICAL_WINDOW, MIN_BARS, EVENT_LOOKBACK = 252, 50, 60


def kinds(profiles: DataFrame) -> DataFrame:
    return profiles.select("symbol", stock_type("sector", "industry").alias("stock_type"))


# ----- small aggregates -----------------------------------------------------------------------


def trend(value: Column | str, order: str = "fiscal_date") -> Column:
    """Aggregate: first, last, change, direction and count of the non-null values; NULL below two."""
    v = F.col(value) if isinstance(value, str) else value
    at = F.when(v.isNotNull(), F.col(order))
    first, last, n = F.min_by(v, at), F.max_by(v, at), F.count(v)
    change = last - first
    direction = F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    return F.when(n >= 2, F.struct(
        first.alias("first"), last.alias("last"), change.alias("change"), direction.alias("direction"), n.alias("n")))


def percentile_vs_history(ratios: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Share of earlier annual values strictly below the newest non-null one; needs three points."""
    rows = top_n_per_key(annual(ratios), ["symbol"], [F.desc("fiscal_date")], n)
    pts = F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("fiscal_date", F.col(column).alias("v")))))
    packed = rows.groupBy("symbol").agg(F.transform(pts, lambda p: p["v"]).alias("pts"))
    last = F.try_element_at("pts", F.lit(-1))
    history = F.slice("pts", 1, F.greatest(F.size("pts") - 1, F.lit(0)))
    below = F.size(F.filter(history, lambda v: v < last))
    return packed.select(
        "symbol", F.when(F.size("pts") >= 3, below / F.size(history) * 100).alias("percentile"), F.size("pts").alias("points"), "pts")


def zone_days(df: DataFrame, col: str = "rsi14", low: float = 30.0, high: float = 70.0, lookback: int = EVENT_LOOKBACK) -> DataFrame:
    """Days of the last ``lookback`` bars outside the neutral zone, one row each."""
    zone = F.when(F.col(col) < low, "oversold").when(F.col(col) > high, "overbought")
    return ind.with_age(df).filter(F.col("age") <= lookback).select("symbol", "trade_date", zone.alias("zone")).filter("zone is not null")


# ----- scores and quality ---------------------------------------------------------------------


def scores_section(warehouse) -> DataFrame:
    """Piotroski and Altman from the two newest years; both are declared not applicable to banks."""
    years = combine_year(warehouse["income_statement"], warehouse["balance_sheet"], warehouse["cash_flow"])
    fields = [c for c in years.columns if c not in ("symbol", "year")]
    ranked = top_n_per_key(years, ["symbol"], [F.desc("year")], 2, rank="rn")
    packed = F.struct("year", *fields)
    pair = ranked.groupBy("symbol").agg(
        F.max(F.when(F.col("rn") == 1, packed)).alias("cur"), F.max(F.when(F.col("rn") == 2, packed)).alias("prev"))
    df = pair.join(kinds(warehouse["profiles"]), "symbol", "full_outer")
    bank = F.coalesce(F.col("stock_type") == "bank", F.lit(False))
    has_prev = F.col("prev").isNotNull()
    return df.filter(bank | F.col("cur").isNotNull()).select(
        "symbol", F.when(bank, "bank").otherwise("general").alias("template"),
        F.when(~bank, F.col("cur.year")).alias("fiscal_year"), F.when(~bank, F.col("prev.year")).alias("prior_fiscal_year"),
        F.when(~bank & has_prev, piotroski_struct()).alias("piotroski_f"), F.when(~bank, altman_struct()).alias("altman_z"),
        F.when(bank, F.array(F.lit("piotroski_f"), F.lit("altman_z"))).alias("not_applicable"))


def quality_section(warehouse, n: int = 6) -> DataFrame:
    """General or bank quality metrics with trends over the newest n years."""
    inc = top_n_per_key(annual(warehouse["income_statement"]), ["symbol"], [F.desc("fiscal_date")], n, rank="rn")
    trends = inc.groupBy("symbol").agg(
        F.max(F.when(F.col("rn") == 1, F.struct("revenue", "net_income", "raw"))).alias("inc"),
        trend("revenue").alias("revenue_trend"), trend(ratio("gross_profit", "revenue")).alias("gross_margin_trend"),
        trend(ratio("operating_income", "revenue")).alias("operating_margin_trend"), trend(ratio("net_income", "revenue")).alias("net_margin_trend"))
    bal = top_n_per_key(annual(warehouse["balance_sheet"]), ["symbol"], [F.desc("fiscal_date")], 2, rank="rn").groupBy("symbol").agg(
        F.max(F.when(F.col("rn") == 1, F.struct("total_assets", "total_equity"))).alias("bal"),
        F.max(F.when(F.col("rn") == 2, F.col("total_assets"))).alias("prev_assets"))
    cash = latest_row(annual(warehouse["cash_flow"]), ["symbol"], ["fiscal_date"]).select("symbol", "free_cash_flow", "operating_cash_flow")
    rat = top_n_per_key(annual(warehouse["financial_ratios"]), ["symbol"], [F.desc("fiscal_date")], n, rank="rn").groupBy("symbol").agg(
        F.max(F.when(F.col("rn") == 1, F.col("return_on_invested_capital"))).alias("roic"),
        trend("return_on_invested_capital").alias("roic_trend"))
    prof = warehouse["profiles"].select("symbol", "beta", stock_type("sector", "industry").alias("stock_type"))
    df = trends
    for part in (bal, cash, rat, prof):
        df = df.join(part, "symbol", "left")
    bank = F.coalesce(F.col("stock_type") == "bank", F.lit(False))

    def general(c: Column) -> Column:
        return F.when(~bank, c)

    def only_bank(c: Column) -> Column:
        return F.when(bank, c)

    ni, assets, equity = F.col("inc.net_income"), F.col("bal.total_assets"), F.col("bal.total_equity")
    cost_of_capital = wacc("beta")
    nii, interest = raw_value("inc.raw", "netInterestIncome"), raw_value("inc.raw", "interestIncome")
    other_income = F.col("inc.revenue") - interest
    expense = raw_value("inc.raw", "operatingExpenses")
    return df.select(
        "symbol", F.when(bank, "bank").otherwise("general").alias("template"),
        general(F.col("roic")).alias("roic"), general(cost_of_capital).alias("wacc"), general(F.col("roic") - cost_of_capital).alias("roic_wacc_spread"),
        general(ratio("free_cash_flow", ni)).alias("fcf_conversion"), general(ratio(ni - F.col("operating_cash_flow"), assets)).alias("accruals_ratio"),
        only_bank(ratio(ni, assets)).alias("roa"), only_bank(ratio(ni, equity)).alias("roe"),
        only_bank(ratio(nii, (assets + F.col("prev_assets")) / 2)).alias("net_interest_margin"),
        only_bank(ratio(expense, nii + other_income)).alias("efficiency_ratio"), only_bank(ratio(equity, assets)).alias("equity_to_assets"),
        "revenue_trend", general(F.col("gross_margin_trend")).alias("gross_margin_trend"),
        general(F.col("operating_margin_trend")).alias("operating_margin_trend"), general(F.col("net_margin_trend")).alias("net_margin_trend"),
        general(F.col("roic_trend")).alias("roic_trend"),
        only_bank(F.array(F.lit("tier_1_capital_ratio"), F.lit("npl_ratio"))).alias("missing_fields"),
        only_bank(F.array(*[F.lit(x) for x in (
            "roic_wacc_spread", "fcf_conversion", "accruals_ratio", "gross_margin_trend", "operating_margin_trend", "net_margin_trend")]))
        .alias("not_applicable"))


def ratio_history(ratios: DataFrame, n: int = 10) -> DataFrame:
    """Annual multiples oldest first, and where the newest ranks in its own history."""
    names = ("pe_ratio", "ev_to_ebitda", "price_to_sales", "price_to_book")
    rows = top_n_per_key(annual(ratios), ["symbol"], [F.desc("fiscal_date")], n)
    ordered = F.sort_array(F.collect_list(F.struct("fiscal_date", *names, "fcf_yield")))
    packed = rows.groupBy("symbol").agg(ordered.alias("multiples"))

    def rank(name: str) -> Column:
        pts = F.filter(F.transform("multiples", lambda m: m[name]), lambda v: v.isNotNull())
        history = F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0)))
        below = F.size(F.filter(history, lambda v: v < F.try_element_at(pts, F.lit(-1))))
        return F.when(F.size(pts) >= 3, below / F.size(history) * 100)

    return packed.withColumn("percentile", F.struct(*[rank(x).alias(x) for x in names]))


# ----- technical snapshot ---------------------------------------------------------------------


def technical_snapshot(prices: DataFrame, window: int = TECHNICAL_WINDOW) -> DataFrame:
    """One row per symbol over its last ``window`` bars: price action, trend, momentum, MACD, volume, labels.

    Indicators start at the window's first bar. Below 50 bars only the bar count is reported.
    """
    last = top_n_per_key(prices, ["symbol"], [F.desc("trade_date")], window, rank="age").withColumn(
        "raw_px", F.coalesce("adj_close", "close"))
    last = last.withColumn("px", ind.filled(F.col("raw_px"))).withColumn("vol", F.coalesce(F.col("volume").cast("double"), F.lit(0.0)))
    last = last.withColumn("bars", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    # A symbol without any price gives nothing at all.
    enough = last.filter((F.col("bars") >= MIN_BARS) & F.col("px").isNotNull())
    df = with_recurrences(
        enough, [Recurrence("rsi14", "rsi", "px"), Recurrence("macd", "macd", "px")], keep=("px", "vol", "age", "bars", "adj_close"))
    df = ind.with_sma(df, "px", {"sma20": 20, "sma50": 50, "sma200": 200})
    df = ind.with_sma(df, "vol", {"avg_volume": 20})
    df = ind.with_drawdown(df, "px")
    df = df.withColumns({
        "up_20_50": ind.cross_flag("sma20", "sma50", "up", rounding=ind.SMA_ROUNDING), "down_20_50": ind.cross_flag("sma20", "sma50", "down", rounding=ind.SMA_ROUNDING),
        "up_50_200": ind.cross_flag("sma50", "sma200", "up", rounding=ind.SMA_ROUNDING), "down_50_200": ind.cross_flag("sma50", "sma200", "down", rounding=ind.SMA_ROUNDING),
        "up_macd": ind.cross_flag("macd_line", "macd_signal", "up"), "down_macd": ind.cross_flag("macd_line", "macd_signal", "down"),
        "peak_date": F.min("trade_date").over(Window.partitionBy("symbol", "peak")),
        "bar_no": F.col("bars") - F.col("age") + 1,
    })
    newest = F.col("age") == 1
    recent = F.col("age") <= EVENT_LOOKBACK

    def now(c: str) -> Column:
        return F.max(F.when(newest, F.col(c)))

    def at_age(c: str, age: Column | int) -> Column:
        return F.max(F.when(F.col("age") == age, F.col(c)))

    def event(flag: str, limit: Column) -> Column:
        return F.max(F.when(limit & F.col(flag), F.col("trade_date")))

    spike = (F.col("age") <= 30) & (F.col("bar_no") > 20) & (F.col("avg_volume") != 0) & (F.col("vol") > 2.0 * F.col("avg_volume"))
    spike_row = F.struct("trade_date", F.col("vol").cast("bigint").alias("volume"), safe_div("vol", "avg_volume").alias("multiple"))
    agg = df.groupBy("symbol").agg(
        F.max("bars").alias("bars"), F.min("trade_date").alias("oldest_trade_date"), F.max("trade_date").alias("latest_trade_date"),
        F.max(F.col("adj_close").isNotNull()).alias("adj_close_used"), now("px").alias("latest_close"),
        at_age("px", 127).alias("px_6m"), at_age("px", F.col("bars")).alias("px_1y"),
        F.max("px").alias("high_52w"), F.min_by("trade_date", F.struct(-F.col("px"), F.col("trade_date"))).alias("high_52w_date"),
        F.min("px").alias("low_52w"), F.min_by("trade_date", F.struct(F.col("px"), F.col("trade_date"))).alias("low_52w_date"),
        F.min_by(F.struct("drawdown", "peak_date", "trade_date"), F.struct("drawdown", "trade_date")).alias("dd"),
        *[now(c).alias(c) for c in ("sma20", "sma50", "sma200", "rsi14", "macd_line", "macd_signal", "macd_hist", "avg_volume", "vol")],
        event("up_50_200", F.lit(True)).alias("golden_50_200"), event("down_50_200", F.lit(True)).alias("death_50_200"),
        event("up_20_50", recent).alias("up_20_50"), event("down_20_50", recent).alias("down_20_50"),
        event("up_macd", recent).alias("golden_macd"), event("down_macd", recent).alias("death_macd"),
        F.sort_array(F.collect_list(F.when(recent & (F.col("rsi14") < 30), F.col("trade_date")))).alias("oversold_days"),
        F.sort_array(F.collect_list(F.when(recent & (F.col("rsi14") > 70), F.col("trade_date")))).alias("overbought_days"),
        F.sort_array(F.collect_list(F.when(spike, spike_row))).alias("spike_days"))

    def vs(level: str) -> Column:
        return (safe_div("latest_close", level) - 1) * 100

    def change(base: str) -> Column:
        return F.when(F.col(base) > 0, (safe_div("latest_close", base) - 1) * 100)

    deep = F.col("dd.drawdown") * 100 < -1e-9
    up_wins = F.col("up_20_50").isNotNull() & (F.col("down_20_50").isNull() | (F.col("up_20_50") >= F.col("down_20_50")))
    cross = F.when(up_wins, F.struct(F.col("up_20_50").alias("date"), F.lit("up").alias("direction"))).when(
        F.col("down_20_50").isNotNull(), F.struct(F.col("down_20_50").alias("date"), F.lit("down").alias("direction")))
    zone = rsi_zone("rsi14")
    full = agg.select(
        "symbol", F.lit(False).alias("insufficient_data"), F.col("bars").cast("int").alias("bars"), "oldest_trade_date", "latest_trade_date", "adj_close_used",
        F.struct(
            "latest_close", change("px_6m").alias("return_6m_pct"), change("px_1y").alias("return_1y_pct"), "high_52w", "high_52w_date", "low_52w",
            "low_52w_date", vs("high_52w").alias("pct_below_52w_high"), vs("low_52w").alias("pct_above_52w_low"),
            F.when(deep, F.col("dd.drawdown") * 100).otherwise(0.0).alias("max_drawdown_pct"),
            F.when(deep, F.col("dd.peak_date")).alias("max_drawdown_peak_date"), F.when(deep, F.col("dd.trade_date")).alias("max_drawdown_trough_date"),
        ).alias("price_action"),
        F.struct(
            "sma20", vs("sma20").alias("price_vs_sma20_pct"), "sma50", vs("sma50").alias("price_vs_sma50_pct"), "sma200",
            vs("sma200").alias("price_vs_sma200_pct"), F.col("golden_50_200").alias("last_golden_cross_50_200"),
            F.col("death_50_200").alias("last_death_cross_50_200"), cross.alias("last_cross_20_50")).alias("trend"),
        F.struct(F.col("rsi14").alias("rsi14_latest"), zone.alias("rsi14_zone"), "oversold_days", "overbought_days").alias("momentum"),
        F.struct(
            F.col("macd_line").alias("line"), F.col("macd_signal").alias("signal"), F.col("macd_hist").alias("histogram"),
            F.col("golden_macd").alias("last_golden_cross_60d"), F.col("death_macd").alias("last_death_cross_60d")).alias("macd"),
        F.struct(
            F.col("avg_volume").alias("avg_volume_20d"), F.col("vol").cast("bigint").alias("latest_volume"),
            safe_div("vol", "avg_volume").alias("latest_vs_avg"), "spike_days").alias("volume"),
        F.struct(
            trend_bias("sma20", "sma50", "sma200").alias("trend_bias"), zone.alias("momentum_bias"),
            macd_bias("macd_line", "macd_signal", "macd_hist").alias("macd_bias"),
            near_extreme(vs("high_52w"), vs("low_52w")).alias("near_52w_extreme")).alias("signal_summary"))
    short = last.groupBy("symbol").agg(F.max("bars").cast("int").alias("bars")).filter(F.col("bars") < MIN_BARS)
    return full.unionByName(short.withColumn("insufficient_data", F.lit(True)), allowMissingColumns=True)


# ----- filings, news, estimates ---------------------------------------------------------------


def insider_summary(tx: DataFrame, as_of: dt.date, days: int = 180) -> DataFrame:
    """Open-market buys (P) and sales (S) within the lookback; other codes count only in the total."""
    rows = tx.filter(F.col("transaction_date") >= F.lit(as_of - dt.timedelta(days=days)))
    code = F.upper(F.col("code"))

    def total(c: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when(code == c, F.col(name))), F.lit(0.0))

    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("transactions"), F.count_if(code == "P").alias("open_market_buys"), F.count_if(code == "S").alias("open_market_sells"),
        total("P", "shares").alias("buy_shares"), total("S", "shares").alias("sell_shares"),
        (total("P", "value") - total("S", "value")).alias("net_open_market_value"), F.max("filing_date").alias("last_filing_date"))


def insider_recent(tx: DataFrame, as_of: dt.date, days: int = 180, n: int = 8) -> DataFrame:
    rows = tx.filter(F.col("transaction_date") >= F.lit(as_of - dt.timedelta(days=days)))
    return top_n_per_key(rows, ["symbol"], [F.desc("transaction_date"), F.asc("accession_no"), F.asc("line_no")], n, rank="rn")


def earnings_surprise(income: DataFrame, estimates: DataFrame, profiles: DataFrame, limit: int = 4) -> DataFrame:
    """Newest ``limit`` reported periods against consensus of the same key; banks compare net revenue."""
    rows = top_n_per_key(income, ["symbol"], [F.desc("fiscal_date"), F.asc("period")], limit)
    keys = ["symbol", "fiscal_date", "period"]
    est = estimates.select(
        *keys, "eps_avg", "revenue_avg", "ebitda_avg", F.col("net_income_avg"), "num_analysts_eps", "num_analysts_revenue", F.lit(True).alias("_est"))
    df = rows.join(est, keys, "left").join(kinds(profiles), "symbol", "left")
    eps = F.coalesce("eps_diluted", "eps")
    revenue = net_revenue("revenue", "raw", F.coalesce("stock_type", F.lit("general")))
    return df.select(
        *keys, F.col("known_at").alias("filed_at"), "reported_currency", "revenue", "net_income", "eps", "eps_diluted", "gross_profit", "operating_income",
        F.when(F.col("stock_type") == "bank", revenue).alias("revenue_net"), F.coalesce("_est", F.lit(False)).alias("estimate_available"),
        "eps_avg", "revenue_avg", "ebitda_avg", "net_income_avg", "num_analysts_eps", "num_analysts_revenue",
        (eps - F.col("eps_avg")).alias("eps_beat"), surprise_pct(eps, "eps_avg").alias("eps_surprise_pct"),
        (revenue - F.col("revenue_avg")).alias("revenue_beat"), surprise_pct(revenue, "revenue_avg").alias("revenue_surprise_pct"))


def _packed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, fields: Sequence[str], out: str) -> DataFrame:
    """The first n rows of each key as an array of structs: bounded by n whatever the key holds."""
    ranked = top_n_per_key(df, keys, order, n, rank="_r")
    rows = F.sort_array(F.collect_list(F.struct("_r", *fields)))
    packed = ranked.groupBy(*keys).agg(rows.alias(out))
    return packed.withColumn(out, F.transform(out, lambda s: F.struct(*[s[f].alias(f) for f in fields])))


def earnings_read(warehouse, decisions: DataFrame, limit: int = 4, decision_limit: int = 5) -> DataFrame:
    """Per symbol: recent periods with surprise, how many had estimates, and the newest recorded theses."""
    periods = earnings_surprise(warehouse["income_statement"], warehouse["analyst_estimates"], warehouse["profiles"], limit)
    fields = ["period", "fiscal_date", "filed_at", "revenue", "revenue_net", "eps", "eps_diluted", "net_income", "estimate_available", "eps_avg", "revenue_avg",
              "eps_beat", "eps_surprise_pct", "revenue_beat", "revenue_surprise_pct"]
    packed = F.reverse(F.sort_array(F.collect_list(F.struct("fiscal_date", F.struct(*fields).alias("p")))))
    read = periods.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("periods_found"), F.count_if("estimate_available").alias("estimates_matched"), packed.alias("_p"))
    read = read.withColumn("periods", F.transform("_p", lambda s: s["p"])).drop("_p")
    thesis = _packed(
        decisions, ["symbol"], [F.desc("created_at"), F.asc("decision_id")], decision_limit,
        ["decision_id", "side", "opened_at", "price_at_open", "confidence", "thesis", "sector_at_open", "tags"], "decisions")
    read = read.join(thesis, "symbol", "full_outer")
    note = F.when(F.col("periods_found").isNull(), F.lit("no financial statements"))
    return read.withColumns({
        "periods_found": F.coalesce("periods_found", F.lit(0)), "estimates_matched": F.coalesce("estimates_matched", F.lit(0)),
        "thesis_count": F.coalesce(F.size("decisions"), F.lit(0)), "notes": F.array_compact(F.array(note))})


def latest_transcript(transcripts: DataFrame) -> DataFrame:
    newest = latest_row(transcripts, ["symbol"], ["year", "quarter"])
    return newest.select("symbol", "year", "quarter", "call_date", excerpt("content").alias("excerpt"))


# ----- the bundle -----------------------------------------------------------------------------

STATEMENT_SKIP = ("symbol", "period", "fiscal_date", "calendar_year", "reported_currency", "raw", "known_at")


def recent_statements(df: DataFrame, out: str, n: int = 5, bank_net: DataFrame | None = None) -> DataFrame:
    """Newest n statements, annual and quarterly mixed, as an array."""
    fields = ["period", "fiscal_date", "reported_currency", *[c for c in df.columns if c not in STATEMENT_SKIP]]
    if bank_net is not None:
        df = df.join(bank_net, "symbol", "left")
        kind = F.coalesce("stock_type", F.lit("general"))
        df = df.withColumn("revenue_net", F.when(kind == "bank", net_revenue("revenue", "raw", kind)))
        fields.append("revenue_net")
    return _packed(df, ["symbol"], [F.desc("fiscal_date"), F.asc("period")], n, fields, out)


def research_bundles(warehouse, as_of: dt.date, symbols: DataFrame | None = None, news_limit: int = 10) -> DataFrame:
    """One nested row per symbol with every section whose size is bounded by construction.

    Holdings have one entry per account and no bound, so they stay a table: ``bundle_holdings``.
    """
    members = (symbols if symbols is not None else warehouse["universe"]).select("symbol").distinct()

    def mine(name: str) -> DataFrame:
        return warehouse[name].join(members, "symbol", "left_semi")

    prof = mine("profiles")
    profile = prof.select("symbol", F.struct(
        "company_name", "sector", "industry", "exchange", "currency", "country", "beta", "ipo_date", "is_etf", "is_fund", "is_adr", "is_actively_trading",
        market_cap("raw").alias("market_cap"), stock_type("sector", "industry").alias("stock_type")).alias("profile"))
    price = latest_row(mine("daily_prices"), ["symbol"], ["trade_date"]).select(
        "symbol", F.struct("trade_date", "open", "high", "low", "close", "adj_close", "volume").alias("latest_price"))
    ratios = mine("financial_ratios")
    ratio_cols = [c for c in ratios.columns if c not in ("symbol", "period", "raw", "known_at")]
    annual_ratios = latest_row(annual(ratios), ["symbol"], ["fiscal_date"]).select("symbol", F.struct(*ratio_cols).alias("ratios_latest_annual"))
    forward = _packed(
        mine("analyst_estimates").filter(F.col("fiscal_date") >= F.lit(as_of)), ["symbol"], [F.asc("fiscal_date"), F.asc("period")], 4,
        ["fiscal_date", "period", "revenue_avg", "eps_avg", "ebitda_avg", "net_income_avg", "num_analysts_revenue", "num_analysts_eps"], "estimates_forward")
    snapshots = latest_row(mine("valuation_snapshots"), ["symbol", "model_type"], ["created_at"])
    valuations = snapshots.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(
        "model_type", "snapshot_id", "as_of", "fair_value_per_share", "current_price", "upside_pct"))).alias("valuation_snapshots"))
    scoped = warehouse.with_tables(**{t: mine(t) for t in (
        "profiles", "income_statement", "balance_sheet", "cash_flow", "financial_ratios")})
    scores = scores_section(scoped)
    quality = quality_section(scoped)
    history = ratio_history(ratios)
    technical = technical_snapshot(mine("daily_prices"))

    def nested(df: DataFrame, out: str) -> DataFrame:
        return df.select("symbol", F.struct(*[c for c in df.columns if c != "symbol"]).alias(out))

    tx = mine("insider_transactions")
    recent = _packed(
        tx.filter(F.col("transaction_date") >= F.lit(as_of - dt.timedelta(days=180))), ["symbol"],
        [F.desc("transaction_date"), F.asc("accession_no"), F.asc("line_no")], 8,
        ["transaction_date", "insider", "position", "transaction_type", "code", "shares", "price", "value"], "recent")
    insider = insider_summary(tx, as_of).join(recent, "symbol", "left")
    short = latest_row(mine("short_interest"), ["symbol"], ["settlement_date"]).select("symbol", F.struct(
        "settlement_date", "short_interest", "previous_short_interest", "change_pct", "avg_daily_volume", "days_to_cover").alias("short_interest"))
    news = _packed(mine("news_items"), ["symbol"], [F.desc("published_at"), F.asc("url")], news_limit,
                   ["published_at", "headline", "url", "source", "summary"], "news")
    transcript = nested(latest_transcript(mine("transcripts")), "transcript")
    out = members
    for part in (
        profile, price, annual_ratios,
        recent_statements(mine("income_statement"), "income_statement_recent", bank_net=kinds(prof)),
        recent_statements(mine("balance_sheet"), "balance_sheet_recent"), recent_statements(mine("cash_flow"), "cash_flow_recent"),
        forward, valuations, nested(technical, "technical"), nested(scores, "scores"), nested(quality, "quality"), nested(history, "ratio_history"),
        nested(insider, "insider"), short, news, transcript,
    ):
        out = out.join(part, "symbol", "left")
    return out.withColumn("as_of", F.lit(as_of))


def bundle_holdings(warehouse, symbols: DataFrame | None = None) -> DataFrame:
    """Newest holding per (symbol, account): the section of a bundle that grows with the accounts."""
    members = (symbols if symbols is not None else warehouse["universe"]).select("symbol").distinct()
    rows = warehouse["holdings"].join(members, "symbol", "left_semi")
    newest = latest_row(rows, ["account_id", "symbol"], ["as_of_date"])
    return newest.select("symbol", "account_id", "as_of_date", "quantity", "mark_price", "market_value", "avg_cost", "unrealized_pnl", "side")


