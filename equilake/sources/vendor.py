"""Vendor payloads (JSON held as strings, or attribute rows) to warehouse columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilake.functions.scalars import (
    as_date, as_double, as_long, as_timestamp, raw_text, raw_text_nonblank, raw_value, raw_value_nonzero,
)
from equilake.operators.upsert import first_per_key


def _flag(key: str) -> Column:
    return raw_text("raw", key).try_cast("boolean")


def map_profiles(raw: DataFrame) -> DataFrame:
    """(symbol, raw) to profile columns; the payload is kept."""
    return raw.select(
        "symbol",
        raw_text("raw", "companyName").alias("company_name"), raw_text("raw", "sector").alias("sector"),
        raw_text("raw", "industry").alias("industry"),
        raw_text_nonblank("raw", "exchangeShortName", "exchange").alias("exchange"),
        raw_text("raw", "currency").alias("currency"), raw_text("raw", "country").alias("country"),
        raw_value("raw", "beta").alias("beta"), as_date(raw_text("raw", "ipoDate")).alias("ipo_date"),
        _flag("isEtf").alias("is_etf"), _flag("isFund").alias("is_fund"), _flag("isAdr").alias("is_adr"),
        _flag("isActivelyTrading").alias("is_actively_trading"), "raw",
    )


def map_prices(full: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Bars with the adjusted close joined by date; a usable one in the bar itself wins.

    ``full``: symbol, date, open, high, low, close, volume, adjClose; ``adjusted``: symbol, date, adjClose.
    """
    adj = adjusted.select("symbol", as_date("date").alias("trade_date"), as_double("adjClose").alias("_adj")).filter(
        F.col("trade_date").isNotNull() & F.col("_adj").isNotNull())
    adj = adj.groupBy("symbol", "trade_date").agg(F.max("_adj").alias("_adj"))
    bars = full.select(
        "symbol", as_date("date").alias("trade_date"), *[as_double(c).alias(c) for c in ("open", "high", "low", "close")],
        F.nullif(as_double("adjClose"), F.lit(0.0)).alias("_own"), as_long("volume").alias("volume"),
    ).filter(F.col("trade_date").isNotNull())
    return bars.join(adj, ["symbol", "trade_date"], "left").select(
        "symbol", "trade_date", "open", "high", "low", "close", F.coalesce("_own", "_adj").alias("adj_close"), "volume")


# Statement column -> vendor keys, first usable wins.
STATEMENT_FIELDS = {
    "income": {
        "revenue": ("revenue",), "cost_of_revenue": ("costOfRevenue",), "gross_profit": ("grossProfit",),
        "operating_income": ("operatingIncome",), "net_income": ("netIncome",), "eps": ("eps",),
        "eps_diluted": ("epsdiluted", "epsDiluted"),
    },
    "balance": {
        "total_assets": ("totalAssets",), "total_liabilities": ("totalLiabilities",),
        "total_equity": ("totalEquity", "totalStockholdersEquity"), "cash_and_equivalents": ("cashAndCashEquivalents",),
        "short_term_debt": ("shortTermDebt",), "long_term_debt": ("longTermDebt",), "retained_earnings": ("retainedEarnings",),
        "current_assets": ("totalCurrentAssets",), "current_liabilities": ("totalCurrentLiabilities",),
    },
    "cash": {
        "operating_cash_flow": ("operatingCashFlow", "netCashProvidedByOperatingActivities"),
        "investing_cash_flow": ("investingCashFlow", "netCashUsedForInvestingActivites", "netCashUsedForInvestingActivities"),
        "financing_cash_flow": ("financingCashFlow", "netCashUsedProvidedByFinancingActivities"),
        "capital_expenditure": ("capitalExpenditure",), "free_cash_flow": ("freeCashFlow",), "dividends_paid": ("dividendsPaid",),
    },
}

RATIO_KEYS = {
    "pe_ratio": ("priceToEarningsRatio", "priceEarningsRatio", "peRatio"),
    "peg_ratio": ("priceToEarningsGrowthRatio", "forwardPriceToEarningsGrowthRatio", "pegRatio"),
    "price_to_book": ("priceToBookRatio", "pbRatio"), "price_to_sales": ("priceToSalesRatio",),
    "ev_to_ebitda": ("enterpriseValueMultiple", "enterpriseValueOverEBITDA", "evToEbitda"), "ev_to_sales": ("evToSales",),
    "current_ratio": ("currentRatio",), "debt_to_equity": ("debtToEquityRatio", "debtEquityRatio", "debtToEquity"),
    "return_on_equity": ("returnOnEquity",), "return_on_assets": ("returnOnAssets",),
    "return_on_invested_capital": ("returnOnInvestedCapital",), "gross_margin": ("grossProfitMargin",),
    "operating_margin": ("operatingProfitMargin",), "net_margin": ("netProfitMargin", "bottomLineProfitMargin"),
    "fcf_yield": ("freeCashFlowYield",), "earnings_yield": ("earningsYield",),
    "payout_ratio": ("dividendPayoutRatio", "payoutRatio"),
}
METRIC_KEYS = {
    "return_on_equity": "returnOnEquity", "return_on_assets": "returnOnAssets",
    "return_on_invested_capital": "returnOnInvestedCapital", "fcf_yield": "freeCashFlowYield", "earnings_yield": "earningsYield",
}


def _aliased(keys: tuple[str, ...]) -> Column:
    """One key is read as it is; among aliases a zero or blank gives way to the next, the last stays."""
    if len(keys) == 1:
        return raw_value("raw", keys[0])
    return F.coalesce(raw_value_nonzero("raw", *keys[:-1]), raw_value("raw", keys[-1]))


def map_statements(raw: DataFrame, kind: str) -> DataFrame:
    """(symbol, raw) to statement columns; rows without fiscal date, period or acceptance time drop."""
    mapped = raw.select(
        "symbol", raw_text_nonblank("raw", "period").alias("period"), as_date(raw_text("raw", "date")).alias("fiscal_date"),
        as_long(raw_text("raw", "calendarYear")).cast("int").alias("calendar_year"),
        raw_text("raw", "reportedCurrency").alias("reported_currency"),
        *[_aliased(keys).alias(name) for name, keys in STATEMENT_FIELDS[kind].items()], "raw",
        as_timestamp(raw_text("raw", "acceptedDate")).alias("known_at"),
    )
    return mapped.filter("fiscal_date is not null and period is not null and known_at is not null")


def map_ratios(ratios: DataFrame, metrics: DataFrame) -> DataFrame:
    """Ratios with five columns filled from the metrics feed only where the ratio feed has none.

    Both carry (symbol, period, raw).
    """
    base = ratios.select(
        "symbol", F.coalesce(raw_text_nonblank("raw", "period"), F.col("period")).alias("period"),
        as_date(raw_text("raw", "date")).alias("fiscal_date"), *[_aliased(k).alias(n) for n, k in RATIO_KEYS.items()], "raw",
    ).filter("fiscal_date is not null and period is not null")
    fill = metrics.select(
        "symbol", F.coalesce(raw_text_nonblank("raw", "period"), F.col("period")).alias("period"),
        as_date(raw_text("raw", "date")).alias("fiscal_date"), *[raw_value("raw", k).alias(f"m_{n}") for n, k in METRIC_KEYS.items()],
    )
    fill = first_per_key(fill, ["symbol", "period", "fiscal_date"])
    joined = base.join(fill, ["symbol", "period", "fiscal_date"], "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.col(f"m_{n}")) for n in METRIC_KEYS}).drop(*[f"m_{n}" for n in METRIC_KEYS])


def map_estimates(raw: DataFrame) -> DataFrame:
    """(symbol, request, raw); the period comes from the row, else from the request (annual or quarter)."""
    requested = F.when(F.col("request") == "annual", "FY").otherwise("Q")
    numbers = {
        "revenue_avg": "revenueAvg", "revenue_low": "revenueLow", "revenue_high": "revenueHigh", "eps_avg": "epsAvg",
        "eps_low": "epsLow", "eps_high": "epsHigh", "ebitda_avg": "ebitdaAvg", "net_income_avg": "netIncomeAvg"}
    return raw.select(
        "symbol", as_date(raw_text("raw", "date")).alias("fiscal_date"),
        F.coalesce(raw_text_nonblank("raw", "period"), requested).alias("period"),
        *[raw_value("raw", k).alias(n) for n, k in numbers.items()],
        as_long(raw_text("raw", "numAnalystsRevenue")).cast("int").alias("num_analysts_revenue"),
        as_long(raw_text("raw", "numAnalystsEps")).cast("int").alias("num_analysts_eps"), "raw",
    ).filter("fiscal_date is not null")


def map_transcripts(raw: DataFrame) -> DataFrame:
    """(symbol, quarter_label, segments array<struct<speaker,title,content>>) to one text per call."""
    year = F.substring("quarter_label", 1, 4).try_cast("int")
    quarter = F.substring("quarter_label", 6, 1).try_cast("int")
    spoken = F.filter("segments", lambda s: F.length(s["content"]) > 0)
    line = F.transform(spoken, lambda s: F.trim(F.concat(
        F.coalesce(s["speaker"], F.lit("")), F.lit(" — "), F.coalesce(s["title"], F.lit("")), F.lit(": "), s["content"])))
    return raw.select(
        "symbol", year.alias("year"), quarter.alias("quarter"),
        F.last_day(F.make_date(year, quarter * 3, F.lit(1))).alias("call_date"),
        F.nullif(F.array_join(line, "\n\n"), F.lit("")).alias("content"),
    )


def map_insider(filings: DataFrame, since: Column | None = None) -> DataFrame:
    """(symbol, accession_no, filing_date, lines array) to one row per line; the line number is its position."""
    rows = filings if since is None else filings.filter(F.col("filing_date").isNull() | (F.col("filing_date") >= since))
    line = rows.select("symbol", "accession_no", "filing_date", F.posexplode("lines").alias("line_no", "l"))
    return line.select(
        "symbol", "accession_no", "line_no", "filing_date", as_date("l.date").alias("transaction_date"), "l.insider", "l.position",
        "l.transaction_type", "l.code", as_double("l.shares").alias("shares"), as_double("l.price").alias("price"),
        as_double("l.value").alias("value"), as_double("l.remaining_shares").alias("remaining_shares"),
    )


def map_news(raw: DataFrame) -> DataFrame:
    mapped = raw.select(
        raw_text_nonblank("raw", "symbol").alias("symbol"),
        as_timestamp(raw_text_nonblank("raw", "publishedDate", "date")).alias("published_at"),
        raw_text_nonblank("raw", "url").alias("url"), raw_text_nonblank("raw", "title", "headline").alias("headline"),
        raw_text_nonblank("raw", "site", "source", "publisher").alias("source"),
        raw_text_nonblank("raw", "text", "summary").alias("summary"),
        raw_text_nonblank("raw", "image", "imageUrl").alias("image_url"), "raw",
    )
    return mapped.filter("symbol is not null and published_at is not null and url is not null")


def _blank(name: str) -> Column:
    return F.nullif(F.trim(name), F.lit(""))


def map_positions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Broker position attributes to (holdings, rejected with reason)."""
    mapped = raw.select(
        _blank("accountId").alias("account_id"), _blank("symbol").alias("symbol"), as_date("reportDate").alias("as_of_date"),
        F.coalesce(_blank("assetCategory"), F.lit("STK")).alias("asset_category"), _blank("subCategory").alias("sub_category"),
        F.coalesce(as_double("position"), F.lit(0.0)).alias("quantity"), as_double("markPrice").alias("mark_price"),
        as_double("positionValue").alias("market_value"), as_double("costBasisPrice").alias("avg_cost"),
        as_double("costBasisMoney").alias("cost_basis_total"), as_double("fifoPnlUnrealized").alias("unrealized_pnl"),
        as_double("percentOfNAV").alias("percent_of_nav"), _blank("side").alias("side"), _blank("currency").alias("currency"),
        as_double("fxRateToBase").alias("fx_rate_to_base"), as_double("conid").cast("bigint").alias("conid"),
        _blank("listingExchange").alias("listing_exchange"), _blank("description").alias("description"),
        F.to_json(F.struct("*")).alias("raw"), F.lit("statement").alias("source"),
    )
    return _split(mapped, ("account_id", "symbol", "as_of_date"))


def map_trades(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    mapped = raw.select(
        _blank("accountId").alias("account_id"), _blank("ibExecID").alias("ib_exec_id"), _blank("tradeID").alias("trade_id"),
        _blank("symbol").alias("symbol"), as_double("conid").cast("bigint").alias("conid"),
        F.coalesce(_blank("assetCategory"), F.lit("STK")).alias("asset_category"), _blank("subCategory").alias("sub_category"),
        _blank("description").alias("description"), as_date("tradeDate").alias("trade_date"), _blank("dateTime").alias("executed_at"),
        _blank("buySell").alias("side"), F.coalesce(as_double("quantity"), F.lit(0.0)).alias("quantity"),
        as_double("tradePrice").alias("price"), as_double("proceeds").alias("proceeds"), as_double("netCash").alias("net_cash"),
        as_double("ibCommission").alias("commission"), as_double("fifoPnlRealized").alias("realized_pnl"),
        _blank("openCloseIndicator").alias("open_close"), _blank("orderReference").alias("order_reference"),
        _blank("exchange").alias("exchange"), _blank("currency").alias("currency"), as_double("fxRateToBase").alias("fx_rate_to_base"),
        F.coalesce(_blank("notes"), _blank("code")).alias("notes"), F.to_json(F.struct("*")).alias("raw"), F.lit("statement").alias("source"),
    )
    return _split(mapped, ("account_id", "ib_exec_id", "symbol"))


def _split(df: DataFrame, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    reason = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required])
    tagged = df.withColumn("reason", reason)
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null").select("raw", "reason")
