"""One wide row per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilake.functions.predicates import RATIO_FIELDS
from equilake.functions.scalars import market_cap
from equilake.operators.latest import latest_row, top_n_per_key


def latest_close(prices: DataFrame) -> DataFrame:
    """Close of the newest bar, even when that close is missing."""
    return prices.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("close"))


def symbol_state(universe: DataFrame, profiles: DataFrame, ratios: DataFrame, prices: DataFrame) -> DataFrame:
    """Profile, newest annual ratios and newest close for every member of the universe.

    Each table is reduced to one row per symbol before it is joined.
    """
    profile = profiles.select("symbol", "sector", "industry", "country", "beta", market_cap("raw").alias("market_cap"))
    annual = latest_row(ratios.filter("period = 'FY'"), ["symbol"], ["fiscal_date"]).select(
        "symbol", *[F.col(c).alias(f) for f, c in RATIO_FIELDS.items()])
    members = universe.select("symbol").distinct()
    return members.join(profile, "symbol", "left").join(annual, "symbol", "left").join(latest_close(prices), "symbol", "left")


INCOME_FIELDS = ("net_income", "revenue", "gross_profit", "operating_income", "eps_diluted")
BALANCE_FIELDS = (
    "total_assets", "total_liabilities", "total_equity", "long_term_debt", "retained_earnings", "current_assets", "current_liabilities")
CASH_FIELDS = ("operating_cash_flow", "free_cash_flow")


def combine_year(income: DataFrame, balance: DataFrame, cash: DataFrame, n: int = 2) -> DataFrame:
    """Newest ``n`` annual rows of each statement, full outer joined on (symbol, calendar year)."""

    def annual(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
        rows = top_n_per_key(df.filter("period = 'FY'"), ["symbol"], [F.desc("fiscal_date")], n)
        # Two fiscal dates in one calendar year: the older one wins, as it is read last.
        return rows.groupBy("symbol", F.year("fiscal_date").alias("year")).agg(
            *[F.min_by(c, "fiscal_date").alias(c) for c in fields])

    keys = ["symbol", "year"]
    out = annual(income, INCOME_FIELDS).join(annual(balance, BALANCE_FIELDS), keys, "full_outer")
    out = out.join(annual(cash, CASH_FIELDS), keys, "full_outer")
    return out.withColumn("shares", F.try_divide("net_income", "eps_diluted"))


def latest_holdings(holdings: DataFrame, account: str | None = None, as_of=None) -> DataFrame:
    """Newest holding per (account, symbol), or exactly those of ``as_of``."""
    df = holdings if account is None else holdings.filter(F.col("account_id") == account)
    if as_of is not None:
        return df.filter(F.col("as_of_date") == F.lit(as_of))
    return latest_row(df, ["account_id", "symbol"], ["as_of_date"])
