"""Which symbols have data new enough, per table."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Scope -> (table, clock column, days); the clock is the business date where there is one.
SCOPES: dict[str, tuple[str, str, int]] = {
    "profile": ("profiles", "known_at", 30),
    "quote": ("daily_prices", "trade_date", 3),
    "financials": ("income_statement", "fiscal_date", 100),
    "ratios": ("financial_ratios", "known_at", 100),
    "estimates": ("analyst_estimates", "known_at", 7),
    "transcript": ("transcripts", "call_date", 100),
    "insider": ("insider_transactions", "filing_date", 30),
    "short": ("short_interest", "settlement_date", 25),
}


def scope_state(universe: DataFrame, table: DataFrame, scope: str, now: dt.datetime) -> DataFrame:
    """Per symbol: newest clock value and fresh, stale or missing. A value on the cutoff is fresh."""
    _, clock, days = SCOPES[scope]
    newest = table.groupBy("symbol").agg(F.max(F.col(clock).cast("timestamp")).alias("latest"))
    cutoff = now - dt.timedelta(days=days)
    if clock != "known_at":
        cutoff = dt.datetime.combine(cutoff.date(), dt.time())
    if cutoff.tzinfo is None:
        cutoff = cutoff.replace(tzinfo=dt.timezone.utc)
    state = F.when(F.col("latest").isNull(), "missing").when(F.col("latest") >= F.lit(cutoff), "fresh").otherwise("stale")
    members = universe.select("symbol").distinct()
    return members.join(newest, "symbol", "left").select(F.lit(scope).alias("scope"), "symbol", "latest", state.alias("state"))


def freshness_states(warehouse, now: dt.datetime, scopes=tuple(SCOPES)) -> DataFrame:
    unknown = [s for s in scopes if s not in SCOPES]
    if unknown:
        raise ValueError(f"there is no table behind the scope {unknown}")
    parts = [scope_state(warehouse["universe"], warehouse[SCOPES[s][0]], s, now) for s in scopes]
    return reduce(DataFrame.unionByName, parts)


def freshness_report(states: DataFrame) -> DataFrame:
    """Counts per scope; the symbols themselves stay rows of ``states``."""
    return states.groupBy("scope").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "fresh").alias("fresh"),
        F.count_if(F.col("state") == "stale").alias("stale"), F.count_if(F.col("state") == "missing").alias("missing"))


def needs_refresh(states: DataFrame, scope: str | None = None) -> DataFrame:
    """Stale or missing symbols: of one scope, or the union over all scopes."""
    df = states.filter(F.col("state") != "fresh")
    return (df if scope is None else df.filter(F.col("scope") == scope)).select("symbol").distinct()


def skipped_fresh(requested: DataFrame, states: DataFrame, scope: str) -> DataFrame:
    """Requested symbols that need no refresh."""
    return requested.select("symbol").distinct().join(needs_refresh(states, scope), "symbol", "left_anti")
