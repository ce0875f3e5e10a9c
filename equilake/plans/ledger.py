"""The decision ledger: what was decided, what happened since, against which benchmark."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilake.functions.scalars import MARKET_FUND, SECTOR_FUNDS, safe_return, sector_fund
from equilake.operators.asof import HORIZON_DAYS, asof_price, asof_price_open
from equilake.operators.ranks import group_median
from equilake.session import store

SIDES = ("buy", "sell")
GROUPINGS = ("confidence", "sector", "tag")
FUNDS = tuple(sorted({MARKET_FUND, *SECTOR_FUNDS.values()}))


class LedgerError(ValueError):
    """Unknown grouping or horizon."""


def record_decisions(decisions: DataFrame, prices: DataFrame, profiles: DataFrame, bundles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(recorded, rejected). Adds the price and sector at the open and the bundle of that symbol.

    ``decisions`` carries decision_id, symbol, side, opened_at and whatever else the caller keeps.
    """
    checked = decisions.withColumn("reason", F.when(F.coalesce(F.col("side").isin(*SIDES), F.lit(False)), F.lit(None)).otherwise(
        F.lit(f"a decision takes one of the sides {', '.join(SIDES)}")))
    valid = checked.filter("reason is null").drop("reason")
    opens = asof_price_open(valid.select("symbol", F.col("opened_at").alias("target_date")), prices)
    opens = opens.select("symbol", F.col("target_date").alias("opened_at"), F.col("value").alias("price_at_open"))
    sectors = profiles.select("symbol", F.col("sector").alias("sector_at_open"))
    out = valid.join(opens, ["symbol", "opened_at"], "left").join(sectors, "symbol", "left")
    if bundles is not None:
        newest = bundles.groupBy("symbol").agg(F.max_by("bundle_id", "as_of").alias("bundle_id"))
        out = out.join(newest, "symbol", "left")
    return out, checked.filter("reason is not null")


def _horizons() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("days")) for h, n in HORIZON_DAYS.items()]))


def lookups(decisions: DataFrame, as_of: dt.date, elapsed: bool = True) -> DataFrame:
    """One row per decision and horizon whose target date has (or has not) come by ``as_of``."""
    rows = decisions.select("*", _horizons().alias("h")).select(
        *decisions.columns, "h.horizon", F.date_add("opened_at", F.col("h.days")).alias("target_date"),
        sector_fund("sector_at_open").alias("fund"))
    due = F.col("target_date") <= F.lit(as_of)
    return rows.filter(due if elapsed else ~due)


def benchmark_prices(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds spy_open, spy_target, sector_open, sector_target and the symbol's own price at the target.

    All five lookups of all rows are one set of (symbol, date) points, answered by one pass over the bars. The answers for the funds are at most
    (number of funds) × (calendar days) rows, whatever the number of decisions: small enough to broadcast by construction.
    """
    def point(symbol: Column, date: str) -> Column:
        return F.struct(symbol.alias("symbol"), F.col(date).alias("target_date"))

    market = F.lit(MARKET_FUND)
    points = F.array(point(F.col("symbol"), "target_date"), *[point(s, d) for s in (market, F.col("fund")) for d in ("opened_at", "target_date")])
    asked = rows.select(F.explode(points).alias("p")).select("p.symbol", "p.target_date").filter("symbol is not null")
    found = store(asof_price(asked, prices, variant="ledger").select("symbol", "target_date", "value"), "lookups")
    out = rows.join(found.select("symbol", "target_date", F.col("value").alias("price")), ["symbol", "target_date"], "left")
    funds = F.broadcast(found.filter(F.col("symbol").isin(*FUNDS)))
    own_fund = F.when(F.col("fund") != MARKET_FUND, F.col("fund"))
    for name, fund, date in (("spy_open", market, "opened_at"), ("spy_target", market, "target_date"), ("sector_open", own_fund, "opened_at"), ("sector_target", own_fund, "target_date")):
        side = funds.select(F.col("symbol").alias("_f"), F.col("target_date").alias("_d"), F.col("value").alias(name))
        out = out.join(side, (fund == F.col("_f")) & (F.col(date) == F.col("_d")), "left").drop("_f", "_d")
    return out


def track_decisions(decisions: DataFrame, prices: DataFrame, as_of: dt.date) -> DataFrame:
    """Forward return, benchmark returns and alpha of every elapsed (decision, horizon).

    The key is (decision_id, horizon): upserting the result twice leaves the same table.
    """
    df = benchmark_prices(lookups(decisions, as_of), prices)
    sign = F.when(F.col("side") == "sell", F.lit(-1.0)).otherwise(F.lit(1.0))
    own = safe_return("price_at_open", "price", sign)
    market, sector = safe_return("spy_open", "spy_target"), safe_return("sector_open", "sector_target")
    df = df.withColumns({"return_pct": own, "spy_return_pct": market, "sector_return_pct": sector})
    return df.select(
        "decision_id", "horizon", F.col("target_date").alias("tracked_at"), "price", "return_pct", "spy_return_pct",
        F.when(F.col("fund") != MARKET_FUND, F.col("fund")).alias("sector_etf"), "sector_return_pct",
        (F.col("return_pct") - F.coalesce("sector_return_pct", "spy_return_pct")).alias("alpha_pct"),
        "spy_open", "spy_target", "sector_open", "sector_target")


def track_summary(decisions: DataFrame, as_of: dt.date) -> DataFrame:
    """Decisions touched, rows written and rows whose horizon has not elapsed."""
    due = [F.count_if(F.date_add("opened_at", n) <= F.lit(as_of)) for n in HORIZON_DAYS.values()]
    written = sum(due[1:], due[0])
    return decisions.agg(
        F.count(F.lit(1)).alias("decisions_touched"), written.alias("rows_written"),
        (F.count(F.lit(1)) * len(HORIZON_DAYS) - written).alias("rows_skipped"))


def decisions_with_tracking(decisions: DataFrame, tracking: DataFrame, horizon: str) -> DataFrame:
    """Every decision with its tracking row of one horizon, if any."""
    at = tracking.filter(F.col("horizon") == horizon).select(
        "decision_id", "horizon", "tracked_at", "price", "return_pct", "spy_return_pct", "sector_etf", "sector_return_pct", "alpha_pct")
    return decisions.join(at, "decision_id", "left")


def decision_detail(decisions: DataFrame, tracking: DataFrame) -> DataFrame:
    """A decision with its tracking rows (at most one per horizon) ordered by date."""
    rows = tracking.groupBy("decision_id").agg(F.sort_array(F.collect_list(F.struct(
        "tracked_at", "horizon", "price", "return_pct", "spy_return_pct", "sector_return_pct", "alpha_pct"))).alias("tracking"))
    return decisions.join(rows, "decision_id", "left")


def scorecard(decisions: DataFrame, tracking: DataFrame, by: str = "confidence", horizon: str = "1m") -> DataFrame:
    """Decisions, tracked rows, mean return and alpha, exact median alpha per group.

    A decision with several tags counts once in each.
    """
    if by not in GROUPINGS:
        raise LedgerError(f"a scorecard groups by {', '.join(GROUPINGS)}, not {by!r}")
    if horizon not in HORIZON_DAYS:
        raise LedgerError(f"decisions are tracked over {', '.join(HORIZON_DAYS)}, not {horizon!r}")
    df = decisions_with_tracking(decisions, tracking, horizon)
    if by == "tag":
        tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("untagged")))
        df = df.withColumn("group", F.explode(F.coalesce(tags, F.array(F.lit("untagged")))))
    elif by == "sector":
        df = df.withColumn("group", F.coalesce(F.nullif("sector_at_open", F.lit("")), F.lit("unknown")))
    else:
        df = df.withColumn("group", F.coalesce(F.col("confidence").cast("string"), F.lit("unrated")))
    # Read by the averages and twice by the medians.
    df = store(df.select("group", "horizon", "return_pct", "alpha_pct"), "scorecard")
    stats = df.groupBy("group").agg(
        F.count(F.lit(1)).alias("decision_count"), F.count("horizon").alias("tracked_count"),
        F.avg("return_pct").alias("avg_return_pct"), F.avg("alpha_pct").alias("avg_alpha_pct"))
    medians = group_median(df, ["group"], "alpha_pct", "median_alpha_pct")
    return stats.join(medians, "group", "left")


def rank_scorecard(card: DataFrame) -> DataFrame:
    return card.orderBy(F.desc_nulls_last("avg_alpha_pct"), "group")


