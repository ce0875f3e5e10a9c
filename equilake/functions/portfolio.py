"""Per-holding expressions. Options trade in 100-share contracts; cash has no price P&L."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is(category: str) -> Column:
    return F.coalesce(F.upper(F.col("asset_category")) == category, F.lit(False))


def contract_multiplier() -> Column:
    return F.when(_is("OPT"), F.lit(100.0)).otherwise(F.lit(1.0))


def is_cash() -> Column:
    return _is("CASH")


def cost_basis() -> Column:
    return F.coalesce(
        F.col("cost_basis_total"),
        F.col("avg_cost") * F.col("quantity") * contract_multiplier(),
        F.col("market_value") - F.col("unrealized_pnl"),
    )


def unrealized() -> Column:
    derived = (F.col("latest_close") - F.col("avg_cost")) * F.col("quantity") * contract_multiplier()
    return F.coalesce(F.col("unrealized_pnl"), F.when(~is_cash(), derived))


def day_pnl() -> Column:
    move = F.col("quantity") * (F.col("latest_close") - F.col("prev_close")) * contract_multiplier()
    return F.when(~is_cash(), move)


def prev_value() -> Column:
    return F.when(~is_cash(), F.col("quantity") * F.col("prev_close") * contract_multiplier())
