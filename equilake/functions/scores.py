"""Quality and distress scores over one row per company."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from equilake.functions.scalars import nonzero, safe_div

PIOTROSKI_LEGS = (
    "roa_positive", "cfo_positive", "delta_roa", "accruals", "delta_leverage",
    "delta_liquidity", "no_dilution", "delta_margin", "delta_turnover",
)


def piotroski(cur: str = "cur", prev: str = "prev") -> dict[str, Column]:
    """Nine 0/1 legs from two yearly structs; a leg with a missing input is NULL."""

    def ratio(year: str, num: str, den: str) -> Column:
        return safe_div(F.col(f"{year}.{num}"), F.col(f"{year}.{den}"))

    def leg(test: Column) -> Column:
        return test.cast("int")

    roa = [ratio(y, "net_income", "total_assets") for y in (cur, prev)]
    leverage = [ratio(y, "long_term_debt", "total_assets") for y in (cur, prev)]
    liquidity = [ratio(y, "current_assets", "current_liabilities") for y in (cur, prev)]
    margin = [ratio(y, "gross_profit", "revenue") for y in (cur, prev)]
    turnover = [ratio(y, "revenue", "total_assets") for y in (cur, prev)]
    cash = F.col(f"{cur}.operating_cash_flow")
    return {
        "roa_positive": leg(roa[0] > 0),
        "cfo_positive": leg(cash > 0),
        "delta_roa": leg(roa[0] > roa[1]),
        "accruals": leg(cash > F.col(f"{cur}.net_income")),
        "delta_leverage": leg(leverage[0] < leverage[1]),
        "delta_liquidity": leg(liquidity[0] > liquidity[1]),
        "no_dilution": leg(F.col(f"{cur}.shares") <= F.col(f"{prev}.shares")),
        "delta_margin": leg(margin[0] > margin[1]),
        "delta_turnover": leg(turnover[0] > turnover[1]),
    }


def piotroski_struct(cur: str = "cur", prev: str = "prev") -> Column:
    legs = piotroski(cur, prev)
    score = sum((F.coalesce(c, F.lit(0)) for c in legs.values()), F.lit(0))
    possible = sum((c.isNotNull().cast("int") for c in legs.values()), F.lit(0))
    missing = F.array_compact(F.array(*[F.when(c.isNull(), n) for n, c in legs.items()]))
    return F.struct(
        score.alias("score"), possible.alias("max_possible"),
        F.struct(*[c.alias(n) for n, c in legs.items()]).alias("components"), missing.alias("missing"),
    )


def altman_struct(year: str = "cur") -> Column:
    """Four-factor Z'' and its zone; NULL when any input is missing."""
    f = {n: F.col(f"{year}.{n}") for n in (
        "current_assets", "current_liabilities", "total_assets", "retained_earnings",
        "operating_income", "total_equity", "total_liabilities")}
    x1 = safe_div(f["current_assets"] - f["current_liabilities"], f["total_assets"])
    x2 = safe_div(f["retained_earnings"], f["total_assets"])
    x3 = safe_div(f["operating_income"], f["total_assets"])
    x4 = safe_div(f["total_equity"], f["total_liabilities"])
    z = x1 * 6.56 + x2 * 3.26 + x3 * 6.72 + x4 * 1.05
    zone = F.when(z > 2.6, "safe").when(z < 1.1, "distress").otherwise("grey")
    parts = F.struct(x1.alias("x1_wc_ta"), x2.alias("x2_re_ta"), x3.alias("x3_ebit_ta"), x4.alias("x4_eq_tl"))
    return F.when(z.isNotNull(), F.struct(z.alias("z_score"), zone.alias("zone"), parts.alias("components")))


def ratio(num: Column | str, den: Column | str) -> Column:
    """Ratio that treats a zero denominator as missing."""
    return safe_div(num, nonzero(den))
