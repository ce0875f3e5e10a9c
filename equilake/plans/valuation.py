"""Valuation of every company in one plan: DCF, reverse DCF, scenarios, PEG, peer multiples.

All inputs of a company become columns of one row, each model is a projection over that row, and
only the peer medians need another aggregation.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equilake.functions.scalars import (
    col, market_cap, net_revenue, nonzero, peg_label, raw_value, raw_value_nonzero, safe_div, stock_type,
)
from equilake.operators.latest import latest_row, top_n_per_key
from equilake.operators.ranks import group_median
from equilake.operators.state import latest_close

RISK_FREE, EQUITY_PREMIUM = 0.045, 0.055
DEFAULT_GROWTH, TERMINAL_GROWTH, YEARS = 0.04, 0.025, 5
EV_EBITDA_SKIP = ("Financial Services", "Real Estate")
MODELS = ("dcf", "peg", "multiples", "scenario")
ASSUMPTIONS = {
    "base_fcf": "double", "growth_rate": "double", "terminal_growth": "double", "n_years": "int", "wacc": "double", "rf": "double",
    "erp": "double", "shares": "double", "net_debt": "double", "scenario_delta": "double",
}
# Scenario -> (multiple of the delta added to growth, probability).
SCENARIOS = {"bear": (-1.0, 0.25), "base": (0.0, 0.50), "bull": (1.0, 0.25)}


class ValuationError(ValueError):
    """Unknown model or assumption."""


# ----- powers ---------------------------------------------------------------------------------


def _power(x: float, y: float) -> float:
    if math.isnan(x) or math.isnan(y):
        return math.nan
    try:
        return math.pow(x, y)
    except (OverflowError, ValueError):
        with np.errstate(all="ignore"):
            return float(np.float64(x) ** np.float64(y))


@F.pandas_udf(T.DoubleType())
def power(x: pd.Series, y: pd.Series) -> pd.Series:
    """x to the y by the C library, whose last bit is right but for very rare cases.

    The JVM's power is off in its last bit in about 7 of 100 cases, and values of 1e10 and more show that bit in their cents.
    """
    return pd.Series([_power(a, b) for a, b in zip(x, y)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def powers(x: pd.Series, n: pd.Series) -> pd.Series:
    """x to the 1, 2 ... n; see ``power``."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else [_power(a, float(t)) for t in range(1, int(b) + 1)] for a, b in zip(x, n)], dtype="object")


# ----- inputs ---------------------------------------------------------------------------------


def annual(df: DataFrame) -> DataFrame:
    return df.filter("period = 'FY'")


def fcf_history(cash: DataFrame, n: int = 5) -> DataFrame:
    """Free cash flow of the newest n annual rows, oldest first; gaps drop after the n rows are chosen."""
    rows = top_n_per_key(annual(cash), ["symbol"], [F.desc("fiscal_date")], n)
    pairs = F.sort_array(F.collect_list(F.struct("fiscal_date", "free_cash_flow")))
    return rows.groupBy("symbol").agg(F.array_compact(F.transform(pairs, lambda s: s["free_cash_flow"])).alias("history"))


def base_fcf(history: Column | str = "history", window: int = 3) -> Column:
    """Median of the newest ``window`` values."""
    h = col(history)
    tail = F.array_sort(F.slice(h, F.greatest(F.size(h) - window + 1, F.lit(1)), F.lit(window)))
    size = F.size(tail)
    low = F.try_element_at(tail, F.floor((size + 1) / 2).cast("int"))
    high = F.try_element_at(tail, (F.floor(size / 2) + 1).cast("int"))
    return F.when(size > 0, (low + high) / 2)


def fcf_cagr(history: Column | str = "history", floor: float = -0.10, cap: float = 0.20) -> Column:
    h = col(history)
    first, last = F.try_element_at(h, F.lit(1)), F.try_element_at(h, F.lit(-1))
    usable = (F.size(h) >= 2) & (first > 0) & (last > 0)
    growth = power(safe_div(last, first), safe_div(F.lit(1.0), (F.size(h) - 1).cast("double"))) - 1
    return F.when(usable, F.greatest(F.lit(floor), F.least(F.lit(cap), growth)))


def forward_eps_growth(estimates: DataFrame, as_of: dt.date, n: int = 3) -> DataFrame:
    """Endpoint growth of the next n annual consensus values over the real span in years."""
    rows = annual(estimates).filter((F.col("fiscal_date") >= F.lit(as_of)) & F.col("eps_avg").isNotNull())
    rows = top_n_per_key(rows, ["symbol"], [F.asc("fiscal_date")], n)
    ends = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("eps_avg", "fiscal_date").alias("e0"), F.max_by("eps_avg", "fiscal_date").alias("e1"),
        F.datediff(F.max("fiscal_date"), F.min("fiscal_date")).alias("days"))
    usable = (F.col("n") >= 2) & (F.col("e0") > 0) & (F.col("e1") > 0) & (F.col("days") > 0)
    growth = power(safe_div("e1", "e0"), safe_div(F.lit(365.25), F.col("days").cast("double"))) - 1
    return ends.select("symbol", F.when(usable, growth).alias("forward_growth"))


def earnings_growth(income: DataFrame, n: int = 5) -> DataFrame:
    """Net-income growth over the newest n annual rows; years are the present points less one."""
    rows = top_n_per_key(annual(income), ["symbol"], [F.desc("fiscal_date")], n).filter("net_income is not null")
    ends = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("net_income", "fiscal_date").alias("e0"), F.max_by("net_income", "fiscal_date").alias("e1"))
    usable = (F.col("n") >= 2) & (F.col("e0") > 0) & (F.col("e1") > 0)
    growth = power(safe_div("e1", "e0"), safe_div(F.lit(1.0), (F.col("n") - 1).cast("double"))) - 1
    return ends.select("symbol", F.when(usable, growth).alias("earnings_growth"))


def shares_outstanding() -> Column:
    """Market cap over price from the profile, else net income over diluted EPS."""
    cap, price = raw_value_nonzero("profile_raw", "mktCap", "marketCap"), raw_value("profile_raw", "price")
    quoted = F.when((price > 0) & (cap > 0), safe_div(cap, price))
    return F.coalesce(quoted, safe_div("net_income", nonzero("eps_diluted")))


def net_debt() -> Column:
    """Debt less cash; NULL when the balance sheet shows neither."""
    debt = F.coalesce("short_term_debt", F.lit(0.0)) + F.coalesce("long_term_debt", F.lit(0.0))
    cash = F.coalesce("cash_and_equivalents", F.lit(0.0))
    return F.when((debt != 0) | (cash != 0), debt - cash)


def ebitda_proxy() -> Column:
    return F.col("operating_income") + F.coalesce(F.abs("capital_expenditure"), F.lit(0.0))


def adjusted_beta(beta: Column | str = "beta") -> Column:
    return F.coalesce(F.lit(2.0 / 3.0) * col(beta) + F.lit(1.0 / 3.0), F.lit(1.0))


def wacc(beta: Column | str = "beta", rf: Column | float = RISK_FREE, erp: Column | float = EQUITY_PREMIUM) -> Column:
    rf = rf if isinstance(rf, Column) else F.lit(rf)
    erp = erp if isinstance(erp, Column) else F.lit(erp)
    return rf + adjusted_beta(beta) * erp


def valuation_inputs(warehouse, as_of: dt.date) -> DataFrame:
    """One row per profiled company with everything the models read."""

    def newest(name: str, columns: Sequence[str]) -> DataFrame:
        return latest_row(annual(warehouse[name]), ["symbol"], ["fiscal_date"]).select("symbol", *columns)

    df = warehouse["profiles"].select("symbol", "sector", "industry", "beta", F.col("raw").alias("profile_raw"))
    income = latest_row(annual(warehouse["income_statement"]), ["symbol"], ["fiscal_date"]).select(
        "symbol", "revenue", "operating_income", "net_income", "eps_diluted", F.col("raw").alias("income_raw"))
    for part in (
        income,
        newest("balance_sheet", ["short_term_debt", "long_term_debt", "cash_and_equivalents"]),
        newest("cash_flow", ["capital_expenditure"]),
        newest("financial_ratios", ["pe_ratio"]),
        fcf_history(warehouse["cash_flow"]),
        forward_eps_growth(warehouse["analyst_estimates"], as_of),
        earnings_growth(warehouse["income_statement"]),
        latest_close(warehouse["daily_prices"]).withColumnRenamed("close", "current_price"),
    ):
        df = df.join(part, "symbol", "left")
    kind = stock_type("sector", "industry")
    return df.withColumns({
        "stock_type": kind, "base": base_fcf(), "history_growth": fcf_cagr(), "shares_out": shares_outstanding(), "debt": net_debt(),
        "ebitda": ebitda_proxy(), "revenue_net": net_revenue("revenue", "income_raw", kind), "quoted_cap": market_cap("profile_raw"),
    })


def with_assumptions(inputs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Resolve every assumption per company: override, then data, then default.

    A zero override of base cash flow or shares counts as not given.
    """
    if overrides is not None:
        unknown = sorted(set(overrides.columns) - {"symbol", *ASSUMPTIONS})
        if unknown:
            raise ValuationError(f"unknown assumption(s): {unknown}")
        given = overrides.select("symbol", *[F.col(c).cast(ASSUMPTIONS[c]).alias(f"o_{c}") for c in overrides.columns if c != "symbol"])
        inputs = inputs.join(given, "symbol", "left")
    have = set(inputs.columns)

    def o(name: str) -> Column:
        return F.col(f"o_{name}") if f"o_{name}" in have else F.lit(None).cast(ASSUMPTIONS[name])

    rate = F.coalesce(o("wacc"), wacc("beta", F.coalesce(o("rf"), F.lit(RISK_FREE)), F.coalesce(o("erp"), F.lit(EQUITY_PREMIUM))))
    source = (
        F.when(o("growth_rate").isNotNull(), "user_override").when(F.col("forward_growth").isNotNull(), "forward_consensus")
        .when(F.col("history_growth").isNotNull(), "historical_fcf_cagr").otherwise("default_fallback"))
    resolved = inputs.withColumns({
        "a_base": F.coalesce(nonzero(o("base_fcf")), F.col("base")),
        "a_growth": F.coalesce(o("growth_rate"), "forward_growth", "history_growth", F.lit(DEFAULT_GROWTH)),
        "growth_source": source, "a_terminal": F.coalesce(o("terminal_growth"), F.lit(TERMINAL_GROWTH)),
        "a_years": F.coalesce(o("n_years"), F.lit(YEARS)), "a_wacc": rate,
        "a_shares": F.coalesce(nonzero(o("shares")), F.col("shares_out")),
        "a_debt": F.coalesce(o("net_debt"), F.col("debt"), F.lit(0.0)), "a_delta": F.coalesce(o("scenario_delta"), F.lit(0.04)),
    })
    return resolved.drop(*[c for c in resolved.columns if c.startswith("o_")])


# ----- discounted cash flow -------------------------------------------------------------------


def dcf(base, growth, terminal, rate, years, debt, shares) -> Column:
    """Struct of the growing-perpetuity DCF; NULL when undefined (no positive base, rate <= terminal growth)."""
    base, growth, terminal, rate, years, debt, shares = map(col, (base, growth, terminal, rate, years, debt, shares))
    grown, discount = powers(1 + growth, years), powers(1 + rate, years)
    flows = F.transform(grown, lambda p: base * p)
    present = F.zip_with(grown, discount, lambda p, q: base * p / q)
    end = safe_div(base * F.try_element_at(grown, F.lit(-1)) * (1 + terminal), rate - terminal)
    end_pv = end / F.try_element_at(discount, F.lit(-1))
    value = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) + end_pv
    equity = value - debt
    per_share = F.when(shares > 0, safe_div(equity, shares))
    defined = (rate > terminal) & (base > 0) & (years >= 1)
    return F.when(defined, F.struct(
        value.alias("enterprise_value"), equity.alias("equity_value"), per_share.alias("fair_value"), flows.alias("projected_fcf"),
        present.alias("pv_per_year"), end.alias("terminal_value"), end_pv.alias("terminal_pv")))


def dcf_for(growth="a_growth", rate="a_wacc") -> Column:
    return dcf("a_base", growth, "a_terminal", rate, "a_years", "a_debt", "a_shares")


def dcf_sensitivity(resolved: DataFrame) -> DataFrame:
    """Fair value on a 5 × 5 grid of growth and discount rate around the resolved ones; long form."""
    g, w = F.col("a_growth"), F.col("a_wacc")
    growths = F.array(F.greatest(g - 0.04, F.lit(-0.10)), F.greatest(g - 0.02, F.lit(-0.10)), g, g + 0.02, g + 0.04)
    rates = F.array(F.greatest(w - 0.02, F.lit(0.02)), F.greatest(w - 0.01, F.lit(0.02)), w, w + 0.01, w + 0.02)
    cells = resolved.filter("a_base > 0 and a_wacc > a_terminal").select("*", F.posexplode(growths).alias("growth_index", "growth"))
    cells = cells.select("*", F.posexplode(rates).alias("wacc_index", "wacc"))
    return cells.select("symbol", "growth_index", "wacc_index", "growth", "wacc", dcf_for("growth", "wacc")["fair_value"].alias("fair_value"))


_IMPLIED = T.StructType([
    T.StructField("implied_growth", T.DoubleType()), T.StructField("implied_above", T.BooleanType()),
    T.StructField("implied_below", T.BooleanType()), T.StructField("note", T.StringType())])


def _solve_growth(base, terminal, rate, years, debt, shares, price, lo=-0.5, hi=1.0, tol=1e-4, steps=100) -> pd.DataFrame:
    """Bisection on whole columns; every row leaves the loop when its own tolerance is met."""
    n = len(base)
    arrays = [np.asarray(a, dtype=float) for a in (base, terminal, rate, years, debt, shares, price)]
    b, t, w, y, d, s, p = arrays

    def fair(g: np.ndarray, m: np.ndarray) -> np.ndarray:
        total = np.zeros(m.sum())
        for year in range(1, int(np.nanmax(y[m])) + 1 if m.any() else 1):
            total += np.where(year <= y[m], b[m] * (1 + g) ** year / (1 + w[m]) ** year, 0.0)
        end = b[m] * (1 + g) ** y[m] * (1 + t[m]) / (w[m] - t[m])
        return (total + end / (1 + w[m]) ** y[m] - d[m]) / s[m]

    note = np.full(n, None, dtype=object)
    growth = np.full(n, np.nan)
    above, below = np.zeros(n, bool), np.zeros(n, bool)
    no_price = ~(p > 0)
    note[~no_price & ~(s > 0)] = "shares unavailable"
    note[~no_price & (s > 0) & ~(b > 0)] = "base cash flow must be positive"
    ok = ~no_price & (s > 0) & (b > 0)
    note[ok & ~(w > t)] = "DCF undefined at the bracket"
    ok &= w > t
    if ok.any():
        idx = np.flatnonzero(ok)
        low_value, high_value = fair(np.full(len(idx), lo), ok), fair(np.full(len(idx), hi), ok)
        is_below, is_above = p[idx] <= low_value, p[idx] >= high_value
        below[idx[is_below]] = True
        above[idx[~is_below & is_above]] = True
        note[idx[is_below]] = "price at or below the value of the lowest growth"
        note[idx[~is_below & is_above]] = "price above the value of the highest growth"
        active = np.zeros(n, bool)
        active[idx[~is_below & ~is_above]] = True
        a, c = np.full(n, lo), np.full(n, hi)
        for _ in range(steps):
            if not active.any():
                break
            mid = (a[active] + c[active]) / 2
            value = fair(mid, active)
            where = np.flatnonzero(active)
            hit = np.abs(value - p[where]) < tol * np.maximum(1.0, np.abs(p[where]))
            growth[where[hit]] = mid[hit]
            up = value < p[where]
            a[where[up]] = mid[up]
            c[where[~up]] = mid[~up]
            active[where[hit]] = False
        growth[active] = (a[active] + c[active]) / 2
        note[active] = "iteration limit reached (approximate)"
    return pd.DataFrame({
        "implied_growth": pd.Series(growth).astype("Float64").mask(np.isnan(growth)), "implied_above": above, "implied_below": below, "note": note})


@F.pandas_udf(_IMPLIED)
def _implied_udf(base: pd.Series, terminal: pd.Series, rate: pd.Series, years: pd.Series, debt: pd.Series, shares: pd.Series, price: pd.Series) -> pd.DataFrame:
    return _solve_growth(base, terminal, rate, years, debt, shares, price)


def implied_growth(resolved: DataFrame) -> DataFrame:
    """Stage-one growth at which the DCF equals the price, and its gaps to the assumed and past growth."""
    solved = resolved.withColumn("_r", _implied_udf("a_base", "a_terminal", "a_wacc", "a_years", "a_debt", "a_shares", "current_price"))
    return solved.select(
        "symbol", "current_price", F.col("_r.implied_growth").alias("implied_growth"), F.col("_r.implied_above").alias("implied_above"),
        F.col("_r.implied_below").alias("implied_below"), F.col("_r.note").alias("note"),
        (F.col("_r.implied_growth") - F.col("a_growth")).alias("gap_vs_assumed"),
        (F.col("_r.implied_growth") - F.col("history_growth")).alias("gap_vs_history"))


def scenario_columns(scenarios: Mapping[str, tuple[float, float]] | None = None) -> dict[str, Column]:
    """Fair value per scenario, the probability-weighted mean of those defined, and the weight used."""
    scenarios = scenarios or SCENARIOS
    values = {name: dcf_for(F.col("a_growth") + F.lit(step) * F.col("a_delta"))["fair_value"] for name, (step, _) in scenarios.items()}
    weight = sum((F.when(v.isNotNull(), F.lit(scenarios[n][1])).otherwise(0.0) for n, v in values.items()), F.lit(0.0))
    total = sum((F.coalesce(v * scenarios[n][1], F.lit(0.0)) for n, v in values.items()), F.lit(0.0))
    out = {f"{n}_value": v for n, v in values.items()}
    out["scenario_value"] = F.when(weight > 0, safe_div(total, weight))
    out["weight_used"] = weight
    return out


def scenario_dcf(resolved: DataFrame, scenarios: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    return resolved.filter("a_base > 0").select("symbol", *[c.alias(n) for n, c in scenario_columns(scenarios).items()])


# ----- relative value -------------------------------------------------------------------------


def peg_values() -> dict[str, Column]:
    """Growth, ratio and fair value from the columns of the valuation inputs. Fair P/E equals growth in percent."""
    growth = F.coalesce("forward_growth", "earnings_growth")
    usable = F.col("pe_ratio").isNotNull() & (growth > 0)
    rate = F.when(usable, growth * 100)
    return {"growth": growth, "ratio": safe_div("pe_ratio", rate), "rate": rate, "fair": rate * F.col("eps_diluted")}


def peg(inputs: DataFrame) -> DataFrame:
    """P/E over growth in percent; fair P/E equals growth. Forward consensus first, then past earnings."""
    v = peg_values()
    source = F.when(F.col("forward_growth").isNotNull(), "forward_consensus").when(F.col("earnings_growth").isNotNull(), "historical_cagr")
    return inputs.select(
        "symbol", F.col("pe_ratio").alias("pe"), v["growth"].alias("growth_rate"), source.alias("growth_source"), v["ratio"].alias("peg_ratio"),
        v["rate"].alias("fair_pe"), v["fair"].alias("fair_value"), peg_label(v["ratio"]).alias("interpretation"),
        (safe_div(v["fair"], "current_price") - 1).alias("upside"))


def peer_medians(profiles: DataFrame, ratios: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(sector, metric, median): exact median over each company's newest non-null annual value.

    The company itself is one of its peers. All metrics go through one order-statistic pass.
    """
    newest = annual(ratios).groupBy("symbol").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("fiscal_date"))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns])
    peers = newest.join(profiles.filter("sector is not null").select("symbol", "sector"), "symbol")
    long_form = peers.select("sector", F.explode(pairs).alias("p")).select("sector", "p.metric", "p.value")
    return group_median(long_form, ["sector", "metric"], "value", "median")


def peer_median(profiles: DataFrame, ratios: DataFrame, column: str) -> DataFrame:
    return peer_medians(profiles, ratios, [column]).select("sector", "median")


def with_multiples(inputs: DataFrame, medians: DataFrame) -> DataFrame:
    """Adds the prices implied by the sector's median P/E, EV/EBITDA and P/S, and the mean of the positive ones as multiples_value."""
    names = {"pe_ratio": "m_pe", "ev_to_ebitda": "m_ev", "price_to_sales": "m_ps"}
    wide = medians.groupBy("sector").agg(*[F.max(F.when(F.col("metric") == k, F.col("median"))).alias(v) for k, v in names.items()])
    df = inputs.join(wide, "sector", "left")
    skip = F.coalesce(F.col("sector").isin(*EV_EBITDA_SKIP), F.lit(False))
    by_ev = F.when(~skip, safe_div(F.col("m_ev") * F.col("ebitda") - F.coalesce("debt", F.lit(0.0)), nonzero("shares_out")))
    df = df.withColumns({
        "pe_price": F.col("m_pe") * F.col("eps_diluted"), "ev_price": by_ev,
        "ps_price": safe_div(F.col("m_ps") * F.col("revenue_net"), nonzero("shares_out"))})
    prices = F.filter(F.array("pe_price", "ev_price", "ps_price"), lambda x: x > 0)
    mean = F.when(F.size(prices) > 0, F.aggregate(prices, F.lit(0.0), lambda a, x: a + x) / F.size(prices))
    return df.withColumn("multiples_value", mean).drop(*names.values())


def multiples(inputs: DataFrame, medians: DataFrame) -> DataFrame:
    """Price implied by the sector's median P/E, EV/EBITDA and P/S, and the mean of the positive ones."""
    reference = F.coalesce(nonzero("current_price"), F.col("quoted_cap"))
    mean = F.col("multiples_value")
    return with_multiples(inputs, medians).select(
        "symbol", "sector", "pe_price", "ev_price", "ps_price", mean.alias("fair_value"),
        F.when(reference > 0, safe_div(mean, reference) - 1).alias("upside"))


# ----- everything -----------------------------------------------------------------------------


def value_companies(warehouse, as_of: dt.date, overrides: DataFrame | None = None, models: Sequence[str] = MODELS) -> DataFrame:
    """One row per company with the requested models' fair values, their mean and the upside.

    The mean leaves out the scenario model, a variant of the DCF.
    """
    unknown = [m for m in models if m not in MODELS]
    if unknown:
        raise ValuationError(f"unknown model(s) {unknown}; valid: {MODELS}")
    # The inputs are planned once; every model adds columns to the same rows.
    df = with_assumptions(valuation_inputs(warehouse, as_of), overrides)
    fair: dict[str, str] = {}
    if "dcf" in models:
        df = df.withColumn("dcf_value", dcf_for()["fair_value"])
        fair["dcf"] = "dcf_value"
    if "scenario" in models:
        columns = scenario_columns()
        df = df.withColumns({n: F.when(F.col("a_base") > 0, c) for n, c in columns.items()})
    if "peg" in models:
        values = peg_values()
        df = df.withColumns({"peg_ratio": values["ratio"], "peg_value": values["fair"]})
        fair["peg"] = "peg_value"
    if "multiples" in models:
        medians = peer_medians(warehouse["profiles"], warehouse["financial_ratios"], ["pe_ratio", "ev_to_ebitda", "price_to_sales"])
        df = with_multiples(df, medians)
        fair["multiples"] = "multiples_value"
    mean = F.lit(None).cast("double")
    if fair:
        found = F.array_compact(F.array(*[F.col(c) for c in fair.values()]))
        mean = F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found))
    df = df.withColumn("fair_value_mean", mean)
    out = ["symbol", "current_price", "growth_source", *fair.values()]
    out += [c for c in ("peg_ratio", "bear_value", "base_value", "bull_value", "scenario_value") if c in df.columns]
    return df.select(*out, "fair_value_mean", (safe_div("fair_value_mean", nonzero("current_price")) - 1).alias("upside_mean"))


def snapshot_rows(valued: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per (symbol, model) for the append-only snapshot table."""
    pairs = [("dcf", "dcf_value"), ("peg", "peg_value"), ("multiples", "multiples_value"), ("scenario", "scenario_value")]
    models = F.array(*[F.struct(F.lit(m).alias("model_type"), F.col(c).alias("fair_value_per_share")) for m, c in pairs if c in valued.columns])
    rows = valued.select("symbol", "current_price", F.explode(models).alias("m"))
    return rows.select(
        "symbol", "m.model_type", F.lit(as_of).alias("as_of"), "m.fair_value_per_share", "current_price",
        (safe_div("m.fair_value_per_share", nonzero("current_price")) - 1).alias("upside_pct"))
