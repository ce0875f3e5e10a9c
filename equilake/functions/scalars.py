"""Scalar expressions: coercion, guarded ratios, vendor JSON access, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ----- lenient coercion -----------------------------------------------------------------------


def as_double(c: Column | str) -> Column:
    """Number or NULL; blanks, text and NaN/Infinity become NULL."""
    value = F.trim(col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def as_long(c: Column | str) -> Column:
    """Whole number or NULL; a number written with a fraction or an exponent is cut towards zero."""
    value = as_double(c)
    return F.coalesce(F.trim(col(c).cast("string")).try_cast("bigint"), F.when(F.abs(value) < F.lit(2.0**63), value.cast("bigint")))


def as_date(c: Column | str) -> Column:
    """ISO date from the first ten characters, or a compact yyyyMMdd date."""
    text = F.trim(col(c).cast("string"))
    return F.coalesce(
        F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")),
        F.substring(text, 1, 10).try_cast("date"),
    )


def as_timestamp(c: Column | str) -> Column:
    """Timestamps without an offset are UTC; an ISO offset is honoured; a bare date is midnight."""
    text = F.trim(col(c).cast("string"))
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(
        F.when(zoned, text.try_cast("timestamp")),
        F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")),
    )


# ----- guarded arithmetic ---------------------------------------------------------------------


def nonzero(c: Column | str) -> Column:
    """Zero counts as missing."""
    return F.nullif(col(c), F.lit(0.0))


def safe_div(num: Column | str, den: Column | str) -> Column:
    return F.try_divide(col(num), col(den))


def pct(num: Column | str, den: Column | str) -> Column:
    """Percentage of the absolute denominator, so the sign follows the numerator."""
    return F.try_divide(col(num), F.abs(col(den))) * 100


def pct_change(latest: Column | str, previous: Column | str) -> Column:
    return (F.try_divide(col(latest), col(previous)) - 1) * 100


def surprise_pct(actual: Column | str, estimate: Column | str) -> Column:
    return F.try_divide(col(actual) - col(estimate), F.abs(col(estimate))) * 100


def safe_return(start: Column | str, end: Column | str, sign: Column | float = 1.0) -> Column:
    sign = sign if isinstance(sign, Column) else F.lit(sign)
    return sign * (F.try_divide(col(end), col(start)) - 1)


def nan_to_null(c: Column | str) -> Column:
    value = col(c)
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def r_dec(c: Column | str, places: int) -> Column:
    """Round by floor; agrees across engines where ``round`` does not.

    The offset is a little over one half, so an exact half never hangs on the last bit of a sum. ``floor`` gives a bigint, which ends at
    9.2e18; doubles from 2^53 on have no fraction and stay as they are, infinity and NaN too.
    """
    scale = float(10**places)
    value = col(c) * scale + 0.50013
    return F.when(F.abs(value) < 2.0**53, F.floor(value)).otherwise(value) / scale


# ----- vendor JSON ----------------------------------------------------------------------------


def raw_text(raw: Column | str, *keys: str) -> Column:
    """First non-null member among ``keys`` of a JSON object held as a string."""
    return F.coalesce(*[F.get_json_object(col(raw), f"$.{k}") for k in keys])


def raw_text_nonblank(raw: Column | str, *keys: str) -> Column:
    """First member that is neither null, blank nor zero (the vendor uses all three for 'none')."""

    def usable(k: str) -> Column:
        text = F.get_json_object(col(raw), f"$.{k}")
        return F.when((F.length(text) > 0) & ~F.coalesce(text.try_cast("double") == 0, F.lit(False)), text)

    return F.coalesce(*[usable(k) for k in keys])


def raw_value(raw: Column | str, *keys: str) -> Column:
    """First member that parses as a number."""
    return F.coalesce(*[as_double(F.get_json_object(col(raw), f"$.{k}")) for k in keys])


def raw_value_nonzero(raw: Column | str, *keys: str) -> Column:
    return as_double(raw_text_nonblank(raw, *keys))


def market_cap(raw: Column | str) -> Column:
    return raw_value(raw, "mktCap", "marketCap", "MktCap")


# ----- classification and labels --------------------------------------------------------------

# Industry labels whose balance sheets are deposit- or inventory-funded.
BANK_INDUSTRIES = (
    "Banks",
    "Banks—Regional",
    "Banks—Diversified",
    "Banks - Regional",
    "Banks - Diversified",
    "Credit Services",
    "Financial - Credit Services",
    "Financial - Capital Markets",
    "Capital Markets",
    "Investment - Banking & Investment Services",
)

# Sector name (lower case) to sector fund.
MARKET_FUND = "SPY"
SECTOR_FUNDS = {
    "technology": "XLK",
    "financial services": "XLF",
    "financials": "XLF",
    "healthcare": "XLV",
    "health care": "XLV",
    "energy": "XLE",
    "consumer cyclical": "XLY",
    "consumer discretionary": "XLY",
    "consumer defensive": "XLP",
    "consumer staples": "XLP",
    "industrials": "XLI",
    "industrial": "XLI",
    "communication services": "XLC",
    "utilities": "XLU",
    "real estate": "XLRE",
    "basic materials": "XLB",
    "materials": "XLB",
}


def stock_type(sector: Column | str, industry: Column | str) -> Column:
    trimmed = F.trim(col(industry))
    listed = trimmed.isin(*BANK_INDUSTRIES)
    by_name = (col(sector) == "Financial Services") & trimmed.contains("Bank")
    return F.when(F.coalesce(listed, F.lit(False)) | F.coalesce(by_name, F.lit(False)), "bank").otherwise("general")


def net_revenue(revenue: Column | str, raw: Column | str, kind: Column | str) -> Column:
    """Banks report gross revenue; net it of interest expense where that is known."""
    expense = raw_value(raw, "interestExpense")
    return F.when(col(kind) == "bank", col(revenue) - F.coalesce(expense, F.lit(0.0))).otherwise(col(revenue))


def sector_fund(sector: Column | str) -> Column:
    """Benchmark fund of a sector, the market fund when unknown. A literal map needs no join."""
    mapping = F.create_map(*[F.lit(x) for pair in SECTOR_FUNDS.items() for x in pair])
    found = F.try_element_at(mapping, F.lower(F.trim(col(sector))))
    return F.coalesce(found, F.lit(MARKET_FUND))


def peg_label(peg: Column | str) -> Column:
    peg = col(peg)
    return (
        F.when(peg < 0.5, "deeply_undervalued")
        .when(peg < 1.0, "undervalued")
        .when(peg < 1.5, "fairly_priced")
        .when(peg.isNotNull(), "overvalued")
    )


def spec_hash(expr: Column | str | None, technical: Column | str | None) -> Column:
    def part(c: Column | str | None) -> Column:
        return F.coalesce(F.trim(c if isinstance(c, Column) else F.lit(c)), F.lit(""))

    return F.sha2(F.concat_ws("|", part(expr), part(technical)), 256)


def excerpt(text: Column | str, length: int = 2000) -> Column:
    return F.nullif(F.substring(col(text), 1, length), F.lit(""))


def rsi_value(avg_gain: Column, avg_loss: Column, family: str) -> Column:
    """RSI from smoothed gains and losses; the families differ only when nothing was lost."""
    flat = F.when(avg_gain > 0, F.lit(100.0)).otherwise(F.lit(50.0)) if family == "screen" else F.lit(100.0)
    return F.when(avg_loss == 0, flat).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(avg_gain, avg_loss)))


def any_of(columns: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


# ----- technical bias labels ------------------------------------------------------------------


def rsi_zone(rsi: Column | str) -> Column:
    rsi = col(rsi)
    return (
        F.when(rsi.isNull(), "unknown").when(rsi < 30, "oversold").when(rsi > 70, "overbought").otherwise("neutral")
    )


def trend_bias(fast: Column | str, mid: Column | str, slow: Column | str) -> Column:
    fast, mid, slow = col(fast), col(mid), col(slow)
    return (
        F.when((fast > mid) & (mid > slow), "up").when((fast < mid) & (mid < slow), "down").otherwise("mixed")
    )


def macd_bias(line: Column | str, signal: Column | str, histogram: Column | str) -> Column:
    line, signal, hist = col(line), col(signal), F.coalesce(col(histogram), F.lit(0.0))
    return (
        F.when((line > signal) & (hist > 0), "bullish")
        .when((line < signal) & (hist < 0), "bearish")
        .otherwise("neutral")
    )


def near_extreme(pct_below_high: Column | str, pct_above_low: Column | str) -> Column:
    return (
        F.when(col(pct_below_high) > -5, "near_high").when(col(pct_above_low) < 5, "near_low").otherwise("none")
    )
