"""Building blocks for fundamental screens.

A screen is an ordinary Boolean Column. Its leaves are two-valued: a comparison with a missing
operand is False (so its negation is True), which plain SQL three-valued logic would not give.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Screen field -> (warehouse table, column).
SCREEN_FIELDS: dict[str, tuple[str, str]] = {
    "sector": ("profiles", "sector"),
    "industry": ("profiles", "industry"),
    "country": ("profiles", "country"),
    "beta": ("profiles", "beta"),
    "market_cap": ("profiles", "raw"),
    "pe": ("financial_ratios", "pe_ratio"),
    "peg": ("financial_ratios", "peg_ratio"),
    "pb": ("financial_ratios", "price_to_book"),
    "ps": ("financial_ratios", "price_to_sales"),
    "ev_ebitda": ("financial_ratios", "ev_to_ebitda"),
    "current_ratio": ("financial_ratios", "current_ratio"),
    "debt_equity": ("financial_ratios", "debt_to_equity"),
    "roe": ("financial_ratios", "return_on_equity"),
    "roa": ("financial_ratios", "return_on_assets"),
    "roic": ("financial_ratios", "return_on_invested_capital"),
    "gross_margin": ("financial_ratios", "gross_margin"),
    "operating_margin": ("financial_ratios", "operating_margin"),
    "net_margin": ("financial_ratios", "net_margin"),
    "fcf_yield": ("financial_ratios", "fcf_yield"),
    "earnings_yield": ("financial_ratios", "earnings_yield"),
    "close": ("daily_prices", "close"),
}
TEXT_FIELDS = ("sector", "industry", "country")
RATIO_FIELDS = {f: c for f, (t, c) in SCREEN_FIELDS.items() if t == "financial_ratios"}

_ORDERINGS = {
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "==": operator.eq,
    "!=": operator.ne,
}


class ScreenError(ValueError):
    """Unknown field, operator or argument."""


def field(name: str) -> Column:
    """A named screen field; a name outside the registry is an error before anything runs."""
    if name not in SCREEN_FIELDS:
        raise ScreenError(f"unknown field {name!r} (valid: {', '.join(sorted(SCREEN_FIELDS))})")
    return F.col(name)


def check_fields(df: DataFrame) -> None:
    missing = sorted(set(SCREEN_FIELDS) - set(df.columns))
    if missing:
        raise ScreenError(f"symbol state lacks {missing}")


def _operand(value) -> tuple[Column, bool]:
    """(column, is_text). Field names must be wrapped with ``field``; anything else is a literal."""
    if isinstance(value, Column):
        return value, False
    return F.lit(value), isinstance(value, str)


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def cmp(left, op: str, right) -> Column:
    """``left op right``, False when either side is missing or the types cannot be ordered."""
    if op not in _ORDERINGS:
        raise ScreenError(f"unknown operator {op!r}")
    names = {x for x in (left, right) if isinstance(x, _FieldName)}
    texts = [x in TEXT_FIELDS if isinstance(x, _FieldName) else isinstance(x, str) for x in (left, right)]
    lhs, rhs = (field(x) if isinstance(x, _FieldName) else _operand(x)[0] for x in (left, right))
    if names and texts[0] != texts[1]:
        both = lhs.isNotNull() & rhs.isNotNull()
        return _false(both) if op == "!=" else F.lit(False)
    return _false(_ORDERINGS[op](lhs, rhs))


class _FieldName(str):
    """A field reference inside the helper functions."""


def fld(name: str) -> _FieldName:
    field(name)
    return _FieldName(name)


def chain(*parts) -> Column:
    """``chain(5, "<", fld("pe"), "<", 25)``: every adjacent comparison must hold."""
    if len(parts) < 3 or len(parts) % 2 == 0:
        raise ScreenError("a chain alternates operands and operators")
    out = F.lit(True)
    for i in range(0, len(parts) - 2, 2):
        out = out & cmp(parts[i], parts[i + 1], parts[i + 2])
    return out


def is_in(left, values: Sequence | _FieldName) -> Column:
    """Membership; a missing operand is not a member. Against a text field it is a substring test."""
    lhs = field(left) if isinstance(left, _FieldName) else _operand(left)[0]
    if isinstance(values, _FieldName):
        return _false(field(values).contains(lhs))
    return _false(lhs.isin(*values)) if values else F.lit(False)


def not_in(left, values: Sequence | _FieldName) -> Column:
    """True for a missing left operand, as it is in no list."""
    return ~is_in(left, values)


def truthy(name: str | _FieldName) -> Column:
    """A bare field in Boolean position: present and neither zero nor empty."""
    c = field(name)
    return _false(c != "") if name in TEXT_FIELDS else _false(c != 0)
