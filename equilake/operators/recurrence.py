"""Seeded recurrences (EMA, MACD, Wilder RSI and ATR): one Arrow pass per symbol for all of them.

A recurrence over a whole history has no window form. A symbol's bars are bounded by the calendar,
so a group is a few thousand rows; every requested indicator is computed in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Recurrence:
    """``kind`` in ema, rsi, atr, macd; ``family`` picks the screen or engine conventions."""

    name: str
    kind: str
    col: str = "close"
    n: int = 14
    fast: int = 12
    slow: int = 26
    signal: int = 9
    family: str = "screen"

    def columns(self) -> list[str]:
        return [f"{self.name}_line", f"{self.name}_signal", f"{self.name}_hist"] if self.kind == "macd" else [self.name]


def smooth(values: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Mean of the first n values, then x' = x + alpha (v - x). A gap ends the series."""
    out = np.full(len(values), np.nan)
    if len(values) < n or n <= 0:
        return out
    seeded = np.concatenate([[values[:n].mean()], values[n:]])
    out[n - 1 :] = pd.Series(seeded).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    gaps = np.flatnonzero(np.isnan(values))
    if len(gaps):
        out[gaps[0] :] = np.nan
    return out


def ema(values: np.ndarray, n: int) -> np.ndarray:
    return smooth(values, n, 2.0 / (n + 1))


def macd(values: np.ndarray, fast: int, slow: int, signal: int, family: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema(values, fast) - ema(values, slow)
    sig = np.full(len(values), np.nan)
    start = slow - 1
    enough = np.count_nonzero(~np.isnan(line)) >= signal if family == "screen" else len(values) > start + signal
    if enough:
        sig[start:] = ema(line[start:], signal)
    return line, sig, line - sig


def rsi(values: np.ndarray, n: int, family: str) -> np.ndarray:
    out = np.full(len(values), np.nan)
    if len(values) <= n:
        return out
    change = np.diff(values)
    gain = smooth(np.where(np.isnan(change), np.nan, np.maximum(change, 0.0)), n, 1.0 / n)
    loss = smooth(np.where(np.isnan(change), np.nan, np.maximum(-change, 0.0)), n, 1.0 / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 100.0 - 100.0 / (1.0 + gain / loss)
    flat = np.where(gain > 0, 100.0, 50.0) if family == "screen" else np.where(np.isnan(gain), np.nan, 100.0)
    out[1:] = np.where(loss == 0, flat, value)
    return out


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    if len(close) < 2:
        return np.full(len(close), np.nan)
    previous = np.concatenate([[np.nan], close[:-1]])
    spread = np.vstack([high - low, np.abs(high - previous), np.abs(low - previous)])
    true_range = np.where(np.arange(len(close)) == 0, high - low, spread.max(axis=0))
    return smooth(true_range, n, 1.0 / n)


def with_recurrences(bars: DataFrame, specs: Sequence[Recurrence], keep: Sequence[str] = (), keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``keys``, trade_date, the ``keep`` columns and one column per requested output."""
    needed = {s.col for s in specs if s.kind != "atr"}
    if any(s.kind == "atr" for s in specs):
        needed |= {"high", "low", "close"}
    inputs = [*keys, "trade_date", *sorted((needed | set(keep)) - set(keys) - {"trade_date"})]
    kept = [*keys, "trade_date", *keep]
    outputs = [c for s in specs for c in s.columns()]
    schema = T.StructType([*[bars.schema[c] for c in kept], *[T.StructField(c, T.DoubleType()) for c in outputs]])
    plan = tuple(specs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date", ignore_index=True)
        data = {c: pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in needed}
        out = pdf[kept].copy()
        for s in plan:
            if s.kind == "ema":
                result = (ema(data[s.col], s.n),)
            elif s.kind == "rsi":
                result = (rsi(data[s.col], s.n, s.family),)
            elif s.kind == "atr":
                result = (atr(data["high"], data["low"], data["close"], s.n),)
            else:
                result = macd(data[s.col], s.fast, s.slow, s.signal, s.family)
            for name, values in zip(s.columns(), result):
                # Missing is NULL, not NaN: Spark orders NaN above every number.
                out[name] = pd.Series(values).astype("Float64").mask(np.isnan(values))
        return out

    return bars.select(*inputs).groupBy(*keys).applyInPandas(run, schema)
