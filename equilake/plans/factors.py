"""Factor research: point-in-time panels, forward returns, rank IC, quantiles, decay, coverage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equilake.functions.predicates import RATIO_FIELDS
from equilake.functions.scalars import safe_div
from equilake.operators.asof import HORIZON_DAYS, asof_price, asof_value, known_value
from equilake.operators.indicators import with_price_factors
from equilake.operators.ranks import rank_correlation, with_quantile_bucket
from equilake.session import spread, store
from equilake.sources.bars import price_series, rebalance_dates


class FactorError(ValueError):
    """Unknown factor, horizon or parameter."""


@dataclass(frozen=True)
class Factor:
    """``direction`` is the expected sign against forward returns; it aligns reports, never the data.

    ``builder(warehouse, universe, dates)`` returns (rebalance_date, symbol, factor).
    """

    name: str
    kind: str
    description: str
    direction: int
    builder: Callable[..., DataFrame]


# Expected direction of the ratio factors.
RATIO_DIRECTION = {
    "roe": 1, "roa": 1, "roic": 1, "fcf_yield": 1, "earnings_yield": 1, "gross_margin": 1, "operating_margin": 1,
    "net_margin": 1, "pe": -1, "pb": -1, "ps": -1, "peg": -1, "ev_ebitda": -1, "debt_equity": -1,
}

_REGISTRY: dict[str, Factor] = {}


def register_factor(name: str, kind: str, builder: Callable[..., DataFrame], direction: int = 0, description: str = "") -> Factor:
    factor = Factor(name, kind, description, direction, builder)
    _REGISTRY[name] = factor
    return factor


def get_factor(name: str) -> Factor:
    if name not in _REGISTRY:
        raise FactorError(f"no factor is called {name!r}; there are {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def factor_registry(spark: SparkSession) -> DataFrame:
    rows = sorted(((f.name, f.kind, f.description, f.direction) for f in _REGISTRY.values()), key=lambda r: (r[1], r[0]))
    return spark.createDataFrame(rows, "name string, kind string, description string, direction int")


# ----- panels ---------------------------------------------------------------------------------


def universe_dates(universe: DataFrame, dates: DataFrame) -> DataFrame:
    """Every symbol on every rebalance date, so a missing value stays a row.

    The dates (a few hundred) are gathered into one array that rides on each symbol row: one
    expansion per symbol, no join of two unbounded sides. The symbols are spread over all tasks first.
    """
    calendar = dates.agg(F.collect_set("rebalance_date").alias("_dates"))
    members = spread(universe.select("symbol").distinct(), "symbol")
    return members.join(F.broadcast(calendar)).select("symbol", F.explode("_dates").alias("rebalance_date"))


def pit_factor(ratios: DataFrame, income: DataFrame, targets: DataFrame, column: str) -> DataFrame:
    """Value of one annual ratio known at each (symbol, rebalance_date).

    Knowledge is gated on the income statement's filing time: the ratio table's own known_at is
    ingestion time and would leak. Of the filings known, the greatest fiscal date decides.
    """
    filed = income.filter("period = 'FY'").select("symbol", "fiscal_date", F.to_date("known_at").alias("known_date"))
    known = ratios.filter("period = 'FY'").select("symbol", "fiscal_date", F.col(column).alias("v")).join(filed, ["symbol", "fiscal_date"])
    points = targets.select("symbol", F.col("rebalance_date").alias("target_date"))
    found = known_value(known, points, value="v")
    return found.select("symbol", F.col("target_date").alias("rebalance_date"), F.col("value").alias("factor"))


def price_factor(prices: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    """A price factor at the bar on or before each date, however old that bar is."""
    series = with_price_factors(price_series(prices))
    points = targets.select("symbol", F.col("rebalance_date").alias("target_date"))
    found = asof_value(points, series, F.col(name), tolerance_days=None, skip_null=False)
    return found.select("symbol", F.col("target_date").alias("rebalance_date"), F.col("value").alias("factor"))


def _ratio_builder(column: str):
    return lambda wh, targets: pit_factor(wh["financial_ratios"], wh["income_statement"], targets, column)


def _price_builder(name: str):
    def build(wh, targets: DataFrame) -> DataFrame:
        prices = wh["daily_prices"].join(wh["universe"].select("symbol"), "symbol", "left_semi")
        return price_factor(prices, targets, name)

    return build


for _field, _column in RATIO_FIELDS.items():
    register_factor(_field, "fundamental", _ratio_builder(_column), RATIO_DIRECTION.get(_field, 0), f"{_column}, as filed")
for _name, _direction, _text in (
    ("momentum_12_1", 1, "price change from 252 to 21 bars ago"),
    ("momentum_6_1", 1, "price change from 126 to 21 bars ago"),
    ("reversal_1m", 1, "minus the 21-bar price change"),
    ("realized_vol_3m", -1, "annualised deviation of 63 daily log returns"),
):
    register_factor(_name, "price", _price_builder(_name), _direction, _text)


def universe_prices(warehouse) -> DataFrame:
    return warehouse["daily_prices"].join(warehouse["universe"].select("symbol"), "symbol", "left_semi")


def factor_panel(warehouse, factor: str, dates: DataFrame) -> DataFrame:
    """(rebalance_date, symbol, factor) for every member and date; missing values stay NULL."""
    targets = universe_dates(warehouse["universe"], dates)
    values = get_factor(factor).builder(warehouse, targets)
    return targets.join(values, ["symbol", "rebalance_date"], "left").select("rebalance_date", "symbol", "factor")


def forward_returns(prices: DataFrame, dates: DataFrame, horizons: dict[str, int] | None = None) -> DataFrame:
    """(rebalance_date, symbol, horizon, fwd_return) with one as-of scan for all horizons."""
    horizons = horizons or HORIZON_DAYS
    symbols = prices.select("symbol").distinct()
    base = universe_dates(symbols, dates)
    steps = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("days")) for h, n in horizons.items()])
    wanted = base.select("symbol", "rebalance_date", F.explode(steps).alias("s")).select(
        "symbol", "rebalance_date", "s.horizon", F.date_add("rebalance_date", F.col("s.days")).alias("target_date"))
    points = wanted.select("symbol", "target_date").unionByName(base.select("symbol", F.col("rebalance_date").alias("target_date")))
    px = asof_price(points, prices)
    at_base = px.select("symbol", F.col("target_date").alias("rebalance_date"), F.col("value").alias("p0"))
    at_end = px.select("symbol", "target_date", F.col("value").alias("p1"))
    out = wanted.join(at_base, ["symbol", "rebalance_date"]).join(at_end, ["symbol", "target_date"])
    return out.select("rebalance_date", "symbol", "horizon", (safe_div("p1", "p0") - 1).alias("fwd_return"))


# ----- statistics -----------------------------------------------------------------------------


def ic_series(panel: DataFrame, forward: DataFrame, min_symbols: int = 5) -> DataFrame:
    """Rank correlation per (rebalance_date, horizon); thin dates and constant inputs give no row."""
    pairs = panel.join(forward, ["rebalance_date", "symbol"])
    ics = rank_correlation(pairs, ["rebalance_date", "horizon"], "factor", "fwd_return", "ic")
    return ics.filter((F.col("n") >= min_symbols) & F.col("ic").isNotNull())


def _ic_aggregates(direction: int) -> list[Column]:
    mean, std, n = F.avg("ic"), F.stddev_samp("ic"), F.count(F.lit(1))
    ir = F.try_divide(mean, std)
    hit = F.col("ic") < 0 if direction < 0 else F.col("ic") > 0
    return [
        mean.alias("mean_ic"), std.alias("ic_std"), ir.alias("ic_ir"), (ir * F.sqrt(n.cast("double"))).alias("t_stat"),
        (F.count_if(hit) / n).alias("hit_rate"), n.alias("n_dates"),
    ]


def ic_summary(ics: DataFrame, direction: int = 0) -> DataFrame:
    """Per horizon: mean, sample deviation, IR, t, hit rate in the expected direction, dates."""
    return ics.groupBy("horizon").agg(*_ic_aggregates(direction))


def ic_decay(ics: DataFrame) -> DataFrame:
    """All horizons from the one IC series, horizons without any usable date included."""
    labels = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("days")) for h, n in HORIZON_DAYS.items()])
    spine = ics.sparkSession.range(1).select(F.explode(labels).alias("s")).select("s.horizon", "s.days")
    stats = ic_summary(ics).select("horizon", "mean_ic", "ic_ir", "n_dates")
    return spine.join(stats, "horizon", "left").select("horizon", "days", "mean_ic", "ic_ir", F.coalesce("n_dates", F.lit(0)).cast("bigint").alias("n_dates"))


def _usable(panel: DataFrame, forward: DataFrame, horizon: str) -> DataFrame:
    fwd = forward.filter(F.col("horizon") == horizon).select("rebalance_date", "symbol", "fwd_return")
    return panel.join(fwd, ["rebalance_date", "symbol"]).filter("factor is not null and fwd_return is not null")


def quantile_returns(panel: DataFrame, forward: DataFrame, horizon: str, buckets: int = 5) -> DataFrame:
    """Per bucket (1 = lowest factor): mean over dates of the per-date mean return, and row count."""
    if buckets < 2:
        raise FactorError("two buckets are the least that can be compared")
    placed = with_quantile_bucket(_usable(panel, forward, horizon), ["rebalance_date"], "factor", "symbol", buckets)
    per_date = placed.groupBy("rebalance_date", "bucket").agg(F.avg("fwd_return").alias("r"), F.count(F.lit(1)).alias("c"))
    return per_date.groupBy("bucket").agg(F.avg("r").alias("mean_return"), F.sum("c").alias("count"))


def quantile_spread(buckets_df: DataFrame, buckets: int, direction: int = 0) -> DataFrame:
    """Top minus bottom bucket, raw and aligned with the expected sign, and the rank correlation of
    bucket number with bucket return. ``buckets_df`` has one row per bucket."""
    tagged = buckets_df.withColumn("g", F.lit(1))
    mono = rank_correlation(tagged.withColumn("b", F.col("bucket").cast("double")), ["g"], "b", "mean_return", "monotonicity")
    ends = tagged.groupBy("g").agg(
        F.max(F.when(F.col("bucket") == buckets, F.col("mean_return"))).alias("top"),
        F.max(F.when(F.col("bucket") == 1, F.col("mean_return"))).alias("bottom"))
    spread = F.col("top") - F.col("bottom")
    aligned = spread * (1 if direction > 0 else -1) if direction else F.lit(None).cast("double")
    return ends.join(mono, "g", "left").select(spread.alias("long_short_spread"), aligned.alias("long_short_spread_aligned"), "monotonicity")


def coverage(panel: DataFrame, forward: DataFrame, horizon: str, kind: str, ic_dates: DataFrame) -> DataFrame:
    """How much of the panel carried information, with warnings. One row.

    ``ic_dates`` is a one-row DataFrame with ``n_dates``, the dates that gave an IC.
    """
    dates = panel.select("rebalance_date").distinct()
    ranked = _usable(panel, forward, horizon).groupBy("rebalance_date").agg(F.count(F.lit(1)).alias("c"))
    per_date = dates.join(ranked, "rebalance_date", "left").agg(
        F.count(F.lit(1)).alias("n_rebalance_dates"), F.avg(F.coalesce("c", F.lit(0))).alias("avg_ranked"),
        F.min(F.coalesce("c", F.lit(0))).alias("min_ranked"), F.max(F.coalesce("c", F.lit(0))).alias("max_ranked"))
    distinct = panel.groupBy("symbol").agg(F.count_distinct("factor").alias("d")).agg(
        F.count(F.lit(1)).alias("universe_size"), F.sum("d").alias("distinct_values"))
    one = per_date.join(F.broadcast(distinct)).join(F.broadcast(ic_dates.select("n_dates")))
    fundamental = kind == "fundamental"
    quasi = F.lit(fundamental) & (F.try_divide("distinct_values", "universe_size") < 3)
    warnings = F.array_compact(F.array(
        F.when(quasi, "quasi-static factor: few distinct filings, t-stat overstated"),
        F.when(F.col("n_dates") < 6, F.concat(F.lit("only "), F.col("n_dates").cast("string"), F.lit(" usable dates"))),
        F.when(F.col("avg_ranked") < 10, "thin cross-section")))
    return one.select(
        F.lit(kind).alias("kind"), "n_rebalance_dates", F.col("n_dates").alias("n_dates_with_ic"), "avg_ranked", "min_ranked", "max_ranked",
        "universe_size", F.when(F.lit(fundamental), F.col("distinct_values")).alias("distinct_observations"),
        quasi.alias("quasi_static"), warnings.alias("warnings"))


class SignalRun:
    """Research of one factor. Panel and forward returns are materialised once, on first use, and
    every report reads those."""

    def __init__(self, warehouse, factor: str, horizon: str = "1m", buckets: int = 5, rebalance: str = "monthly", min_symbols: int = 5):
        if horizon not in HORIZON_DAYS:
            raise FactorError(f"returns are computed {', '.join(HORIZON_DAYS)} ahead, not {horizon!r}")
        if buckets < 2:
            raise FactorError("two buckets are the least that can be compared")
        self.warehouse, self.spec = warehouse, get_factor(factor)
        self.horizon, self.buckets, self.min_symbols = horizon, buckets, min_symbols
        self.prices = universe_prices(warehouse)
        self.dates = rebalance_dates(self.prices, rebalance)

    @cached_property
    def panel(self) -> DataFrame:
        return store(factor_panel(self.warehouse, self.spec.name, self.dates), "panel")

    @cached_property
    def forward(self) -> DataFrame:
        """All horizons; only the IC series and its decay need them."""
        return store(forward_returns(self.prices, self.dates), "forward")

    @cached_property
    def own_forward(self) -> DataFrame:
        """The returns of the run's horizon, computed alone unless all are there already."""
        if "forward" in self.__dict__:
            return self.forward.filter(F.col("horizon") == self.horizon)
        return store(forward_returns(self.prices, self.dates, {self.horizon: HORIZON_DAYS[self.horizon]}), "forward")

    @cached_property
    def ics(self) -> DataFrame:
        return ic_series(self.panel, self.forward, self.min_symbols)

    @cached_property
    def _primary(self) -> DataFrame:
        return ic_series(self.panel, self.own_forward, self.min_symbols)

    @cached_property
    def summary(self) -> DataFrame:
        return ic_summary(self._primary, self.spec.direction)

    @cached_property
    def quantiles(self) -> DataFrame:
        return quantile_returns(self.panel, self.own_forward, self.horizon, self.buckets)

    @cached_property
    def spread(self) -> DataFrame:
        return quantile_spread(self.quantiles, self.buckets, self.spec.direction)

    @cached_property
    def decay(self) -> DataFrame:
        return ic_decay(self.ics)

    @cached_property
    def coverage(self) -> DataFrame:
        n_dates = self._primary.agg(F.count(F.lit(1)).alias("n_dates"))
        return coverage(self.panel, self.own_forward, self.horizon, self.spec.kind, n_dates)


def run_signal(warehouse, factor: str, **options) -> SignalRun:
    return SignalRun(warehouse, factor, **options)
