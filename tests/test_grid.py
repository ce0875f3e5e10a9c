"""Runs side by side against the plans of single curves, and ties of moving averages."""

import random

import pytest
from pyspark.sql import functions as F

from equilake.operators import indicators as ind
from equilake.plans import backtest as bt
from equilake.plans import factors, metrics, orders
from equilake.session import pin_session
from test_operators import bars

RUNS = [bt.Run("sma", "sma_crossover", {"fast": 3, "slow": 8}), bt.Run("rsi", "rsi_reversion", {"period": 5}, size=70), bt.Run("hold", "buy_and_hold")]


def walk(seed, n):
    rng, closes = random.Random(seed), [100.0]
    for _ in range(n - 1):
        closes.append(max(5.0, closes[-1] + rng.randint(-3000, 3000) / 1000))
    return closes


def test_equal_means_do_not_cross(spark):
    # From the 5th bar on, the means of 2 and of 4 closes are the same number.
    history = walk("ties", 300)
    df = bars(spark, history + [100.1, 100.3] * 60)
    last = df.orderBy(F.desc("trade_date")).limit(100).agg(F.min("trade_date")).first()[0]
    signals = bt.strategy_signals(df, [bt.Run("r", "sma_crossover", {"fast": 2, "slow": 4})])
    assert signals.filter((F.col("trade_date") >= last) & (F.col("entry") | F.col("exit"))).count() == 0
    assert signals.filter("entry").count() > 5
    means = ind.with_sma(df, "close", {"f": 2, "s": 4})
    crosses = ind.last_crosses(means, "f", "s", 100, rounding=ind.SMA_ROUNDING).first()
    assert crosses.up_date is None and crosses.down_date is None


@pytest.fixture(scope="module")
def prices(spark):
    return bars(spark, walk("a", 120)).unionByName(bars(spark, walk("b", 90), "B").filter("day(trade_date) <> 7")).cache()


def test_runs_side_by_side_equal_single_curves(spark, prices):
    want = metrics.with_returns(bt.equity_curve(bt.positions_from_signals(bt.strategy_signals(prices, RUNS))), bt.RUN)
    want = ind.with_drawdown(want, "equity", *bt.RUN)
    columns = ["symbol", "run_id", "trade_date", "size", "position", "fill_qty", "fill_price", "commission", "market_value", "equity", "bar_no", "ret", "peak", "drawdown"]
    got = bt.grid_curves(prices, RUNS)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert "run_id" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in x)


def test_days_of_accounts_in_one_pass(spark, prices):
    single = bt.equity_curve(bt.positions_from_signals(bt.strategy_signals(prices, RUNS)))
    curve = bt.portfolio_curve(single)
    want = metrics.exposure_turnover(single.select("run_id", "symbol", "trade_date", "market_value"), curve, ["run_id"]).join(curve, ["run_id", "trade_date"])
    key = lambda r: (r.run_id, r.trade_date)
    got = bt.account_days(bt.grid_curves(prices, RUNS, columns=bt.ACCOUNT))
    pairs = list(zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True))
    for c in ("equity", "long_exposure", "short_exposure", "turnover"):
        assert [a[c] for a, _ in pairs] == pytest.approx([b[c] for _, b in pairs], abs=1e-9)
    trips = orders.drawdown_breaker(single, bt.RUN, 0.002).filter("tripped").groupBy(*bt.RUN).agg(F.min("trade_date").alias("d"))
    got = {(r.symbol, r.run_id): r.tripped_on for r in orders.tripped_on(bt.grid_curves(prices, RUNS, columns=("equity", "peak")), bt.RUN, 0.002).collect()}
    assert got and got == {(r.symbol, r.run_id): r.d for r in trips.collect()}


def test_symbols_are_spread_before_dates_multiply_them(spark):
    symbols = spark.range(200).select(F.format_string("S%d", "id").alias("symbol"))
    dates = spark.range(50).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("rebalance_date"))
    tasks = factors.universe_dates(symbols, dates).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in tasks) == 10_000
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 5_000


def test_partitions_are_many_and_merged_to_a_small_size(spark):
    pin_session(spark)
    # 3 million short rows: well below the usual 64 MB in a shuffle, far more than one task should sort.
    dealt = spark.range(3_000_000).select("id", F.concat(F.lit("account "), (F.col("id") % 7).cast("string")).alias("k")).repartition("id")
    assert dealt.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] <= 3_000_000 / 2
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 400
