import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilake.operators import indicators as ind
from equilake.operators import ranks
from equilake.operators import recurrence as rec
from equilake.operators.asof import asof_price, asof_price_open, known_value
from equilake.operators.screen import resolve, technical_flags
from equilake.operators.upsert import append_run, clean_doubles, heal_outcome, heal_prices, insert_if_absent, replace_table, upsert
from equilake.functions.predicates import ScreenError

D0 = dt.date(2024, 1, 1)


def bars(spark, closes, symbol="A", volumes=None):
    volumes = volumes or [1000] * len(closes)
    rows = [(symbol, D0 + dt.timedelta(days=i), None if c is None else float(c), v) for i, (c, v) in enumerate(zip(closes, volumes))]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, close double, volume bigint")
    return df.withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1, "adj_close": F.lit(None).cast("double")})


def series(df, name):
    return [r[name] for r in df.orderBy("trade_date").collect()]


def test_sma_is_poisoned_by_a_gap_but_extremes_are_not(spark):
    df = bars(spark, [1, 2, None, 4, 5, 6])
    assert series(ind.with_sma(df, "close", {"m": 2}), "m") == [None, 1.5, None, None, None, None]
    assert series(df.withColumn("m", ind.rolling(F.max, "close", 2)), "m") == [None, 2.0, None, None, 5.0, 6.0]


def wilder(values, n, family):
    out, gains, losses = [None] * len(values), [], []
    for a, b in zip(values, values[1:]):
        gains.append(max(b - a, 0.0)), losses.append(max(a - b, 0.0))
    if len(values) <= n:
        return out
    g, l = sum(gains[:n]) / n, sum(losses[:n]) / n
    for i in range(n, len(values)):
        if i > n:
            g, l = (g * (n - 1) + gains[i - 1]) / n, (l * (n - 1) + losses[i - 1]) / n
        out[i] = 100 - 100 / (1 + g / l) if l else (100.0 if g > 0 or family == "engine" else 50.0)
    return out


def test_recurrences_equal_a_plain_loop(spark):
    rng = random.Random(3)
    closes = [100.0]
    for _ in range(120):
        closes.append(closes[-1] + rng.uniform(-2, 2))
    specs = [rec.Recurrence("e", "ema", n=10), rec.Recurrence("r", "rsi"), rec.Recurrence("m", "macd"), rec.Recurrence("a", "atr", n=5)]
    got = rec.with_recurrences(bars(spark, closes), specs).orderBy("trade_date").toPandas()
    e = sum(closes[:10]) / 10
    for i in range(10, len(closes)):
        e = 2 / 11 * closes[i] + 9 / 11 * e
        assert got["e"][i] == pytest.approx(e, abs=1e-9)
    for want, have in zip(wilder(closes, 14, "screen"), got["r"]):
        assert (want is None and np.isnan(have)) or have == pytest.approx(want, abs=1e-9)
    assert np.isnan(got["m_signal"][32]) and not np.isnan(got["m_signal"][33])


@pytest.mark.parametrize("family,flat", [("screen", 50.0), ("engine", 100.0)])
def test_rsi_families_differ_on_a_flat_series(spark, family, flat):
    got = series(rec.with_recurrences(bars(spark, [5.0] * 20), [rec.Recurrence("r", "rsi", family=family)]), "r")
    assert got[-1] == flat and got[13] is None


def test_macd_families_differ_in_the_signal_threshold(spark):
    df = bars(spark, [float(i) for i in range(34)])
    screen = rec.with_recurrences(df, [rec.Recurrence("m", "macd")])
    engine = rec.with_recurrences(df, [rec.Recurrence("m", "macd", family="engine")])
    assert series(screen, "m_signal")[-1] is not None and series(engine, "m_signal")[-1] is None


def test_finite_macd_weights_equal_the_seeded_averages():
    rng = np.random.default_rng(1)
    closes = rng.normal(100, 5, 35)
    line, signal, _ = rec.macd(closes, 12, 26, 9, "engine")
    wl, ws = ind.finite_macd_weights(12, 26, 9)
    assert line[-1] == pytest.approx(float(np.dot(wl, closes)), abs=1e-9)
    assert signal[-1] == pytest.approx(float(np.dot(ws, closes)), abs=1e-9)


def test_drawdown_dates(spark):
    row = ind.max_drawdown(bars(spark, [10, 12, 9, 12, 6, 8]), "close").first()
    assert row.max_drawdown_pct == pytest.approx(-50.0)
    assert row.peak_date == D0 + dt.timedelta(days=1) and row.trough_date == D0 + dt.timedelta(days=4)
    flat = ind.max_drawdown(bars(spark, [1, 2, 3]), "close").first()
    assert flat.max_drawdown_pct == 0.0 and flat.peak_date is None


def test_technical_predicates(spark):
    rising = bars(spark, list(range(1, 301)), volumes=[100] * 299 + [1000])
    flags = technical_flags(rising, [("above_sma", [200]), ("near_52w_high", []), ("volume_spike", []), ("rsi_overbought", []), ("below_sma", [20])]).first().asDict()
    assert flags["above_sma_200"] and flags["near_52w_high_5p0"] and flags["volume_spike_20_2p0"] and flags["rsi_overbought_1_70p0"]
    assert not flags["below_sma_20"] and not flags["passes"]
    short = technical_flags(bars(spark, [1, 2, 3]), [("near_52w_low", [5]), ("above_sma", [20])]).first()
    assert not short.passes
    for bad in ([("nope", [])], [("above_sma", [])], [("above_sma", [1, 2])], [("above_sma", ["x"])], []):
        with pytest.raises(ScreenError):
            resolve(bad)


def test_asof_variants(spark):
    px = bars(spark, [10, None, 30])
    targets = spark.createDataFrame([("A", D0 + dt.timedelta(days=n)) for n in (-1, 1, 2, 5, 6)], "symbol string, target_date date")
    factor = {r.target_date: r.value for r in asof_price(targets, px).collect()}
    assert factor == {D0 - dt.timedelta(1): None, D0 + dt.timedelta(1): 10.0, D0 + dt.timedelta(2): 30.0, D0 + dt.timedelta(5): 30.0, D0 + dt.timedelta(6): None}
    ledger = {r.target_date: r.value for r in asof_price(targets, px, variant="ledger").collect()}
    assert ledger[D0 + dt.timedelta(1)] is None
    opened = {r.target_date: r.value for r in asof_price_open(targets, px).collect()}
    assert opened[D0 - dt.timedelta(1)] == 30.0 and opened[D0 + dt.timedelta(6)] == 30.0


def test_knowledge_is_gated_and_may_arrive_out_of_order(spark):
    known = spark.createDataFrame(
        [("A", dt.date(2020, 12, 31), 1.0, dt.date(2022, 6, 1)), ("A", dt.date(2021, 12, 31), None, dt.date(2022, 3, 1))],
        "symbol string, fiscal_date date, v double, known_date date")
    days = spark.createDataFrame([("A", dt.date(2022, 1, 1)), ("A", dt.date(2022, 4, 1)), ("A", dt.date(2022, 7, 1))], "symbol string, target_date date")
    got = {r.target_date.month: r.value for r in known_value(known.withColumn("v", F.coalesce("v", F.lit(2.0))), days, value="v").collect()}
    assert got == {1: None, 4: 2.0, 7: 2.0}
    # The newest fiscal date decides even when its value is missing.
    assert {r.target_date.month: r.value for r in known_value(known, days, value="v").collect()}[7] is None


def test_order_statistics_against_brute_force(spark):
    rng = random.Random(5)
    # One group holds most rows and one value holds a third of them.
    rows = [("hot" if i % 5 else "cold", f"S{i}", 0.0 if i % 3 == 0 else rng.choice([-1, 1]) * math.exp(rng.uniform(-9, 9)), rng.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, symbol string, v double, w double")
    pdf = df.toPandas()
    median = {r.g: r.m for r in ranks.group_median(df, ["g"], "v", "m").collect()}
    for g, part in pdf.groupby("g"):
        assert median[g] == pytest.approx(part["v"].median())
    ranked = ranks.with_average_rank(df, ["g"], "v", "r").toPandas().set_index("symbol")["r"]
    for g, part in pdf.groupby("g"):
        want = part.set_index("symbol")["v"].rank()
        assert (ranked[want.index] - want).abs().max() < 1e-9
    rho = {r.g: r.c for r in ranks.rank_correlation(df, ["g"], "v", "w", "c").collect()}
    for g, part in pdf.groupby("g"):
        assert rho[g] == pytest.approx(part["v"].rank().corr(part["w"].rank()), abs=1e-12)
    placed = ranks.with_quantile_bucket(df, ["g"], "v", "symbol", 7).toPandas()
    assert len(placed) == 600
    for g, part in placed.groupby("g"):
        sizes = part.groupby("bucket").size().tolist()
        assert sizes == [len(x) for x in np.array_split(np.arange(len(part)), 7)]
        edges = part.groupby("bucket")["v"].agg(["min", "max"])
        assert (edges["max"].to_numpy()[:-1] <= edges["min"].to_numpy()[1:]).all()


def test_constant_input_has_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(6)], "g string, x double, y double")
    assert ranks.rank_correlation(df, ["g"], "x", "y", "c").first().c is None


def prices(spark, rows):
    return spark.createDataFrame(
        [(s, d, c, c, c, c, a, 1, dt.datetime(2024, 1, k)) for s, d, c, a, k in rows],
        "symbol string, trade_date date, open double, high double, low double, close double, adj_close double, volume bigint, known_at timestamp")


def test_heal_window(spark):
    day = lambda n: D0 + dt.timedelta(days=n)
    stored = prices(spark, [("A", day(0), 1.0, 1.0, 1), ("A", day(5), 2.0, 2.0, 1), ("A", day(10), 3.0, 3.0, 1)])
    incoming = prices(spark, [("A", day(0), 9.0, 9.0, 2), ("A", day(5), 8.0, None, 2), ("A", day(11), 7.0, 7.0, 2), ("B", day(1), 5.0, None, 2)])
    state, actions = heal_prices(stored, incoming)
    rows = {(r.symbol, r.trade_date): r for r in state.collect()}
    assert rows["A", day(0)].close == 1.0 and rows["A", day(5)].close == 8.0 and rows["A", day(5)].adj_close == 2.0
    assert rows["A", day(5)].known_at == dt.datetime(2024, 1, 1) and rows["A", day(11)].close == 7.0 and rows["B", day(1)].close == 5.0
    out = {r.symbol: (r.upserted, r.skipped) for r in heal_outcome(actions).collect()}
    assert out == {"A": (2, 1), "B": (1, 0)}
    again, _ = heal_prices(state, incoming)
    assert sorted(again.collect()) == sorted(state.collect())


def test_upsert_and_insert_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 4)], "k string, v int")
    once = upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(upsert(once, new, ["k"]).collect()) == sorted(once.collect())
    assert sorted(map(tuple, insert_if_absent(old, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 4)]


def test_replace_universe_keeps_securities(spark):
    u = spark.createDataFrame([("A",), ("B",)], "symbol string")
    s = spark.createDataFrame([("A", True, dt.datetime(2020, 1, 1))], "symbol string, is_active boolean, first_seen_at timestamp")
    out = replace_table(u, s, spark.createDataFrame([("B",), ("C",)], "symbol string"))
    diff = {r.symbol: (r.status, r.is_new_security) for r in out["diff"].collect()}
    assert diff == {"A": ("removed", False), "B": ("kept", True), "C": ("added", True)}
    assert sorted(r.symbol for r in out["securities"].collect()) == ["A", "B", "C"]


def test_runs_share_one_id_and_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    assert sorted(r.x is None for r in clean_doubles(df).collect()) == [False, True, True]
    stamped = append_run(df, "signal", {"a": "1"}, " x ", None).select("run_id", "expr_hash").distinct().collect()
    assert len(stamped) == 1


def test_crowded_values_keep_exact_ranks(spark, monkeypatch):
    """Half of all values within one percent, in one group: the cells are full and the values are cut by range."""
    import random

    from equilake.operators import prefix, ranks

    monkeypatch.setattr(ranks, "CROWDED", 20)
    monkeypatch.setattr(prefix, "SUM_BITS", 4)
    rng = random.Random(2)
    rows = [("g", 100.0 + rng.randrange(400) / 400) for _ in range(600)] + [("g", rng.uniform(-500, 500)) for _ in range(500)] + [("h", float(i % 3)) for i in range(50)] + [("g", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r.g, r.v): (r.ties, r.before, r.n) for r in ranks.value_positions(df, ["g"], "v").collect()}
    for g in "gh":
        values = sorted(v for k, v in rows if k == g and v is not None)
        for v in set(values):
            assert got[g, v] == (values.count(v), sum(x < v for x in values), len(values))
    assert len(got) == len({(g, v) for g, v in rows if g and v is not None})
    medians = {r.g: r.m for r in ranks.group_median(df, ["g"], "v", "m").collect()}
    import statistics

    assert all(medians[g] == pytest.approx(statistics.median([v for k, v in rows if k == g and v is not None])) for g in "gh")


def test_runs_are_compared_in_one_plan(spark):
    from equilake.operators.screen import diff_runs

    runs = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "Y"), ("b", "Z"), ("b", "Y"), ("empty", None)], "run_id string, symbol string")
    status = lambda x, y: {r.symbol: r.status for r in diff_runs(runs, x, y).collect()}
    assert status("a", "b") == {"X": "removed", "Y": "kept", "Z": "added"}
    assert status("empty", "a") == {"X": "added", "Y": "added"} and status("a", "empty") == {"X": "removed", "Y": "removed"} and status("empty", "empty") == {}
    with pytest.raises(Exception, match="no stored run has the id gone"):
        diff_runs(runs, "a", "gone").collect()


def test_tables_of_the_catalog(spark):
    from equilake.operators.upsert import table_status

    spark.range(3).createOrReplaceTempView("daily_prices")
    assert {r.table: r.present for r in table_status(spark, ["daily_prices", "holdings"]).collect()} == {"daily_prices": True, "holdings": False}
    spark.catalog.dropTempView("daily_prices")


def test_a_benchmark_is_one_series(spark):
    from equilake.plans import metrics

    day = D0
    equity = spark.createDataFrame([("r", day + dt.timedelta(i), 100.0 + i) for i in range(5)], "run_id string, trade_date date, equity double")
    bench = spark.createDataFrame([(day + dt.timedelta(i), 50.0 + i) for i in range(5)], "trade_date date, close double")
    assert metrics.relative_metrics(equity, bench, ["run_id"]).first().benchmark_return == pytest.approx(4 / 50)
    with pytest.raises(Exception, match="one series"):
        metrics.relative_metrics(equity, bench.union(bench), ["run_id"]).collect()


def test_normal_distribution_function(spark):
    import math

    from equilake.plans.metrics import normal_cdf

    xs = [-40.0, -8.0, -5.0, -1.5, -1e-9, 0.0, 0.3, 2.0, 6.0, 8.4, 40.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=1e-14)
    assert spark.range(1).select(normal_cdf(F.lit(None).cast("double")).alias("p")).first().p is None
