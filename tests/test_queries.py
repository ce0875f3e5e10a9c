"""A cross-section of the registered queries against their SQL on the smallest data."""

import pytest

from compare import compare

ROOT = "/root/testdata/sf0.001"
NAMES = [
    "w1_sma", "w4_macd", "w5_rsi", "w9_max_drawdown", "w12_crosses", "w22_realized_vol", "j1_asof_price", "j3_pit_factor", "w23_forward_returns", "r8_rank_correlation",
    "a9_quantile_ties", "a2_group_median", "p1_screen_missing", "p9_flagship_screen", "k3_heal_prices", "k2_upsert", "i9_map_ratios", "v10_dcf", "v12_implied_growth",
    "r6_track_decisions", "a7_collapse_lots", "b3_equity_curve", "b4_position_ledger", "b8_match_orders", "b10_trailing_stop", "a13_performance_metrics", "s4_signal_monitor",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, text = compare(spark, con, ROOT, name)
    assert ok, text


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
