"""Wall-clock of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (rounds over all queries, default 3, after one
warm-up of the session), BENCH_SECONDS (no further round is begun that would end later, default 500), BENCH_QUERIES (comma-separated names).
The queries of a round run in an order of its own; the seconds are medians. Beside them stand the MB that a query wrote to shared storage.
"""

from __future__ import annotations

import json
import os
import random
import statistics
import time
from pathlib import Path

from equilake.queries import QUERIES
from equilake.session import build_session, shared_folder

HEADLINE = [
    "w1_sma", "w3_ema", "w9_max_drawdown", "w16_technical_snapshot", "j1_asof_price", "j5_symbol_state", "p9_flagship_screen", "r7_factor_panel_momentum",
    "r8_ic_series_momentum", "a9_quantile_returns", "v16_value_companies", "r6_track_decisions", "a3_scorecard_sector", "a6_portfolio_summary", "a7_collapse_lots",
    "b4_position_ledger", "b8_match_orders", "b17_run_backtests", "k3_heal_prices",
]


def stored_mb(spark) -> float:
    """MB in the folder of intermediate tables."""
    folder = shared_folder(spark).removeprefix("file:")
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file()) / 1e6


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    rounds = int(os.environ.get("BENCH_RUNS", "3"))
    limit = float(os.environ.get("BENCH_SECONDS", "500"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # One warm-up of the scan and of the Python workers.
    QUERIES["w3_ema"](spark, root).write.format("noop").mode("overwrite").save()
    times: dict[str, list[float]] = {n: [] for n in names}
    written: dict[str, float] = {}
    begun, longest = time.perf_counter(), 0.0
    for k in range(rounds):
        if k and time.perf_counter() - begun + longest > limit:
            break
        round_begun = time.perf_counter()
        for name in random.Random(k).sample(names, len(names)):
            before = stored_mb(spark)
            start = time.perf_counter()
            QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            times[name].append(time.perf_counter() - start)
            written[name] = round(stored_mb(spark) - before, 1)
        longest = max(longest, time.perf_counter() - round_begun)
    seconds = {n: round(statistics.median(t), 3) for n, t in times.items()}
    print(json.dumps({
        "metric": "headline queries, total wall-clock", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(root.rstrip("/")),
        "runs": len(times[names[0]]), "stored_mb": written}))
    spark.stop()


if __name__ == "__main__":
    main()
