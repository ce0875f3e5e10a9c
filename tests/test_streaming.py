"""Streams over files, batch by batch: signals with timers, month tables with a restart, late rows and state."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from equilake.operators.upsert import heal_prices, insert_news
from equilake.streaming import jobs
from equilake.streaming.monitor import STATE_STORE, signal_events, stream_signal_monitor
from equilake.streaming.months import MonthTable
from test_operators import D0, prices

T0 = dt.datetime(2024, 1, 1, 10)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def files(spark, tmp_path, name, frames):
    """A stream that reads one frame a micro-batch, in order of the files' times."""
    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(str(tmp_path / name / str(i)))
        for f in (tmp_path / name / str(i)).glob("part-*"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))


def drain(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return stream.sparkSession.table(name), q


# -- signals -----------------------------------------------------------------------------------

SIGNALS = "signal_id int, symbol string, direction string, target_price double, stop_loss double, created_at timestamp, expires_at timestamp, status string, closed_at timestamp"


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, STATE_STORE)
    yield
    spark.conf.unset(key)


def test_signal_stream_equals_batch(spark, tmp_path, state_store):
    """Quotes out of order within the delay, a signal after its first quotes, an untouched symbol, a stop and a target at one instant."""
    signals = spark.createDataFrame(
        [(1, "A", "buy", 12.0, 8.0, at(1), at(100), "open", None), (2, "A", "buy", 99.0, 9.5, at(1), at(100), "open", None), (3, "A", "sell", 5.0, 99.0, at(1), at(2), "open", None),
         (4, "A", "buy", 99.0, None, at(1), at(900), "open", None), (5, "B", "buy", 11.0, 1.0, at(1), at(50), "open", None), (6, "A", "buy", 12.5, 12.5, at(2), at(90), "open", None), (7, "A", "buy", 1.0, 0.0, at(1), at(9), "closed", at(0))],
        SIGNALS)
    quote = "symbol string, ts timestamp, price double"
    batches = [
        spark.createDataFrame([("A", at(0), 50.0), ("A", at(4), 12.5)], quote),
        spark.createDataFrame([("A", at(3), 9.0)], quote),
        spark.createDataFrame([("C", at(200), 1.0)], quote),
        spark.createDataFrame([("A", at(6), 0.1), ("C", at(201), 1.0)], quote),  # the first is too late
        spark.createDataFrame([("C", at(400), 1.0)], quote)]
    events = [signal_events(signals if i == 1 else signals.limit(0), q) for i, q in enumerate(batches)]
    stream = files(spark, tmp_path, "events", events)
    made = stream.where("signal_id is not null").select(
        "signal_id", "symbol", "direction", F.col("target").alias("target_price"), F.col("stop").alias("stop_loss"), F.col("ts").alias("created_at"), F.timestamp_micros("expires").alias("expires_at"), F.lit("open").alias("status"))
    seen = stream.where("price is not null").select("symbol", "ts", "price")
    got, query = drain(stream_signal_monitor(made, seen, "30 minutes"), tmp_path, "monitor")
    on_time = [batches[0], batches[1], batches[2], batches[4]]
    all_quotes = on_time[0].union(on_time[1]).union(on_time[2]).union(on_time[3])
    want = jobs.resolve_signals(signals, all_quotes, now=at(370)).where("status not in ('open', 'closed')")
    rows = sorted((r.signal_id, r.status, r.closed_at) for r in got.collect())
    assert rows == sorted((r.signal_id, r.status, r.closed_at) for r in want.collect())
    assert rows == [(1, "target_hit", at(4)), (2, "stopped_out", at(3)), (3, "expired", at(2)), (5, "expired", at(50)), (6, "stopped_out", at(3))]


def test_signals_of_a_hot_symbol_equal_a_loop(spark):
    """Most ticks and most signals on one symbol; lives of minutes to many days, hits at their edges."""
    import random

    rng = random.Random(6)
    quotes = [("HOT", at(rng.randrange(0, 20_000)) + dt.timedelta(seconds=rng.randrange(60)), round(rng.uniform(90, 110), 1)) for _ in range(1500)] + [("B", at(i * 500), 100.0 + i) for i in range(20)]
    signals = []
    for i in range(300):
        made = at(rng.randrange(0, 15_000)) + dt.timedelta(seconds=rng.randrange(60))
        side = rng.choice(["buy", "sell"])
        levels = rng.choice([(108.5, 91.0), (104.0, 89.0), (150.0, 50.0), (None, 95.0)])
        signals.append((i, "HOT" if i % 10 else "B", side, *(levels if side == "buy" else (levels[1], levels[0])), made, made + dt.timedelta(minutes=rng.choice([0, 3, 200, 9000])), "open", None))
    got = {r.signal_id: (r.status, r.closed_at) for r in jobs.resolve_signals(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(quotes, "symbol string, ts timestamp, price double")).collect()}
    for i, symbol, side, target, stop, made, ends, *_ in signals:
        seen = sorted((t, p) for s, t, p in quotes if s == symbol)
        hits = []
        for t, p in seen:
            if made <= t <= ends:
                if stop is not None and (p <= stop if side == "buy" else p >= stop):
                    hits.append((t, 0))
                if target is not None and (p >= target if side == "buy" else p <= target):
                    hits.append((t, 1))
        want = (("stopped_out", "target_hit")[min(hits)[1]], min(hits)[0]) if hits else ("expired", ends) if seen[-1][0] > ends else ("open", None)
        assert got[i] == want, i


# -- month tables ------------------------------------------------------------------------------

def day(n):
    return D0 + dt.timedelta(n)


def parts(table):
    return {m: sorted(glob.glob(f"{f}/part-*")) for m, f in table.version().months.items()}


def test_month_table_rewrites_touched_months_only(spark, tmp_path):
    first = prices(spark, [("A", day(0), 1.0, 1.0, 1), ("A", day(40), 2.0, 2.0, 1), ("B", day(40), 7.0, 7.0, 1)])
    later = prices(spark, [("A", day(39), 3.0, None, 2), ("A", day(40), 4.0, 4.0, 2), ("A", day(0), 9.0, 9.0, 2), ("C", day(41), 5.0, 5.0, 2)])
    last = prices(spark, [("A", day(75), 6.0, 6.0, 3)])
    table = MonthTable(spark, str(tmp_path / "prices"), first.schema)
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    want = first.limit(0)
    for i, batch in enumerate([first, last, later]):
        batch.coalesce(1).write.mode("append").parquet(folder)
        before = parts(table)
        jobs.stream_heal_prices(spark.readStream.schema(first.schema).parquet(folder), table, checkpoint).awaitTermination(120)
        want = heal_prices(want, batch)[0]
        rows = want.collect()
        assert sorted(table.read().collect()) == sorted(rows), i
        want = spark.createDataFrame(rows, first.schema)
        touched = {r[0] for r in batch.select(F.date_format("trade_date", "yyyy-MM")).distinct().collect()}
        after = parts(table)
        assert all(after[m] == f for m, f in before.items() if m not in touched)
        assert all(after[m] != before.get(m) for m in touched)


def test_a_replayed_epoch_changes_nothing(spark, tmp_path):
    """A stop after the manifest was written but before the stream noted the epoch: the batch comes again."""
    bars = prices(spark, [("A", day(0), 1.0, 1.0, 1)])
    table = MonthTable(spark, str(tmp_path / "prices"), bars.schema)
    step = lambda stored, new, newest: stored.unionByName(new.select(*stored.columns))
    assert table.apply(bars, step, "s", 0)
    number, before = table.version().number, parts(table)
    assert not table.apply(bars, step, "s", 0)
    assert (table.version().number, parts(table), table.read().count()) == (number, before, 1)
    # A writer that broke off leaves folders that nothing refers to.
    (tmp_path / "prices" / "manifest" / "version=2" / "_temporary").mkdir(parents=True)
    assert table.read().count() == 1
    assert table.apply(bars.withColumn("symbol", F.lit("B")), step, "other", 0) and table.read().count() == 2
    assert table.version().epochs == {"s": 0, "other": 0}


def test_news_stream_keeps_one_headline(spark, tmp_path):
    schema = "symbol string, published_at timestamp, url string, title string"
    rows = [[("A", at(0), "u", "x"), ("A", at(0), "u", "x"), ("A", None, "u", "x")], [("A", at(0), "u", "again"), ("A", at(60 * 24 * 40), "v", "y")]]
    frames = [spark.createDataFrame(r, schema) for r in rows]
    table = MonthTable(spark, str(tmp_path / "news"), frames[0].schema, "published_at")
    want = frames[0].limit(0)
    for i, batch in enumerate(frames):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_news(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "cp")).awaitTermination(120)
        want = spark.createDataFrame(insert_news(want, batch).collect(), schema)
        assert sorted(table.read().collect()) == sorted(want.collect())


# -- watermarks --------------------------------------------------------------------------------

def test_bars_in_append_mode_drop_late_ticks_and_their_state(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double, volume int"
    frames = [spark.createDataFrame(r, schema) for r in (
        [("A", at(0), 1.0, 1), ("A", at(59), 2.0, 1)], [("A", at(130), 5.0, 1), ("A", at(30), 9.0, 1)], [("A", at(300), 6.0, 1)], [("A", at(40), 99.0, 1), ("A", at(301), 6.0, 1)], [("A", at(600), 7.0, 1)])]
    stream = files(spark, tmp_path, "ticks", frames)
    got, query = drain(jobs.stream_bars(stream, "1 hour", "1 hour"), tmp_path, "late_bars")
    on_time = frames[0].union(frames[1]).union(frames[2]).union(frames[3].where("price < 90")).union(frames[4])
    want = jobs.bars_from_ticks(on_time, "1 hour").where(F.col("bar_end") <= F.lit(at(540)))
    assert sorted(got.collect()) == sorted(want.collect())
    # The closed hours are gone from the state; only the last one is held.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_dedupe_forgets_old_keys(spark, tmp_path):
    schema = "key string, ts timestamp"
    frames = [spark.createDataFrame(r, schema) for r in ([("a", at(0)), ("b", at(1))], [("a", at(5)), ("c", at(300))], [("d", at(600))])]
    got, query = drain(jobs.stream_dedupe(files(spark, tmp_path, "keys", frames), ["key"], "ts", "1 hour"), tmp_path, "keys_out")
    assert sorted(r.key for r in got.collect()) == ["a", "b", "c", "d"]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 4


def test_freshness_forgets_quiet_keys(spark, tmp_path):
    schema = "scope string, symbol string, ts timestamp"
    frames = [spark.createDataFrame(r, schema) for r in ([("q", "A", at(0)), ("q", "B", at(1))], [("q", "A", at(10_000))], [("q", "A", at(10_001)), ("q", "B", at(10_002))])]
    got, query = drain(jobs.stream_freshness(files(spark, tmp_path, "fresh", frames), forget="1 day"), tmp_path, "fresh_out", "update")
    newest = {(r.symbol): r.latest for r in got.groupBy("symbol").agg(F.max("latest").alias("latest")).collect()}
    assert newest == {"A": at(10_001), "B": at(10_002)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
