import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from equilake.sources import files, vendor
from equilake.streaming import jobs


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_watchlist(spark, tmp_path):
    path = write(tmp_path, "w.txt", "# mine\naapl\n\n MSFT \nAAPL\n")
    assert sorted(r.symbol for r in files.read_watchlist(spark, path).collect()) == ["AAPL", "MSFT"]


def test_ohlcv_folder(spark, tmp_path):
    write(tmp_path, "abc.csv", "Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,100\n2024-02-02,1,2,0.5,1.6,100\n")
    got = files.read_ohlcv_csv(spark, str(tmp_path), end=dt.date(2024, 1, 31)).collect()
    assert [(r.symbol, r.close, r.volume) for r in got] == [("ABC", 1.5, 100)]


def test_holdings_csv_splits_rejects(spark, tmp_path):
    path = write(tmp_path, "h.csv", "Account_ID,Symbol,Quantity,As_Of_Date,avg_cost\nU1,X,-5,2024-01-31,abc\nU1,Y,many,2024-01-31,1\nU1,Z,1,,1\n")
    good, bad = files.read_holdings_csv(spark, path)
    row = good.first()
    assert (row.symbol, row.side, row.avg_cost, row.asset_category) == ("X", "Short", None, "STK")
    assert sorted(r.reason for r in bad.collect()) == ["bad as_of_date", "bad quantity"]
    filled, _ = files.read_holdings_csv(spark, path, as_of=dt.date(2024, 2, 1))
    assert filled.count() == 2
    with pytest.raises(files.SourceError):
        files.read_holdings_csv(spark, write(tmp_path, "x.csv", "a,b\n1,2\n"))


def test_broker_xml(spark, tmp_path):
    xml = """<FlexQueryResponse><FlexStatements><FlexStatement><OpenPositions>
    <OpenPosition accountId="U1" symbol="X" reportDate="20240105" position="10" markPrice="3"/><OpenPosition accountId="" symbol="Y" reportDate="20240105" position="1"/>
    </OpenPositions></FlexStatement></FlexStatements></FlexQueryResponse>"""
    path = write(tmp_path, "s.xml", xml)
    good, bad = vendor.map_positions(files.read_broker_xml(spark, path))
    row = good.first()
    assert (row.account_id, row.as_of_date, row.quantity) == ("U1", dt.date(2024, 1, 5), 10.0)
    assert [r.reason for r in bad.collect()] == ["missing account_id"]
    assert files.read_broker_xml(spark, path, "Trade").count() == 0


def test_short_interest_file(spark, tmp_path):
    path = write(tmp_path, "shrt20240115.csv", " symbolCode | currentShortPositionQuantity |daysToCoverQuantity\nabc| 1,234 |x\n|5|1\n")
    got = files.read_short_interest(spark, path).collect()
    assert [(r.symbol, r.settlement_date, r.short_interest, r.days_to_cover) for r in got] == [("ABC", dt.date(2024, 1, 15), 1234.0, None)]


def ticks(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 10)
    rows = [("A", t0 + dt.timedelta(minutes=m), 10.0 + (m * 7) % 13, 1) for m in range(0, 300, 9)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, volume int")
    df.write.parquet(str(tmp_path / "ticks"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "ticks"))


def drain(stream, tmp_path, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(90)
    return stream.sparkSession.table(name)


def test_stream_bars_equal_batch(spark, tmp_path):
    batch, stream = ticks(spark, tmp_path)
    got = drain(jobs.stream_bars(stream, "1 hour"), tmp_path, "complete", "bars_out")
    assert sorted(got.collect()) == sorted(jobs.bars_from_ticks(batch, "1 hour").collect())


def test_stream_dedupe_and_freshness(spark, tmp_path):
    batch, _ = ticks(spark, tmp_path)
    batch.unionByName(batch).write.parquet(str(tmp_path / "twice"))
    twice = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "twice"))
    assert drain(jobs.stream_dedupe(twice, ["symbol", "ts"], "ts", "1 day"), tmp_path, "append", "dedupe_out").count() == batch.count()
    scoped = twice.withColumn("scope", F.lit("quote"))
    newest = drain(jobs.stream_freshness(scoped), tmp_path, "complete", "fresh_out").first()
    assert newest.latest == batch.agg(F.max("ts")).first()[0]


def test_signal_monitor(spark):
    t0 = dt.datetime(2024, 1, 1, 10)
    m = lambda n: t0 + dt.timedelta(minutes=n)
    signals = spark.createDataFrame(
        [(1, "A", "buy", 12.0, 8.0, m(1), m(100), "open", None), (2, "A", "buy", 99.0, 9.5, m(1), m(100), "open", None), (3, "A", "sell", 5.0, 99.0, m(1), m(2), "open", None),
         (4, "A", "buy", 99.0, 1.0, m(1), m(100), "open", None), (5, "A", "buy", 11.0, 1.0, m(1), m(100), "closed", m(0))],
        "signal_id int, symbol string, direction string, target_price double, stop_loss double, created_at timestamp, expires_at timestamp, status string, closed_at timestamp")
    quotes = spark.createDataFrame([("A", m(0), 50.0), ("A", m(3), 9.0), ("A", m(4), 12.5)], "symbol string, ts timestamp, price double")
    got = {r.signal_id: (r.status, r.closed_at) for r in jobs.resolve_signals(signals, quotes).collect()}
    assert got == {1: ("target_hit", m(4)), 2: ("stopped_out", m(3)), 3: ("expired", m(2)), 4: ("open", None), 5: ("closed", m(0))}


def test_readers_map_each_file_by_its_own_header(spark, tmp_path):
    from equilake.sources.files import read_holdings_csv, read_ohlcv_csv, read_short_interest

    short, bars_, held = tmp_path / "short", tmp_path / "bars", tmp_path / "held"
    for d in (short, bars_, held):
        d.mkdir()
    (short / "x20240115.csv").write_text("symbolCode|currentShortPositionQuantity|issueName\nA|1,000|Alpha\n")
    (short / "x20240131.csv").write_text("issueName|currentShortPositionQuantity|symbolCode\nBeta|300|B\n")
    got = {r.symbol: (r.short_interest, r.security_name, str(r.settlement_date)) for r in read_short_interest(spark, str(short)).collect()}
    assert got == {"A": (1000.0, "Alpha", "2024-01-15"), "B": (300.0, "Beta", "2024-01-31")}
    (bars_ / "aa.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,4,0.5,2,10\n")
    (bars_ / "bb.csv").write_text("Date,Close,Open,High,Low,Volume\n2024-01-02,2,1,4,0.5,10.0\n")
    got = [(r.open, r.high, r.low, r.close, r.volume) for r in read_ohlcv_csv(spark, str(bars_)).orderBy("symbol").collect()]
    assert got == [(1.0, 4.0, 0.5, 2.0, 10)] * 2
    (held / "1.csv").write_text('account_id,symbol,quantity,as_of_date,description\nU1,A,5,2024-01-02,"a, ""b"""\n')
    (held / "2.csv").write_text("as_of_date,quantity,symbol,account_id\n2024-01-02,7,B,U1\n")
    good, bad = read_holdings_csv(spark, str(held))
    assert {r.symbol: (r.quantity, r.description) for r in good.collect()} == {"A": (5.0, 'a, "b"'), "B": (7.0, None)} and bad.count() == 0


def test_quoted_line_breaks_and_repeated_names(spark, tmp_path, monkeypatch):
    """Records over several lines, quotes inside plain cells, doubled quotes at the edges, names that repeat: as the csv module reads them."""
    import csv
    import io

    from equilake.operators import prefix
    from equilake.sources.files import _by_name

    monkeypatch.setattr(prefix, "SUM_BITS", 3)
    body = "a,b, A ,c\n" + "".join(
        f'{i},"line {i}\nnext ""x"",\n\n{"end" if i % 3 else ""}",second,{"5 inch" if i % 2 else "7"}\n' if i % 4 == 0 else f'{i},plain 3" pipe,"x,y",\n' if i % 4 == 1 else f'{i},"""all""","a ""b""\n""c""",z\n' if i % 4 == 2 else f"{i},,,\n"
        for i in range(60))
    (tmp_path / "one.csv").write_text(body)
    (tmp_path / "two.csv").write_text("b,a\nx,1000\n")
    want = sorted((r[0], r[1], r[3]) for r in list(csv.reader(io.StringIO(body)))[1:]) + [("1000", "x", None)]
    got = [(r.cells["a"], r.cells["b"], r.cells.get("c")) for r in _by_name(spark, str(tmp_path / "*.csv")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_long_line_is_read_in_linear_time(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("Account_ID,Symbol,Quantity,As_Of_Date," + ",".join(f"c{i}" for i in range(20_000)) + "\n" + "U1,X,5,2024-01-31," + ",".join(f'"v,{i}"' for i in range(20_000)) + "\n")
    start = time.perf_counter()
    good, _ = files.read_holdings_csv(spark, str(tmp_path / "wide.csv"))
    assert [(r.account_id, r.quantity) for r in good.collect()] == [("U1", 5.0)]
    assert time.perf_counter() - start < 60


def test_a_cluster_without_a_shared_folder_is_an_error():
    from equilake.session import one_machine

    assert one_machine("local[8]") and one_machine("local")
    assert not one_machine("local-cluster[3,2,1000]") and not one_machine("yarn") and not one_machine("spark://h:7077")
