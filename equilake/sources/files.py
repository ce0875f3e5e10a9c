"""Flat-file readers. All of them keep malformed rows visible instead of failing the job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equilake.functions.scalars import as_date, as_double, as_long
from equilake.operators.prefix import affine_scan, lag_scan, numbered, sum_scan

HOLDING_REQUIRED = ("account_id", "symbol", "quantity", "as_of_date")
HOLDING_NUMERIC = ("avg_cost", "mark_price", "market_value")
HOLDING_TEXT = ("asset_category", "sub_category", "currency", "description", "side")


class SourceError(ValueError):
    """A file that cannot be read at all (a missing header, for instance)."""


#: A quoted text after its opening quote; doubled quotes stand for one.
_QUOTED = r'(?:[^"]++|"")*+"'


def _records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file, file_name, value, block, n: the records of delimited files, in the order (block, n) within a file.

    A record is a line, unless a cell's quotes hold line breaks. Whether a line begins inside quotes depends on all lines before it; each line is a map of
    that state (0 or 1) to the state at its end, and the maps are composed by a prefix scan, so one long file is split over many tasks.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.withColumn("n", F.monotonically_increasing_id())

    def opens(text: Column) -> Column:
        closed = F.regexp_replace(text, sep + r'[ \t]*+"' + _QUOTED, sep.replace("\\", ""))
        return closed.rlike(sep + r'[ \t]*+"').cast("double")

    outside = opens(F.concat(F.lit(sep.replace("\\", "")), F.col("value")))
    if lines.where(outside == 1).isEmpty():
        return lines
    rest = F.regexp_replace("value", "^" + _QUOTED, "")
    inside = F.when(F.col("value").rlike("^" + _QUOTED), opens(rest)).otherwise(1.0)
    rows, most = numbered(lines.withColumns({"_a": inside - outside, "_b1": outside}), ["file"], ["block", "n"])
    rows = affine_scan(rows, ["file"], most, "_a", "_b1")
    # A file begins outside quotes: B is the state after a line.
    rows = lag_scan(rows, ["file"], most, "B", "_before").withColumn("_starts", F.when(F.coalesce("_before", F.lit(0.0)) == 0, 1).otherwise(0))
    rows = sum_scan(rows, ["file"], most, {"record": "_starts"})
    whole = rows.groupBy("file", "file_name", "record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return whole.select("file", "file_name", "value", F.lit(0).cast("bigint").alias("block"), F.col("record").alias("n"))


def _by_name(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The rows of delimited files as a map from each file's own header names (trimmed, lower case) to texts.

    Files of one folder may have their columns in any order. A file's header is its first record that is not blank; headers are a row per file,
    joined by the file name, which AQE broadcasts where they are few. Of columns with the same name the first counts. Quoted cells may hold separators, doubled quotes and
    line breaks. Cells are cut in one pass over a record.
    """
    sep = "\\|" if sep == "|" else sep
    rows = _records(spark, path, sep).filter(F.trim("value") != "")
    # The first record is the one of the file's first block with the least number.
    heads = rows.filter("block = 0").groupBy("file").agg(F.min(F.struct("n", "value")).alias("head"))

    def split(c: Column) -> Column:
        cells = F.regexp_extract_all(F.concat(F.lit(sep.replace("\\", "")), c), F.lit(sep + r'[ \t]*+"' + _QUOTED + f"[^{sep}]*+|{sep}[^{sep}]*+"), F.lit(0))
        trimmed = F.transform(cells, lambda x: F.trim(F.substr(x, F.lit(2))))
        return F.transform(trimmed, lambda x: F.when(x.rlike(r'(?s)^".*"$'), F.replace(F.regexp_replace(x, r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))).otherwise(x))

    # Names are cut once a file; where none repeats (found in linear time) no cell is looked up among them.
    names = F.transform(split(F.regexp_replace("head.value", "^\ufeff", "")), lambda x: F.lower(F.trim(x)))
    heads = heads.select("file", F.col("head.n").alias("head_n"), names.alias("names")).withColumn("plain", F.size(F.array_distinct("names")) == F.size("names"))
    rows = rows.join(heads, "file").filter((F.col("block") > 0) | (F.col("n") > F.col("head_n"))).withColumn("texts", split(F.col("value")))
    zipped = F.arrays_zip(F.col("names").alias("k"), F.col("texts").alias("v"))
    named = lambda e: e["k"].isNotNull() & (e["k"] != "")
    keyed = F.when(F.col("plain"), F.filter(zipped, named)).otherwise(F.filter(zipped, lambda e, i: named(e) & (F.array_position("names", e["k"]) == i + 1)))
    return rows.select("file_name", "names", F.map_from_entries(F.transform(keyed, lambda e: F.struct(e["k"], e["v"]))).alias("cells"))


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """One ticker per line; blanks and # comments dropped, upper-cased, distinct."""
    line = F.trim("value")
    return (
        spark.read.text(path).filter((line != "") & ~line.startswith("#")).select(F.upper(line).alias("symbol")).distinct()
    )


def read_ohlcv_csv(spark: SparkSession, directory: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """One ``<SYMBOL>.csv`` per symbol with Date,Open,High,Low,Close,Volume."""
    cell = lambda name: F.try_element_at("cells", F.lit(name))
    bars = _by_name(spark, f"{directory}/*.csv").select(
        F.upper(F.regexp_extract("file_name", r"^(.*)\.csv$", 1)).alias("symbol"), as_date(cell("date")).alias("trade_date"),
        *[as_double(cell(c)).alias(c) for c in ("open", "high", "low", "close")], as_long(cell("volume")).alias("volume"))
    if start is not None:
        bars = bars.filter(F.col("trade_date") >= F.lit(start))
    if end is not None:
        bars = bars.filter(F.col("trade_date") <= F.lit(end))
    return bars


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def read_holdings_csv(spark: SparkSession, path: str, account: str | None = None, as_of: dt.date | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) holdings. ``account`` and ``as_of`` fill rows that carry no value."""
    raw = _by_name(spark, path)
    allowed = {"account_id"} if account else set()
    allowed |= {"as_of_date"} if as_of else set()
    needed = F.array(*[F.lit(c) for c in HOLDING_REQUIRED if c not in allowed])
    lacking = raw.select(F.array_except(needed, "names").alias("absent")).filter(F.size("absent") > 0).first()
    if lacking:
        raise SourceError(f"columns not in a file's header: {sorted(lacking.absent)}")

    def text(name: str) -> Column:
        return _blank(F.try_element_at("cells", F.lit(name)))

    quantity = as_double(text("quantity"))
    as_of_date = F.coalesce(as_date(text("as_of_date")), F.lit(as_of).cast("date"))
    account_id = F.coalesce(text("account_id"), F.lit(account))
    reason = (
        F.when(account_id.isNull(), "missing account_id").when(text("symbol").isNull(), "missing symbol")
        .when(quantity.isNull(), "bad quantity").when(as_of_date.isNull(), "bad as_of_date")
    )
    typed = raw.select(
        account_id.alias("account_id"), text("symbol").alias("symbol"), as_of_date.alias("as_of_date"),
        F.coalesce(text("asset_category"), F.lit("STK")).alias("asset_category"), text("sub_category").alias("sub_category"),
        quantity.alias("quantity"), *[as_double(text(c)).alias(c) for c in HOLDING_NUMERIC],
        F.coalesce(text("side"), F.when(quantity >= 0, "Long").otherwise("Short")).alias("side"),
        text("currency").alias("currency"), text("description").alias("description"), F.lit("csv").alias("source"),
        F.to_json("cells").alias("raw"), reason.alias("reason"),
    )
    return typed.filter("reason is null").drop("reason"), typed.filter("reason is not null").select("raw", "reason")


BROKER_ATTRIBUTES = {
    "OpenPosition": (
        "accountId", "symbol", "reportDate", "assetCategory", "subCategory", "position", "markPrice", "positionValue",
        "costBasisPrice", "costBasisMoney", "fifoPnlUnrealized", "percentOfNAV", "side", "currency", "fxRateToBase",
        "conid", "listingExchange", "description", "levelOfDetail"),
    "Trade": (
        "accountId", "ibExecID", "tradeID", "symbol", "conid", "assetCategory", "subCategory", "description", "tradeDate",
        "dateTime", "buySell", "quantity", "tradePrice", "proceeds", "netCash", "ibCommission", "fifoPnlRealized",
        "openCloseIndicator", "orderReference", "exchange", "currency", "fxRateToBase", "notes", "code"),
}


def read_broker_xml(spark: SparkSession, path: str, row: str = "OpenPosition") -> DataFrame:
    """Statement rows, one column per attribute; no such section means no rows."""
    names = BROKER_ATTRIBUTES[row]
    schema = ", ".join(f"`_{n}` string" for n in names)
    df = spark.read.format("xml").option("rowTag", row).option("attributePrefix", "_").schema(schema).load(path)
    return df.select(*[F.col(f"_{n}").alias(n) for n in names])


def read_short_interest(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited settlement files; the settlement date is the yyyyMMdd in the file name."""
    raw = _by_name(spark, path, "|")

    def text(*names: str) -> Column:
        return F.coalesce(*[_blank(F.try_element_at("cells", F.lit(n.lower()))) for n in names])

    def number(name: str) -> Column:
        return as_double(F.regexp_replace(text(name), ",", ""))

    settlement = as_date(F.regexp_extract("file_name", r"(\d{8})", 1))
    return raw.select(
        F.upper(text("symbolCode", "Symbol")).alias("symbol"), settlement.alias("settlement_date"),
        number("currentShortPositionQuantity").alias("short_interest"),
        number("previousShortPositionQuantity").alias("previous_short_interest"),
        number("changePercent").alias("change_pct"), number("averageDailyVolumeQuantity").alias("avg_daily_volume"),
        number("daysToCoverQuantity").alias("days_to_cover"), text("issueName", "securityName").alias("security_name"),
    ).filter("symbol is not null")
