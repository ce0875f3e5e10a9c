"""A stored table that is kept by month: a change rewrites the months it touches and no other file.

Layout under a folder: `data/<version>/month=YYYY-MM/...` (written once, never changed), `newest/<version>` (symbol, newest date)
and `manifest/version=N`, a row for each month with the folder that holds it. A version counts once its manifest is there: Spark's
committer moves that single file into place last, so a reader sees the version before or the version after, and files of a run that broke off
are never referred to. The manifest also names the stream and the epoch that made a version, and an epoch that is there already is not applied again.

One writer at a time (one streaming query) is assumed. A manifest folder without a committed file is what a writer left that broke off; it is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equilake.operators.upsert import clean_doubles

_MANIFEST = "stream string, epoch bigint, month string, folder string, version bigint"
_NEWEST = "newest"


@dataclass(frozen=True)
class Version:
    """What a manifest says: the folder of each month, the folder of the newest dates, the last epoch of each stream."""

    number: int
    months: dict[str, str]
    newest: str | None
    epochs: dict[str, int]


class MonthTable:
    """A table with a date column, one row per key, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, date: str = "trade_date", symbol: str = "symbol"):
        self.spark, self.root, self.schema, self.date, self.symbol = spark, root.rstrip("/"), schema, date, symbol

    # The manifest has a row a month and a row a stream: bounded by the calendar, so the driver may hold it.
    def version(self) -> Version:
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest")
            last = rows.agg(F.max("version")).first()[0]
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        if last is None:
            return Version(0, {}, None, {})
        found = rows.where(F.col("version") == last).collect()
        folders = {r.month: r.folder for r in found if r.month}
        return Version(last, {m: f for m, f in folders.items() if m != _NEWEST}, folders.get(_NEWEST), {r.stream: r.epoch for r in found if r.stream is not None})

    def _months(self, version: Version, months: list[str]) -> DataFrame:
        folders = [version.months[m] for m in months if m in version.months]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as it is now."""
        version = self.version()
        return self._months(version, sorted(version.months))

    def newest(self, version: Version | None = None) -> DataFrame:
        """symbol, newest: the newest stored date of each symbol, without a look at the data."""
        version = version or self.version()
        schema = T.StructType([self.schema[self.symbol], T.StructField("newest", self.schema[self.date].dataType)])
        return self.spark.read.schema(schema).parquet(version.newest) if version.newest else self.spark.createDataFrame([], schema)

    def apply(self, batch: DataFrame, step: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], stream: str, epoch: int) -> bool:
        """Make the next version from a batch: ``step(stored rows of the touched months, batch, newest dates)`` gives those months anew. False: applied before."""
        version = self.version()
        if epoch <= version.epochs.get(stream, -1):
            return False
        month = F.date_format(self.date, "yyyy-MM")
        touched = sorted(r[0] for r in batch.where(F.col(self.date).isNotNull()).select(month).distinct().collect())
        name = uuid.uuid4().hex
        folders, newest = dict(version.months), version.newest
        if touched:
            state = clean_doubles(step(self._months(version, touched), batch, self.newest(version)))
            data = f"{self.root}/data/{name}"
            state.select(*self.schema.names, month.alias("month")).repartition("month", F.pmod(F.xxhash64(self.symbol), F.lit(8))).write.partitionBy("month").parquet(data)
            folders |= {m: f"{data}/month={m}" for m in touched}
            written = self._months(Version(0, folders, None, {}), touched)
            dates = self.newest(version).unionByName(written.groupBy(self.symbol).agg(F.max(self.date).alias("newest")))
            newest = f"{self.root}/newest/{name}"
            dates.groupBy(self.symbol).agg(F.max("newest").alias("newest")).write.parquet(newest)
        rows = [(None, None, m, f) for m, f in folders.items()] + ([(None, None, _NEWEST, newest)] if newest else [])
        rows += [(s, e, None, None) for s, e in {**version.epochs, stream: epoch}.items()]
        manifest = self.spark.createDataFrame(rows, "stream string, epoch bigint, month string, folder string")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version.number + 1}")
        return True
