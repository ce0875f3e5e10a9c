"""The warehouse: named DataFrames, read from Parquet or derived from a star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilake.session import pin_session, store
from equilake.sources import bridge


class Warehouse:
    """Lazy access to tables by name: ``wh.daily_prices``, ``wh["profiles"]``."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self._tables = dict(tables or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._load(name)
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def _load(self, name: str) -> DataFrame:
        raise KeyError(f"no table {name!r}")

    def share(self, *names: str) -> Warehouse:
        """Store tables that several others are derived from, so that each is computed once.

        Call it before the tables that depend on them are used.
        """
        for name in names:
            self._tables[name] = store(self[name], name)
        return self

    def with_tables(self, **tables: DataFrame) -> Warehouse:
        """The same warehouse with some tables replaced."""
        clone = object.__new__(type(self))
        clone.__dict__.update(self.__dict__)
        clone._tables = {**self._tables, **tables}
        return clone

    @staticmethod
    def from_parquet(spark: SparkSession, root: str) -> ParquetWarehouse:
        return ParquetWarehouse(spark, root)

    @staticmethod
    def from_star_schema(spark: SparkSession, root: str) -> StarSchemaWarehouse:
        return StarSchemaWarehouse(spark, root)

    def materialize(self, root: str, names: list[str], time_column: dict[str, str] | None = None) -> None:
        """Write tables as Parquet; a table with a time column is partitioned by its year.

        Rows are clustered by symbol inside each year so that per-symbol reads touch few row
        groups; the rebalance lets AQE split an oversized partition.
        """
        time_column = time_column or {}
        for name in names:
            df = self[name]
            writer_cols: list[str] = []
            if name in time_column:
                df = df.withColumn("part_year", F.year(time_column[name]))
                writer_cols = ["part_year"]
                df = df.hint("rebalance", "part_year")
            if "symbol" in df.columns:
                df = df.sortWithinPartitions(*writer_cols, "symbol")
            df.write.mode("errorifexists").partitionBy(*writer_cols).parquet(f"{root}/{name}")


class ParquetWarehouse(Warehouse):
    """One Parquet directory per table."""

    def __init__(self, spark: SparkSession, root: str):
        pin_session(spark)
        super().__init__(spark)
        self._root = root.rstrip("/")

    def _load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._root}/{name}")


class StarSchemaWarehouse(Warehouse):
    """Tables derived from ``<root>/<source>.parquet`` by :mod:`equilake.sources.bridge`."""

    def __init__(self, spark: SparkSession, root: str):
        pin_session(spark)
        super().__init__(spark)
        self._root = root.rstrip("/")

    def _load(self, name: str) -> DataFrame:
        if name in bridge.SOURCE_TABLES:
            return self.spark.read.parquet(f"{self._root}/{name}.parquet")
        if name not in bridge.TABLES:
            return super()._load(name)
        text = bridge.TABLES[name]
        return self.spark.sql(text, **{ref: self[ref] for ref in bridge._refs(text)})
