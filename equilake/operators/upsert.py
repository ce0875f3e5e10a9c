"""Table maintenance on immutable Parquet: every write makes a new snapshot.

Built-in tables have no MERGE, so each operator returns the next table state (and the outcome of
every incoming row); ``write_snapshot`` puts it under a fresh path, never over the one being read.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equilake.functions.scalars import nan_to_null, spec_hash
from equilake.operators.latest import top_n_per_key


def total_order(df: DataFrame, order: Sequence[Column] = ()) -> list[Column]:
    """``order`` completed by the whole row as text, so that a winner never depends on the order of tasks."""
    return [*order, F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row a key: the first by ``order``, then by the row's text."""
    return top_n_per_key(df, list(keys), total_order(df, order), 1)


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Stored rows plus incoming rows with unseen keys; of duplicate incoming keys the first by ``order`` is added."""
    fresh = first_per_key(incoming.join(target.select(*keys).distinct(), list(keys), "left_anti"), keys, order)
    return target.unionByName(fresh.select(*target.columns))


def insert_outcome(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of added and skipped incoming rows per symbol."""
    seen = target.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return incoming.join(seen, list(keys), "left").groupBy("symbol").agg(
        F.count_if(F.col("_seen").isNull()).alias("added"), F.count_if(F.col("_seen").isNotNull()).alias("skipped"))


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Incoming rows replace stored rows of the same key.

    ``order`` breaks ties between incoming duplicates (first wins). The group limit runs before the
    shuffle, so many versions of one key cost one row per task.
    """
    both = target.withColumn("_src", F.lit(1)).unionByName(incoming.select(*target.columns).withColumn("_src", F.lit(0)))
    return first_per_key(both, keys, [F.col("_src"), *order]).drop("_src")


def heal_prices(target: DataFrame, incoming: DataFrame, heal_days: int = 7, newest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Next daily_prices state and the action taken for each incoming bar.

    New dates are inserted; stored bars within ``heal_days`` of the symbol's newest stored bar are
    corrected, keeping a stored adj_close when the incoming one is missing and always keeping
    known_at; older stored bars are immutable. ``newest`` (symbol, newest) says the newest stored dates where
    ``target`` is a part of the table only.
    """
    if newest is None:
        newest = target.groupBy("symbol").agg(F.max("trade_date").alias("newest"))
    floor = newest.select("symbol", F.date_sub("newest", heal_days).alias("heal_floor"))
    new = first_per_key(incoming, ["symbol", "trade_date"])
    old_cols = [F.col(c).alias(f"old_{c}") for c in target.columns if c not in ("symbol", "trade_date")]
    stored = target.select("symbol", "trade_date", *old_cols, F.lit(True).alias("_old"))
    merged = (
        stored.join(new.withColumn("_new", F.lit(True)), ["symbol", "trade_date"], "full_outer")
        .join(floor, "symbol", "left")
    )
    action = (
        F.when(F.col("_new").isNull(), "keep")
        .when(F.col("_old").isNull(), "insert")
        .when(F.col("trade_date") >= F.col("heal_floor"), "heal")
        .otherwise("skip")
    )
    merged = merged.withColumn("action", action)
    takes_new = F.col("action").isin("insert", "heal")

    def pick(name: str) -> Column:
        if name == "known_at":
            return F.coalesce(F.col("old_known_at"), F.col("known_at")).alias(name)
        if name == "adj_close":
            return F.when(takes_new, F.coalesce(F.col(name), F.col("old_adj_close"))).otherwise(F.col("old_adj_close")).alias(name)
        return F.when(takes_new, F.col(name)).otherwise(F.col(f"old_{name}")).alias(name)

    cols = [c for c in target.columns if c not in ("symbol", "trade_date")]
    state = merged.select("symbol", "trade_date", *[pick(c) for c in cols])
    actions = merged.filter(F.col("_new").isNotNull()).select("symbol", "trade_date", "action")
    return state.select(*target.columns), actions


def heal_outcome(actions: DataFrame) -> DataFrame:
    return actions.groupBy("symbol").agg(
        F.count_if(F.col("action") != "skip").alias("upserted"), F.count_if(F.col("action") == "skip").alias("skipped"))


def membership_diff(current: DataFrame, target: DataFrame, key: str = "symbol") -> DataFrame:
    """Every member of either set with status added, removed or kept."""
    left = current.select(key).distinct().withColumn("_a", F.lit(True))
    right = target.select(key).distinct().withColumn("_b", F.lit(True))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("kept")
    return left.join(right, key, "full_outer").select(key, status.alias("status"))


def replace_table(universe: DataFrame, securities: DataFrame, target: DataFrame) -> dict[str, DataFrame]:
    """New universe, securities grown by unseen symbols (none is ever deleted), and the diff."""
    wanted = target.dropDuplicates(["symbol"])
    diff = membership_diff(universe, wanted)
    known = securities.select("symbol").distinct().withColumn("_known", F.lit(True))
    diff = diff.join(known, "symbol", "left").withColumn(
        "is_new_security", (F.col("status") != "removed") & F.col("_known").isNull()).drop("_known")
    unseen = wanted.join(securities.select("symbol"), "symbol", "left_anti").select(
        "symbol", F.lit(True).alias("is_active"), F.current_timestamp().alias("first_seen_at"))
    return {
        "universe": wanted,
        "securities": securities.select("symbol", "is_active", "first_seen_at").unionByName(unseen),
        "diff": diff,
    }


def insert_news(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Headlines not yet stored, one per (symbol, instant, url). Timestamps compare as UTC instants."""
    keys = ["symbol", "published_at", "url"]
    complete = incoming.filter(
        (F.length("symbol") > 0) & F.col("published_at").isNotNull() & (F.length("url") > 0))
    return insert_if_absent(target, complete, keys)


def append_run(df: DataFrame, kind: str, params: dict[str, str], expr: str | None = None, technical: str | None = None) -> DataFrame:
    """Rows stamped as one immutable run. The id is drawn once on the driver, so a retried task
    writes the same id."""
    now = dt.datetime.now(dt.timezone.utc)
    pairs = [F.lit(str(x)) for kv in sorted(params.items()) for x in kv]
    param_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.withColumns({
        "run_id": F.lit(str(uuid.uuid4())), "kind": F.lit(kind), "ran_at": F.lit(now),
        "run_date": F.lit(now.date()), "params": param_map, "expr_hash": spec_hash(expr, technical),
    })


def write_run(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("run_date").parquet(path)


def clean_doubles(df: DataFrame) -> DataFrame:
    """NaN and infinities of every double column to NULL."""
    doubles = {f.name: nan_to_null(f.name) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(doubles) if doubles else df


def write_snapshot(df: DataFrame, root: str, name: str) -> str:
    """Write a new snapshot of a table and return its path; readers switch to it afterwards."""
    path = f"{root.rstrip('/')}/{name}/snapshot={uuid.uuid4().hex}"
    clean_doubles(df).write.mode("errorifexists").parquet(path)
    return path


def refresh_summary(outcomes: DataFrame) -> DataFrame:
    """Per scope: symbols ok and failed, rows upserted and skipped."""
    return outcomes.groupBy("scope").agg(
        F.count_if(F.col("error").isNull()).alias("ok"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.sum("upserted"), F.lit(0)).cast("bigint").alias("upserted"),
        F.coalesce(F.sum("skipped"), F.lit(0)).cast("bigint").alias("skipped"),
    )


def failure_reasons(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("error").isNotNull()).groupBy("scope", "error").agg(F.count(F.lit(1)).alias("symbols"))


def table_status(spark, expected: Sequence[str], database: str | None = None) -> DataFrame:
    """Expected tables and whether the catalog has them."""
    present = {t.name for t in spark.catalog.listTables(database)}
    return spark.createDataFrame([(n, n in present) for n in expected], "table string, present boolean")
