"""Quality rules of documents, and verdicts of hosts from shrunk failure rates. DataFrame functions only.

Per document: words, characters in words, symbols, repeated lines and words in repeated 3-word windows. A document fails on its own when it has
under MIN_WORDS words, or over half of its words lie in repeated windows. Besides, symbols over SYMBOL_SHARE of the words
and repeated lines over LINE_SHARE of the lines are counted against its host.

Per host: the share of documents that fail any rule is shrunk towards an empirical beta prior, whose mean and strength are fitted to
the hosts' shares by moments weighted by documents. A host is rejected when its shrunk share is over HOST_LIMIT; its documents are not kept.

Repeated windows: each window has a 64-bit hash. Two sorted arrays hold 34 of its bits each (all 64 between them) above the window's place; a place
that has an equal neighbour in both is in a repeated window. That costs n log n inside the row, without a shuffle; the chance of a
false place is about (n / 2**34)**2.

Defined cases: null and empty texts have no words and fail. A null host is one host. If all hosts have the same share, the prior has the
strength PRIOR_ROWS. Repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilake.session import store

MIN_WORDS = 50
SYMBOL_SHARE = 0.1
LINE_SHARE = 0.3
HOST_LIMIT = 0.5
PRIOR_ROWS = 20.0

_SPACE = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\x0b\f\r"
_PLACE = (1 << 30) - 1


def _repeated(keys: Column) -> Column:
    """Places of the sorted keys whose upper bits equal a neighbour's."""
    upper = lambda x: F.shiftright(x, 30)
    marked = F.transform(
        keys, lambda x, k: F.when((upper(F.get(keys, k - 1)) == upper(x)) | (upper(F.get(keys, k + 1)) == upper(x)), x.bitwiseAND(F.lit(_PLACE).cast("bigint"))))
    return F.filter(marked, lambda p: p.isNotNull())


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "host", "text", F.btrim("text", F.lit(_BLANKS)).alias("core"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    rows = rows.select("doc_id", "host", F.when(F.col("core") == "", F.array().cast("array<string>")).otherwise(F.split("core", _SPACE)).alias("words"), lines.alias("lines"), F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"))
    size = F.size("words")
    windows = F.when(size >= 3, F.transform(F.sequence(F.lit(0), F.greatest(size - 3, F.lit(0))), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id", "host", "n_symbols", size.cast("bigint").alias("n_words"), F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), windows.alias("windows"))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    none = F.array().cast("array<bigint>")
    place = lambda k: k.cast("bigint")
    rows = rows.select(
        *[c for c in rows.columns if c != "windows"],
        F.when(some, F.sort_array(F.transform("windows", lambda x, k: F.shiftleft(F.shiftright(x, 30), 30).bitwiseOR(place(k))))).otherwise(none).alias("upper"),
        F.when(some, F.sort_array(F.transform("windows", lambda x, k: F.shiftleft(x, 30).bitwiseOR(place(k))))).otherwise(none).alias("lower"))
    rows = rows.select(*[c for c in rows.columns if c not in ("upper", "lower")], F.sort_array(F.array_intersect(_repeated(F.col("upper")), _repeated(F.col("lower")))).alias("at"))
    # A repeated window covers three words, or as many as lie before the next one.
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(*[c for c in rows.columns if c != "at"], covered.alias("n_repeat_words"))


def host_verdicts(rows: DataFrame) -> DataFrame:
    """host, rate (shrunk share of failing documents), rejected; from rows with host and failed."""
    hosts = rows.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("failed").cast("double")).alias("k"))
    # Moments weighted by documents, so that many hosts of a few documents do not widen the prior.
    prior = hosts.agg((F.sum("k") / F.sum("n")).alias("m"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("q"), F.sum("n").alias("t"))
    prior = prior.select("m", (F.col("q") / F.col("t") - F.col("m") * F.col("m")).alias("v"))
    strength = F.when((F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v")), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(PRIOR_ROWS)
    # One row on the other side.
    judged = hosts.crossJoin(F.broadcast(prior.select("m", strength.alias("s"))))
    rate = (F.col("k") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    return judged.select("host", rate.alias("rate"), (rate > HOST_LIMIT).alias("rejected"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """The measures of every row of docs with base_failed, failed (any rule), host_rejected and kept."""
    short = F.col("n_words") < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    symbols = F.col("n_symbols") > SYMBOL_SHARE * F.col("n_words")
    lines = F.col("n_dup_lines") > LINE_SHARE * F.col("n_lines")
    rows = store(measures(docs, host).withColumn("base_failed", short | repeats).withColumn("failed", short | repeats | symbols | lines), "quality_rows")
    verdicts = host_verdicts(rows).select("host", F.col("rejected").alias("host_rejected"))
    return rows.join(verdicts, "host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
