"""Small tables with the awkward cases, and plain definitions to compare with."""

import re

import pytest
from pyspark.sql import functions as F

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(120_000))
PROSE = "the quick brown fox jumps over the lazy dog while the patient crowd of people waits for the end of the long day"
ODD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 4), (4, "One", "en", "b", 3), (5, "one two three four", "xx", "b", 18),
    (6, PROSE, "en", "a", len(PROSE)), (6, PROSE, "en", "a", len(PROSE)), (7, PROSE.upper(), "en", "c", len(PROSE)), (8, PROSE + " and so on", "en", "c", len(PROSE) + 10),
    (9, LONG, "en", "a", len(LONG)), (None, PROSE, "en", "a", len(PROSE)), (10, "x y z " * 40, "de", "d", 240), (11, "one two three five", "en", "b", 18), (6, "another text under the same id it is", "en", "a", 36),
]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows, with extra columns whose names operators use themselves."""
    extra = ["row", "d", "fold", "node", "component", "band", "bands", "brief", "host", "hits", "language", "pieces", "text_a", "spans", "kept", "need", "__spans"]
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in extra}).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
