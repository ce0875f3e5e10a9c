"""Secrets in whole texts, judged by who owns their values across the corpus.

Base kinds (fixed patterns): assign, access, hex. Every value found is hashed, and the hashes are counted over the corpus by distinct
repositories and distinct owners, in two steps (owner and repository, then value), so that a value copied a million times is combined
before it moves. A value with WIDELY or more owners, or FIXTURE or more repositories (a fixture that one owner copies about), is a copied example; any other that is random enough (LIVE_LENGTH
characters and LIVE_BITS bits a character) is live-looking; the rest is unsure. A live-looking value is then searched in all texts as a bare token (a
run of BARE_LENGTH or more of the characters of a value, one digit at least, without points at its ends) outside the base spans: those spans are added with the kind bare.

Defined cases: null and empty texts have no spans and the hash of an empty string. Null owners are one owner. Repeated rows are kept, and count
once as a repository where their id is the same. Rows are told apart by their stored position.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilake.llm import text as T
from equilake.session import store

WIDELY = 3
FIXTURE = 20
LIVE_LENGTH = 16
LIVE_BITS = 3.0
BARE_LENGTH = 16

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BARE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{BARE_LENGTH},}}")
KINDS = ["assign", "access", "hex", "bare"]
_WORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"akia"]

_HEX_BYTE = np.zeros(256, dtype=bool)
_HEX_BYTE[48:58] = True
_HEX_BYTE[97:103] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, value), by start and kind."""
    found = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # Runs of 32 and more are the maximal runs that pass.
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


def bare_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens with a digit that touch no base span."""
    out = []
    for m in BARE.finditer(text):
        value = m.group().strip(".")
        start = m.start() + len(m.group()) - len(m.group().lstrip("."))
        end = start + len(value)
        if any(c in value for c in "0123456789") and all(end <= s or e <= start for s, _, e, _ in base):
            out.append((start, 3, end, value))
    return out


def bits(value: str) -> float:
    """Shannon entropy in bits a character."""
    return -sum(n / len(value) * log2(n / len(value)) for n in Counter(value).values())


def _worth(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can hold a base span or a bare token: a digit, a long run of hex letters or a keyword."""
    rows = len(offsets) - 1
    flag = np.zeros(rows, dtype=bool)
    upto = np.concatenate(([0], np.cumsum(_DIGIT[raw])))
    flag |= upto[offsets[1:]] > upto[offsets[:-1]]
    is_hex = np.concatenate(([False], _HEX_BYTE[raw], [False]))
    turn = np.flatnonzero(is_hex[1:] != is_hex[:-1])
    long_ = turn[::2][turn[1::2] - turn[::2] >= 32]
    flag[np.searchsorted(offsets, long_, "right") - 1] = True
    low = T._LOWER[raw].tobytes()
    for word in _WORDS:
        at = low.find(word)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            flag[row] = True
            at = low.find(word, max(at + 1, int(offsets[row + 1]) - len(word) + 1))
    return flag


_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("value", pa.string()), ("strong", pa.bool_())])
_SCHEMA = "doc_id bigint, repository string, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base string, spans array<struct<start:bigint,rank:int,end:bigint,value:string,strong:boolean>>"


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in T.slices(batch.column("text")):
            part = batch.slice(first, last - first)
            text = part.column("text")
            worth = _worth(*T.byte_view(text))
            n, base, spans = np.zeros((3, last - first), dtype=np.int64), [], []
            for i in range(last - first):
                found = base_spans(x := text[i].as_py() or "") if worth[i] else []
                extra = bare_spans(x, found) if worth[i] else []
                for s in found:
                    n[s[1], i] += 1
                base.append(_joined(found))
                spans.append([{"start": s, "rank": r, "end": e, "value": hashlib.sha256(v.strip(".").encode()).hexdigest(), "strong": len(v) >= LIVE_LENGTH and bits(v) >= LIVE_BITS} for s, r, e, v in found + extra])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("repository"), part.column("owner"), *(pa.array(k) for k in n), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array(base), pa.array(spans, type=pa.list_(_SPAN))],
                names=["doc_id", "repository", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "base", "spans"])


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", widely: int = WIDELY, fixture: int = FIXTURE) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_live, n_example, n_added, and the most repositories and owners that share one of the
    row's values, for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{repository}`").cast("string").alias("repository"), F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("")).alias("owner"), F.col("text").cast("string").alias("text"))
    found = store(rows.mapInArrow(_scan, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "secret_rows")
    spans = found.where(F.size("spans") > 0).select("row", "owner", "repository", F.explode("spans").alias("s")).select("row", "owner", "repository", "s.*")
    owned = spans.where("rank < 3").groupBy("value", "owner", "repository").agg(F.max("strong").alias("strong"))
    owned = owned.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.max("strong").alias("strong"))
    values = owned.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.max("strong").alias("strong"))
    # Held by many owners, or by many repositories of few owners (a shared fixture): widely copied. Else it is somebody's own.
    copied = (F.col("owners") >= widely) | (F.col("repositories") >= fixture)
    values = values.select("value", "repositories", "owners", F.when(copied, "example").when(F.col("strong"), "live").otherwise("unsure").alias("verdict"))
    judged = spans.join(values, "value").where("rank < 3 or verdict = 'live'")
    added = F.when(F.col("rank") == 3, F.struct("start", "rank", "end"))
    own = judged.groupBy("row").agg(
        F.sum((F.col("verdict") == "live").cast("bigint")).alias("n_live"), F.sum((F.col("verdict") == "example").cast("bigint")).alias("n_example"), F.collect_list(added).alias("added"),
        F.max("repositories").alias("most_repositories"), F.max("owners").alias("most_owners"))
    joined = found.join(own, "row", "left")
    base = F.transform(F.filter("spans", lambda s: s["rank"] < 3), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    every = F.sort_array(F.concat(base, F.col("added")))
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")
    return joined.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.when(F.size("added") > 0, text).otherwise(F.col("base")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"), F.when(F.col("added").isNull(), 0).otherwise(F.size("added")).cast("bigint").alias("n_added"),
        F.coalesce("most_repositories", F.lit(0)).alias("most_repositories"), F.coalesce("most_owners", F.lit(0)).alias("most_owners"))
