"""Test items inside documents: size-partitioned MinHash containment search, exact verification.

An item of n distinct 5-word shingles lies in a document when the document holds 100 * shared >= 75 * n of them, so it
lacks m = n - ceil(0.75 n) at most. Items are partitioned by size (octaves of n). In a partition with the largest allowed
lack M, an item's sketch is its bottom-k MinHash values, k = min(n, M + SLACK), and a document is a candidate when it
holds k - m of the sketch. By the pigeonhole principle that loses nothing, however long the document: a fixed-length
sketch of the document would miss short items in long documents, so the document's side is the whole stream of its values,
tested against the sketches. Shared values are confirmed on the full sets.

The stream is thinned inside the scan by a bitmap of fixed size (2**BITMAP_BITS bits, broadcast; it has no false
negatives) of all sketch values; only documents with enough hits leave the scan, with their text, and go on to the
exact join by value. Neither the bitmap nor anything else broadcast grows with either table.

Defined cases: null, empty and blank texts and items hold nothing. An item of one to four words is one shingle and is found
in a document that is exactly those words. Repeated item ids and doc ids are kept apart by row and reported once a pair.
Rows with a null id are searched and reported with a null id. Other columns are ignored. A row is taken out for its own text only: rows that
share an id, or have none, are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilake.llm import text as T
from equilake.session import store

BITMAP_BITS = 26
SLACK = 8

_ITEM_SCHEMA = "item_id bigint, n bigint, need int, value array<bigint>, item_text string"


def _lack(n: np.ndarray) -> np.ndarray:
    """How many of n shingles may be missing."""
    return n - (75 * n + 99) // 100


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in T.slices(batch.column("text")):
            part = batch.slice(first, last - first)
            values, at = T.shingle_sets(part.column("text"))
            n = np.diff(at)
            size_class = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
            most = _lack((np.int64(2) << size_class) - 1)
            k = np.minimum(n, most + SLACK)
            # The sets are sorted by a mixed hash, so their first k values are the bottom-k sketch.
            sketch = [values[at[i] : at[i] + k[i]].view(np.int64) for i in range(len(n))]
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id").cast(pa.int64()), pa.array(n), pa.array((k - _lack(n)).astype(np.int32)), pa.array(sketch, type=pa.list_(pa.int64())), part.column("text").cast(pa.string())],
                names=["item_id", "n", "need", "value", "item_text"])


def _slot(values: np.ndarray) -> np.ndarray:
    return values & np.uint64((1 << BITMAP_BITS) - 1)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("value").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        slot = np.unique(_slot(values))
        yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], names=["word", "bits"])


def _scan(batches: Iterator[pa.RecordBatch], bitmap, least: int) -> Iterator[pa.RecordBatch]:
    bits = np.frombuffer(bitmap.value, np.uint8)
    for batch in batches:
        for first, last in T.slices(batch.column("text")):
            part = batch.slice(first, last - first)
            raw, offsets = T.byte_view(part.column("text"))
            values, at = T.shingles(*T.words(raw, offsets))
            slot = _slot(values)
            hit = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
            row = np.searchsorted(at, hit, "right") - 1
            pairs = np.unique(np.stack([row.astype(np.uint64), values[hit]], axis=1), axis=0) if len(hit) else np.zeros((0, 2), np.uint64)
            counts = np.bincount(pairs[:, 0].astype(np.int64), minlength=last - first)
            begin = np.cumsum(counts) - counts
            rows = np.flatnonzero(counts >= least)
            if not len(rows):
                continue
            hits = [pairs[begin[i] : begin[i] + counts[i], 1].view(np.int64) for i in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()).take(pa.array(rows)), part.column("text").cast(pa.string()).take(pa.array(rows)), pa.array(hits, type=pa.list_(pa.int64()))],
                names=["doc_id", "text", "hits"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in T.slices(batch.column("text")):
            part = batch.slice(first, last - first)
            (x, xat), (y, yat) = T.shingle_sets(part.column("item_text")), T.shingle_sets(part.column("text"))
            shared = np.array([len(np.intersect1d(x[xat[i] : xat[i + 1]], y[yat[i] : yat[i + 1]], assume_unique=True)) for i in range(last - first)], dtype=np.int64)
            n = np.diff(xat)
            out = pa.RecordBatch.from_arrays([part.column("item_id"), part.column("doc_id"), pa.array(n), pa.array(shared), part.column("text_hash"), part.column("text_size")], names=["item_id", "doc_id", "n_item_shingles", "n_shared", "text_hash", "text_size"])
            yield out.filter(pa.array((shared > 0) & (100 * shared >= 75 * n)))


def _text_key() -> list[Column]:
    """What tells a text from others of the same doc_id."""
    return [F.xxhash64("text").alias("text_hash"), F.octet_length("text").alias("text_size")]


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id, n_item_shingles, n_shared: the items (item_id, text) that lie in docs (doc_id, text)."""
    return _contained(docs, items).select("item_id", "doc_id", "n_item_shingles", "n_shared").distinct()


def _contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """contained_items with the key of the document's text."""
    spark = docs.sparkSession
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    sketches = store(wanted.mapInArrow(_items, _ITEM_SCHEMA).where("n > 0").withColumn("item_row", F.monotonically_increasing_id()), "item_sketches")
    # 2**(BITMAP_BITS - 6) words at most, whatever the number of items.
    words = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    for word, bits in sketches.select("value").mapInArrow(_bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        words[word] = bits
    bitmap = spark.sparkContext.broadcast(words.tobytes())
    least = sketches.agg(F.min("need")).first()[0] or 1

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = store(texts.mapInArrow(lambda batches: _scan(batches, bitmap, least), "doc_id bigint, text string, hits array<bigint>").withColumn("row", F.monotonically_increasing_id()), "item_hits")
    values = sketches.select("item_row", "need", F.explode("value").alias("value"))
    hits = found.select("row", F.explode("hits").alias("value"))
    candidates = hits.join(values, "value").groupBy("row", "item_row").agg(F.count("*").alias("held"), F.first("need").alias("need")).where("held >= need").select("row", "item_row")
    pairs = candidates.join(found.select("row", "doc_id", "text", *_text_key()), "row").join(sketches.select("item_row", "item_id", "item_text"), "item_row")
    return pairs.select("item_id", "doc_id", "item_text", "text", "text_hash", "text_size").mapInArrow(_exact, "item_id bigint, doc_id bigint, n_item_shingles bigint, n_shared bigint, text_hash bigint, text_size int")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose text holds an item."""
    held = _contained(docs, items).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), F.col("text_size").alias("__n")).distinct()
    hash_, size = F.xxhash64(F.col("text").cast("string")), F.octet_length(F.col("text").cast("string"))
    return docs.join(held, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__d")) & (hash_ == F.col("__h")) & (size == F.col("__n")), "left_anti")
