"""Substring dedup on a de Bruijn graph of word k-mers: every word in a 13-word window that an earlier document holds is removed.

A window of 13 words is an edge from its first to its last 12 words. Only edges that more than one document can hold matter, so:

1. Anchors. The least hash of the 7-word grams of a window is the same wherever the window is, and neighbouring windows mostly share it.
   Windows whose anchor is found in one document only are edges of that document alone.
2. Edges. The other windows meet by hash; the least (document, place) is the edge's source.
3. Paths. Consecutive edges of a document whose sources follow each other too are a path that does not branch; each path becomes one row: document,
   place, length, source coordinates. Where the graph branches, the source changes and a new path begins.
4. Verification. The words at a path's own and at its source coordinates are compared by a 128-bit hash in a join on the coordinates.

Hot edges (a line in a third of all documents): a slice of a few hundred documents answers for its own members and sends one of them to
the shuffle, which is sorted by the JVM and read as a stream, so no group is held. Hashes are 64-bit; step 4 raises an error if two different windows were
taken for one, so a collision can't remove a word.

Texts are what fills the disk: step 4 sends only those of documents that are a source or hold a path. A bitmap of fixed size (2**BITMAP_BITS bits, broadcast; it has
no false negatives) of their ids thins the scan, the exact join follows; a document outside it is finished where it is read.

Defined cases: a null text has no words. Rows without doc_id have no order: nothing is removed from them, and they remove nothing. Rows that share a
doc_id do not remove from each other, each keeps its own places. Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equilake.llm import text as T
from equilake.session import store

WINDOW = 13
GRAM = 7
#: Text whose documents answer for each other before anything is shuffled.
SLICE_BYTES = 2 << 20
#: Places carry the number of the row among those of its doc_id above this many bits.
PLACE_BITS = 40
BITMAP_BITS = 26
_JOIN = T.stream(6, 41)


# -- hashes of windows -----------------------------------------------------------------------------------------------

def _pair(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    return T.mix(a * _JOIN[level] + b)


def windows(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, anchors) of the 13-word windows of a sequence of word hashes, from sums of halves."""
    n = len(word) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    two = _pair(word[:-1], word[1:], 0)
    four = _pair(two[:-2], two[2:], 1)
    eight = _pair(four[:-4], four[4:], 2)
    edge = _pair(_pair(eight[:n], four[8 : 8 + n], 3), word[12 : 12 + n], 4)
    grams = n + WINDOW - GRAM
    gram = _pair(_pair(four[:grams], two[4 : 4 + grams], 3), word[6 : 6 + grams], 5)
    low = np.minimum(gram[:-1], gram[1:])
    low = np.minimum(low[:-2], low[2:])
    return edge, np.minimum(low[:n], low[3 : 3 + n])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, edges, anchors, row of each window, place of each window, row offsets among the windows) of bounded slices."""
    column = batch.column("text")
    for first, last in T.slices(column, SLICE_BYTES):
        word, at = T.words(*T.byte_view(column.slice(first, last - first)), lower=False)
        edge, anchor = windows(word)
        count = np.maximum(np.diff(at) - WINDOW + 1, 0)
        row = np.repeat(np.arange(last - first), count)
        upto = np.concatenate(([0], np.cumsum(count)))
        place = np.arange(int(upto[-1])) - upto[row]
        start = at[row] + place
        yield first, edge[start], anchor[start], row, place, upto


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# -- anchors ---------------------------------------------------------------------------------------------------------

ASK, TELL, KNOWN = 0, 1, 2


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc, role): asked for if one document of the slice has it; else told once, and known for each of its documents."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for first, _, anchor, row, _, _ in _slices(batch):
            if not len(anchor):
                continue
            changed = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
            a, d = anchor[changed], ids[first + row[changed]]
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            keep = np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])))
            a, d = a[keep], d[keep]
            heads = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            sizes = np.diff(np.append(heads, len(a)))
            many = np.repeat(sizes > 1, sizes)
            tell = heads[sizes > 1]
            yield pa.RecordBatch.from_arrays(
                [_signed(np.concatenate((a, a[tell]))), pa.array(np.concatenate((d, d[tell]))), pa.array(np.concatenate((np.where(many, KNOWN, ASK), np.full(len(tell), TELL))))], names=["a", "doc", "role"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, a) for anchors of two documents or more, from rows sorted by anchor and doc. Of an open group only its first document is held."""
    held: tuple[int, int, bool] | None = None  # anchor, first doc, known to be repeated
    for batch in batches:
        a, d, role = (batch.column(c).to_numpy() for c in ("a", "doc", "role"))
        known = role == KNOWN
        out_d, out_a = [d[known]], [a[known]]
        a, d, role = a[~known], d[~known], role[~known]
        if len(a):
            heads = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            sizes = np.diff(np.append(heads, len(a)))
            first = d[heads].copy()
            same = held is not None and held[0] == a[0]
            if same:
                first[0] = held[1]
            many = np.logical_or.reduceat((d != np.repeat(first, sizes)) | (role == TELL), heads)
            if same:
                if many[0] and not held[2]:
                    out_d.append(first[:1])
                    out_a.append(a[:1])
                many[0] |= held[2]
            hit = np.repeat(many, sizes) & (role == ASK)
            out_d.append(d[hit])
            out_a.append(a[hit])
            held = (int(a[-1]), int(first[-1]), bool(many[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_d)), pa.array(np.concatenate(out_a))], names=["doc", "a"])


# -- edges -----------------------------------------------------------------------------------------------------------

_EDGES = "e bigint, doc bigint, place bigint, n bigint, src bigint, src_place bigint"


def _runs(doc: np.ndarray, place: np.ndarray, n: np.ndarray, src: np.ndarray, src_place: np.ndarray) -> np.ndarray:
    """Starts of the paths among windows or paths sorted by (doc, place)."""
    go_on = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + n[:-1]) & (src[1:] == src[:-1]) & (src_place[1:] == src_place[:-1] + n[:-1])
    return np.flatnonzero(np.concatenate(([True], ~go_on)))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with a repeated anchor. Windows that an earlier document of the slice holds are answered as paths (n > 0); the rest ask (n = 0)."""
    for batch in batches:
        ids, variant, wanted = batch.column("doc_id").to_numpy(), batch.column("variant").to_numpy(), batch.column("anchors")
        for first, edge, anchor, row, place, upto in _slices(batch):
            hit = np.zeros(len(edge), dtype=bool)
            for r in np.flatnonzero(np.diff(upto)):
                lo, hi = upto[r], upto[r + 1]
                hit[lo:hi] = np.isin(anchor[lo:hi], wanted[int(first + r)].values.to_numpy().view(np.uint64))
            e, r, p = edge[hit], row[hit], place[hit]
            if not len(e):
                continue
            d = ids[first + r]
            p = p + (variant[first + r].astype(np.int64) << PLACE_BITS)
            order = np.lexsort((p, d, e))
            e, d, p = e[order], d[order], p[order]
            heads = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
            sizes = np.diff(np.append(heads, len(e)))
            src, src_p = np.repeat(d[heads], sizes), np.repeat(p[heads], sizes)
            later = d > src
            order = np.flatnonzero(later)
            order = order[np.lexsort((p[order], d[order]))]
            kd, kp, ks, ksp = d[order], p[order], src[order], src_p[order]
            start = _runs(kd, kp, np.ones(len(kd), np.int64), ks, ksp) if len(kd) else order
            ask = ~later
            zero = np.zeros(int(ask.sum()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [_signed(np.concatenate((e[ask], np.zeros(len(start), np.uint64)))), pa.array(np.concatenate((d[ask], kd[start]))), pa.array(np.concatenate((p[ask], kp[start]))),
                 pa.array(np.concatenate((zero, np.diff(np.append(start, len(kd)))))), pa.array(np.concatenate((zero, ks[start]))), pa.array(np.concatenate((zero, ksp[start])))],
                names=["e", "doc", "place", "n", "src", "src_place"])


_PATHS = "doc bigint, place bigint, n bigint, src bigint, src_place bigint"
_PATH = ["doc", "place", "n", "src", "src_place"]


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers, from rows sorted by edge, doc and place: the first row of an edge is its source. Paths are passed on."""
    held: tuple[int, int, int] | None = None
    for batch in batches:
        e, d, p, n, src, src_p = (batch.column(c).to_numpy() for c in ("e", "doc", "place", "n", "src", "src_place"))
        done = n > 0
        out = [[x[done]] for x in (d, p, n, src, src_p)]
        e, d, p = e[~done], d[~done], p[~done]
        if len(e):
            heads = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
            sizes = np.diff(np.append(heads, len(e)))
            first, first_p = d[heads].copy(), p[heads].copy()
            if held is not None and held[0] == e[0]:
                first[0], first_p[0] = held[1:]
            held = (int(e[-1]), int(first[-1]), int(first_p[-1]))
            src, src_p = np.repeat(first, sizes), np.repeat(first_p, sizes)
            later = d > src
            for column, x in zip(out, (d, p, np.ones(len(d), np.int64), src, src_p), strict=True):
                column.append(x[later])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=_PATH)


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal paths from rows sorted by doc and place; the last path of a batch is held open."""
    held = [np.zeros(0, np.int64)] * 5
    for batch in batches:
        d, p, n, src, src_p = (np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, _PATH, strict=True))
        if not len(d):
            continue
        start = _runs(d, p, n, src, src_p)
        n = np.add.reduceat(n, start)
        paths = [d[start], p[start], n, src[start], src_p[start]]
        held = [x[-1:] for x in paths]
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in paths], names=_PATH)
    if len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=_PATH)


# -- verification and result -----------------------------------------------------------------------------------------

_MASK = (1 << PLACE_BITS) - 1


def _span_hash(words: list[bytes], place: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[place : place + n + WINDOW - 1]), digest_size=16).digest()


def _source_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words = (batch.column("text")[i].as_py() or "").encode().split()
            asked = batch.column("asked")[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("doc_id")[i].as_py()] * len(asked), pa.int64()), pa.array([a["src_place"] for a in asked]), pa.array([a["n"] for a in asked]), pa.array([_span_hash(words, a["src_place"] & _MASK, a["n"]) for a in asked], pa.binary())],
                names=["src", "src_place", "n", "hash"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        lists = batch.column("paths") if "paths" in batch.schema.names else pa.nulls(batch.num_rows)
        for text, paths in zip(batch.column("text"), lists, strict=True):
            words = (text.as_py() or "").encode().split()
            gone = bytearray(len(words))
            for path in paths.as_py() or []:
                place, n = path["place"] & _MASK, path["n"]
                if _span_hash(words, place, n) != path["hash"]:
                    raise ValueError("two windows share a hash: give another seed to the window hashes")
                gone[place : place + n + WINDOW - 1] = b"\1" * (n + WINDOW - 1)
            kept = [w for w, g in zip(words, gone, strict=True) if not g] if paths.as_py() else words
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


# -- which documents a table names ---------------------------------------------------------------------------------

def _slot(ids: pa.Array) -> np.ndarray:
    return T.mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64((1 << BITMAP_BITS) - 1)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = np.unique(_slot(batch.column("doc_id")))
        yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], names=["word", "bits"])


def _bitmap(named: DataFrame):
    """The doc_ids of named as a broadcast bitmap: 2**(BITMAP_BITS - 6) words, whatever their number."""
    words = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    for word, bits in named.select("doc_id").mapInArrow(_bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        words[word] = bits
    return named.sparkSession.sparkContext.broadcast(words.tobytes())


def _in_bitmap(batches: Iterator[pa.RecordBatch], bitmap, wanted: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose doc_id the bitmap has (all that are named, few others), or all other rows; null is not named."""
    bits = np.frombuffer(bitmap.value, np.uint8)
    for batch in batches:
        ids = batch.column("doc_id")
        slot = _slot(ids)
        hit = ((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(hit == wanted))


def _named(docs: DataFrame, bitmap) -> DataFrame:
    return docs.mapInArrow(lambda batches: _in_bitmap(batches, bitmap, True), "doc_id bigint, text string, variant bigint")


def _with_variant(docs: DataFrame) -> DataFrame:
    """docs with the number of a row's text among the texts of its doc_id (0 for nearly all)."""
    keys = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    several = keys.distinct().withColumn("variant", F.row_number().over(Window.partitionBy("doc_id").orderBy("h")) - 1).where("variant > 0")
    several = store(several.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.col("variant").cast("bigint").alias("variant")), "variants")
    if several.isEmpty():
        return docs.withColumn("variant", F.lit(0).cast("bigint"))
    joined = docs.join(several, (F.col("doc_id") == F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left")
    return joined.select("doc_id", "text", F.coalesce("variant", F.lit(0)).cast("bigint").alias("variant"))


def repeated_paths(docs: DataFrame) -> DataFrame:
    """Paths (doc, place, n windows, src, src_place) of docs (doc_id, text, variant): the windows that an earlier document holds."""
    named = docs.where("doc_id is not null")
    asks = named.select("doc_id", "text").mapInArrow(_anchors, "a bigint, doc bigint, role bigint")
    # What is known already is only passed on. It goes by document, a document's rows side by side: dealt out singly they fill far more of the disk.
    asks = asks.repartition(F.when(F.col("role") == KNOWN, F.col("doc")).otherwise(F.col("a"))).sortWithinPartitions("a", "doc")
    anchors = store(asks.mapInArrow(_repeated, "doc bigint, a bigint").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("a").alias("anchors")), "anchors")
    edges = named.join(anchors, "doc_id").select("doc_id", "variant", "text", "anchors").mapInArrow(_edges, _EDGES)
    edges = edges.repartition(F.when(F.col("n") > 0, F.col("doc")).otherwise(F.col("e"))).sortWithinPartitions("e", "doc", "place")
    found = edges.mapInArrow(_sources, _PATHS)
    return found.repartition("doc").sortWithinPartitions("doc", "place").mapInArrow(_compacted, _PATHS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), a row for each row of docs."""
    docs = _with_variant(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    paths = store(repeated_paths(docs), "paths")
    asked = paths.select("src", "src_place", "n").distinct().groupBy(F.col("src").alias("doc_id"), F.shiftright("src_place", PLACE_BITS).alias("variant")).agg(F.collect_list(F.struct("src_place", "n")).alias("asked"))
    asked = store(asked, "asked")
    hashes = _named(docs, _bitmap(asked)).join(asked, ["doc_id", "variant"]).select("doc_id", "text", "asked").mapInArrow(_source_hashes, "src bigint, src_place bigint, n bigint, hash binary").distinct()
    verified = paths.join(store(hashes, "hashes"), ["src", "src_place", "n"])
    lists = verified.groupBy(F.col("doc").alias("doc_id"), F.shiftright("place", PLACE_BITS).alias("variant")).agg(F.collect_list(F.struct("place", "n", "hash")).alias("paths"))
    lists = store(lists, "verified")
    bitmap = _bitmap(lists)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    cut = _named(docs, bitmap).join(lists, ["doc_id", "variant"], "left").select("doc_id", "text", "paths").mapInArrow(_kept, schema)
    return cut.unionByName(docs.mapInArrow(lambda batches: _kept(_in_bitmap(batches, bitmap, False)), schema))
