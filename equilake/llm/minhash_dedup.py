"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

Sketch (Dahlgaard, Knudsen, Thorup 2017, "Fast similarity sketching"): t coordinates are filled in at
most 2t rounds. In round i < t a fresh hash throws every shingle of the set into one of the t bins with the
value (i, hash); in round t + j every shingle goes to bin j. A bin keeps its least value, so earlier rounds win,
every coordinate is filled for certain, and the expected work is O(size + t log t). Two sets agree in a
coordinate with the probability of their Jaccard similarity, with concentration like independent hashes.

Search: t = 128 coordinates in 32 bands of 4. Of pairs at similarity 0.75 a share of 5e-6 meets in no band,
far fewer above. Sets that are equal form one class first, and only classes go on.
 1. Each class is paired with the least class that it shares a bucket with, then, where they still lie in different components, with the
    least class of each of its buckets: no more pairs than rows.
 2. Buckets that then still hold two components or more are searched in full between components. Of a small bucket (SMALL rows) the pairs go
    on whose sketches agree in MIN_AGREE coordinates (a pair at 0.75 stays below that with probability 2e-8). Large ones are dealt in
    blocks of BLOCK x BLOCK classes with their texts, and a task intersects the full sets and emits confirmed links only.
 3. Every pair is confirmed on the full shingle sets of both texts.
A group of copies or near copies, however large, thus costs a pair per member; a bucket is never gathered in one task.

Defined cases: null, empty and blank texts have no shingle and link with nothing. A text of one to four words is one shingle.
Repeated rows keep one output row each. Rows that share a doc_id are one document of the graph. A null doc_id links
with nothing: component_id is null and kept is true. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilake.llm import text as T
from equilake.llm.graph import components, merge
from equilake.session import store

COORDINATES = 128
BANDS = 32
ROWS = COORDINATES // BANDS
MIN_AGREE = 70
SMALL = 32
BLOCK = 512
MOST_IDS = 1_000_000

_SEEDS = T.stream(2 * COORDINATES, 11)
_ROW_CODE = T.stream(ROWS, 12)
_BAND_CODE = T.stream(BANDS, 13)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_VALUE_BITS = np.uint64(55)


def sketch(shingle: np.ndarray, at: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Sketches (rows x t) of the sets given by distinct hashes and row offsets; an empty set has all-ones."""
    rows = len(at) - 1
    out = np.full(rows * t, _EMPTY, dtype=np.uint64)
    sizes = np.diff(at)
    active = np.flatnonzero(sizes)
    value, slot = shingle, np.repeat(np.arange(rows), sizes)
    seeds = _SEEDS if t == COORDINATES else T.stream(2 * t, 11)
    for i in range(2 * t):
        if not len(active):
            break
        h = T.mix(value ^ seeds[i])
        bins = (h >> np.uint64(57)).astype(np.int64) if t == 128 else (T.mix(h) % np.uint64(t)).astype(np.int64)
        place = slot * t + (bins if i < t else i - t)
        np.minimum.at(out, place, (np.uint64(i) << _VALUE_BITS) | (h & ((np.uint64(1) << _VALUE_BITS) - np.uint64(1))))
        open_ = np.zeros(rows, dtype=bool)
        open_[active] = (out.reshape(rows, t)[active] == _EMPTY).any(axis=1)
        active = active[open_[active]]
        keep = open_[slot]
        value, slot = value[keep], slot[keep]
    return out.reshape(rows, t)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band."""
    grouped = sketches.reshape(len(sketches), BANDS, ROWS)
    return T.mix((T.mix(grouped) * _ROW_CODE).sum(axis=2, dtype=np.uint64) + _BAND_CODE)


_SKETCH_SCHEMA = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, brief binary"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        for first, last in T.slices(column):
            shingle, at = T.shingle_sets(column.slice(first, last - first))
            sizes = np.diff(at)
            marks = T.mix(shingle ^ _SEEDS[0]), T.mix(shingle ^ _SEEDS[1])
            full = np.flatnonzero(sizes)
            sums = np.zeros((2, last - first), dtype=np.uint64)
            if len(full):
                for k in range(2):
                    sums[k, full] = np.add.reduceat(marks[k], at[full])
            sketches = sketch(shingle, at)
            keys = band_keys(sketches).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            brief = (sketches & np.uint64(0xFFFF)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, last - first).cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists, pa.array([b.tobytes() for b in brief], type=pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "brief"])


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, set size, two marks of the set (equal for equal sets), band keys and a brief sketch of 16 bits a coordinate."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sketch_batches, _SKETCH_SCHEMA)


def _near_pairs(node: np.ndarray, comp: np.ndarray, size: np.ndarray, brief: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of a small bucket in different components whose sizes and brief sketches allow a similarity of 0.75."""
    for k in range(len(node) - 1):
        rest = np.arange(k + 1, len(node))
        rest = rest[(comp[rest] != comp[k]) & (node[rest] != node[k]) & (100 * np.minimum(size[rest], size[k]) >= 75 * np.maximum(size[rest], size[k]))]
        for j in rest[(brief[rest] == brief[k]).sum(axis=1) >= MIN_AGREE]:
            yield int(min(node[k], node[j])), int(max(node[k], node[j]))


def _small_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of buckets of at most SMALL rows; rows come sorted by band."""
    band, rows, found = None, [], set()

    def pairs() -> None:
        if len(rows) > 1:
            node, comp, size, brief = zip(*rows, strict=True)
            found.update(_near_pairs(np.array(node), np.array(comp), np.array(size), np.frombuffer(b"".join(brief), "<u2").reshape(-1, COORDINATES)))

    for batch in batches:
        for at, *row in zip(*(batch.column(c).to_pylist() for c in ("band", "node", "component", "n_shingles", "brief")), strict=True):
            if at != band:
                pairs()
                band, rows = at, []
            rows.append(row)
        yield _pair_batch(found)
        found.clear()
    pairs()
    yield _pair_batch(found)


def _pair_batch(pairs) -> pa.RecordBatch:
    flat = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])


def _linked(left: list[tuple], right: list[tuple]) -> set[tuple[int, int]]:
    """Links between two blocks (or inside one, if they are the same), by exact intersections of full shingle sets.

    Rows are (node, component, text). The postings of the right block's shingles give the intersections of a left text
    with all of them at once. Only one link between two components is kept.
    """
    if len({r[1] for r in left} | {r[1] for r in right}) < 2:
        return set()
    node, comp = np.array([r[0] for r in right]), np.array([r[1] for r in right])
    values, at = T.shingle_sets(pa.array([r[2] for r in right], pa.large_string()))
    size = np.diff(at)
    order = np.argsort(values, kind="stable")
    keys, owner = values[order], np.repeat(np.arange(len(right)), size)[order]
    own, own_at = (values, at) if left is right else T.shingle_sets(pa.array([r[2] for r in left], pa.large_string()))
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for k, (a, c, _) in enumerate(left):
        mine = own[own_at[k] : own_at[k + 1]]
        lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
        n = hi - lo
        both = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(right))
        for j in np.flatnonzero((both > 0) & (comp != c) & (100 * both >= 75 * (size + len(mine) - both))):
            found[min(c, int(comp[j])), max(c, int(comp[j]))] = (min(a, int(node[j])), max(a, int(node[j])))
    return set(found.values())


def _large_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of large buckets; rows come sorted by (band, low, high, side), two blocks at most to a group."""
    key, sides, found = None, ([], []), set()
    for batch in batches:
        for band, low, high, side, *row in zip(*(batch.column(c).to_pylist() for c in ("band", "low", "high", "side", "node", "component", "text")), strict=True):
            if (band, low, high) != key:
                if key:
                    found |= _linked(sides[0], sides[1] if key[1] != key[2] else sides[0])
                key, sides = (band, low, high), ([], [])
            sides[side].append(tuple(row))
        yield _pair_batch(found)
        found = set()
    if key:
        yield _pair_batch(_linked(sides[0], sides[1] if key[1] != key[2] else sides[0]))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs with 100 * intersection >= 75 * union of the full shingle sets."""
    for batch in batches:
        for first, last in T.slices(batch.column("text_a")):
            part = batch.slice(first, last - first)
            (x, xat), (y, yat) = T.shingle_sets(part.column("text_a")), T.shingle_sets(part.column("text_b"))
            keep = []
            for i in range(last - first):
                p, q = x[xat[i] : xat[i + 1]], y[yat[i] : yat[i + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both > 0 and 100 * both >= 75 * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, text) of the documents with these ids. A short list of ids is broadcast, so that only their texts are moved."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string").alias("text"))
    ids = store(ids.distinct(), "ids")
    return texts.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "node", "left_semi")


def _confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of doc ids whose texts are alike on their full sets."""
    pairs = store(pairs, "pairs")
    texts = _texts(docs, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a bigint, b bigint").distinct()


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, COORDINATES) for c in ("brief_a", "brief_b"))
        keep = pa.array((x == y).sum(axis=1) >= MIN_AGREE)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)


def _alike(pairs: DataFrame, brief: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and brief sketches allow a similarity of 0.75."""
    sides = pairs
    for side in "ba":
        sides = sides.join(brief.select(F.col("node").alias(side), F.col("brief").alias(f"brief_{side}"), F.col("n_shingles").alias(f"n_{side}")), side)
    return sides.where("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)").select("a", "b", "brief_a", "brief_b").mapInArrow(_agree, "a bigint, b bigint")


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs (a, b) that do not lie in one component yet."""
    side = joined.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    both = pairs.join(side, "a", "left").join(side.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    table = store(sketch_table(docs), "sketches")
    known = table.where("doc_id is not null and n_shingles > 0")
    sets = ["n_shingles", "set_a", "set_b"]
    classes = store(known.groupBy(*sets).agg(F.min("doc_id").alias("node")), "classes")
    # Rows that share a doc_id but not a set are one node each; they are tied at the end.
    nodes = table.join(classes.withColumnRenamed("node", "doc_id"), [*sets, "doc_id"], "left_semi").dropDuplicates(["doc_id", *sets]).select(F.col("doc_id").alias("node"), "n_shingles", "bands", "brief")
    rows = nodes.select("node", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    members = store(rows.join(buckets.select("band", "least"), "band"), "buckets")
    brief = nodes.select("node", "n_shingles", "brief")

    # A pair for each class: with the least class that shares a bucket. Then the other buckets' least classes, where they still lie apart.
    nearest = members.where("node > least").groupBy("node").agg(F.min("least").alias("a")).select("a", F.col("node").alias("b"))
    joined = store(components(_confirm(_alike(nearest, brief), docs)), "components")
    star = members.where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    joined = merge(joined, _confirm(_alike(_apart(star, joined), brief), docs))

    mixed = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = mixed.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n")).where("c0 <> c1")
    mixed = store(mixed.join(open_.select("band", "n"), "band").select("band", "n", "node", "component"), "open_buckets")
    small = mixed.where(F.col("n") <= SMALL).join(brief, "node").repartition("band").sortWithinPartitions("band")
    more = _confirm(small.select("band", "node", "component", "n_shingles", "brief").mapInArrow(_small_buckets, "a bigint, b bigint").distinct(), docs)
    large = mixed.where(F.col("n") > SMALL)
    placed = large.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "component")
    placed = placed.join(_texts(docs, large.select("node")).dropDuplicates(["node"]), "node").repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "side")
    more = more.union(placed.select("band", "low", "high", "side", "node", "component", "text").mapInArrow(_large_buckets, "a bigint, b bigint"))
    own = known.join(classes, sets).select("doc_id", "node")
    ties = own.join(own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most"), "doc_id").select("a", F.col("node").alias("b"))
    final = merge(joined, more.union(ties).distinct())

    least = table.join(classes, sets, "left").join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return least.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
