"""A Merkle manifest of a dataset by time-forward processing: root, subroots, and a proof for every row.

Rows are leaves; per language they ascend by doc_id, and pairs of consecutive nodes become a node until one is left, the
subroot. The subroots, by language, give the root in the same way. Every node has a label (level, place). A queue ordered by label delivers digests
to parents, and a node is computed when its label comes up, with all its children's messages at the head of the queue. The
reversed sweep takes labels from the root down and delivers to each child the suffix of its proof: its sibling and all that the parent has.

The queue is external: labels are cut into blocks of 2**BLOCK_BITS places, a sorted shuffle brings the messages for a block into one task in the order of
their labels, and a heap takes them from there. A block's top goes on as a message for the block above, so a table of any size,
also of a single language, takes log(rows) / BLOCK_BITS shuffles, and a task holds one block.

Defined cases: null languages are a language of their own, first in order; null ids come first. Rows that share an id are ordered by
their leaf; repeated rows are leaves of their own. A null field is hashed as `-`. Other columns are ignored. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilake.llm.runs import numbered, runs
from equilake.session import store

BLOCK_BITS = 14
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPER_EVERY = 7


# -- leaves --------------------------------------------------------------------------------------------------------

def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (binary) of fields, each with its length before it."""
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """key (language, ordered as the languages are), doc_id, leaf, shown: the leaf of the row as it is presented for checking."""
    own = [F.col(c) for c in FIELDS]
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = leaf_digest([more if c == "n_chars" else F.col(c) for c in FIELDS])
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0) & F.col("n_chars").isNotNull()
    return docs.select(F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf_digest(own).alias("leaf"), F.when(hit, changed).alias("shown"))


# -- one block -----------------------------------------------------------------------------------------------------

def _h(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def levels(nodes: int, most: int) -> int:
    """How many times pairs are joined until one node is left, `most` at most."""
    return min(most, max(nodes - 1, 0).bit_length())


def sweep_up(digests: list[bytes], height: int) -> list[list[bytes]]:
    """Digests (hex) of each level of a block, the given ones first."""
    tree: list[list[bytes]] = [digests, *[[] for _ in range(height)]]
    queue = [(1, i >> 1, i, d) for i, d in enumerate(digests)] if height else []
    while queue:
        level, place, _, digest = heapq.heappop(queue)
        messages = [digest]
        while queue and queue[0][0] == level and queue[0][1] == place:
            messages.append(heapq.heappop(queue)[3])
        own = _h(messages)
        tree[level].append(own)
        if level < height:
            heapq.heappush(queue, (level + 1, place >> 1, place, own))
    return tree


def sweep_down(tree: list[list[bytes]], suffix: tuple | None) -> list[tuple | None]:
    """For each lowest node its proof: (is the sibling left, sibling or None, proof of the parent)."""
    height = len(tree) - 1
    out: list[tuple | None] = [None] * len(tree[0])
    queue: list[tuple] = [(-height, 0, suffix)]
    while queue:
        level, place, proof = heapq.heappop(queue)
        level, place = -level, -place
        if not level:
            out[place] = proof
            continue
        below, left = tree[level - 1], 2 * place
        pair = below[left : left + 2]
        for side in range(len(pair)):
            heapq.heappush(queue, (1 - level, -(left + side), (side == 1, pair[1 - side] if len(pair) == 2 else None, proof)))
    return out


def pack(proof: tuple | None) -> bytes:
    """A proof as bytes: per level a side (0 none, 1 the sibling is left, 2 right) and the sibling."""
    out = []
    while proof is not None:
        left, sibling, proof = proof
        out.append(b"\0" if sibling is None else (b"\1" if left else b"\2") + bytes.fromhex(sibling.decode()))
    return b"".join(out)


def unpack(data: bytes | None) -> tuple | None:
    steps, at = [], 0
    while data and at < len(data):
        side = data[at]
        steps.append((side == 1, data[at + 1 : at + 33].hex().encode() if side else None))
        at += 33 if side else 1
    proof = None
    for left, sibling in reversed(steps):
        proof = (left, sibling, proof)
    return proof


def fold(digest: bytes, proof: tuple | None) -> tuple[bytes, bytes]:
    """(root that a digest and its proof give, SHA-256 of the siblings)."""
    siblings = []
    while proof is not None:
        left, sibling, proof = proof
        if sibling is None:
            digest = _h([digest])
            continue
        siblings.append(sibling)
        digest = _h([sibling, digest] if left else [digest, sibling])
    return digest, _h(siblings)


# -- all blocks ----------------------------------------------------------------------------------------------------

def _blocks(nodes: DataFrame, bits: int, *columns: str) -> DataFrame:
    """nodes (key, place, size, digest, ...) shuffled by block and sorted by place."""
    nodes = nodes.withColumn("block", F.shiftright("place", bits)).withColumn("run", F.concat(F.col("block").cast("string"), F.lit(":"), F.col("key")))
    return nodes.repartition("run").sortWithinPartitions("run", "place").select("run", "key", "block", "size", "digest", *columns)


def _hex(column: pa.ChunkedArray) -> list[bytes]:
    return [d.hex().encode() for d in column.to_pylist()]


def _tree(block: pa.Table, bits: int) -> list[list[bytes]]:
    return sweep_up(_hex(block.column("digest")), levels(block.column("size")[0].as_py(), bits))


def _tops(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for block in runs(batches, "run"):
        size = block.column("size")[0].as_py()
        yield pa.RecordBatch.from_pydict({
            "key": block.column("key").slice(0, 1).combine_chunks(), "place": block.column("block").slice(0, 1).combine_chunks(),
            "size": pa.array([-(-size >> bits)], pa.int64()), "digest": pa.array([bytes.fromhex(_tree(block, bits)[-1][0].decode())], pa.binary())})


def _suffixes(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for block in runs(batches, "run"):
        proofs = sweep_down(_tree(block, bits), unpack(block.column("suffix")[0].as_py()))
        yield pa.RecordBatch.from_pydict({"key": block.column("key").combine_chunks(), "place": block.column("place").combine_chunks(), "suffix": pa.array([pack(p) for p in proofs], pa.binary())})


def climb(nodes: DataFrame, largest: int, bits: int, name: str) -> list[DataFrame]:
    """Tiers of nodes (key, place, size, digest) of all keys: the given ones, then the tops of their blocks, and so on; one node a key in the last."""
    tiers = [nodes]
    while largest > 1 or len(tiers) == 1:
        tops = _blocks(tiers[-1], bits).mapInArrow(lambda batches: _tops(batches, bits), "key string, place bigint, size bigint, digest binary")
        tiers.append(store(tops, name))
        largest = -(-largest >> bits)
    return tiers


def _with_suffix(nodes: DataFrame, suffixes: DataFrame, bits: int) -> DataFrame:
    """nodes with the suffix of their block's top: suffixes (key, place, suffix), one for each block."""
    above = suffixes.select("key", F.col("place").alias("__block"), "suffix")
    return nodes.withColumn("__block", F.shiftright("place", bits)).join(above, ["key", "__block"]).drop("__block")


def descend(tiers: list[DataFrame], suffixes: DataFrame, bits: int, name: str) -> DataFrame:
    """Suffixes (key, place, suffix) for the tops of the lowest blocks, from those of the highest (key, place 0, suffix)."""
    for tier in reversed(tiers[1:-1]):
        down = _blocks(_with_suffix(tier, suffixes, bits), bits, "place", "suffix").mapInArrow(lambda batches: _suffixes(batches, bits), "key string, place bigint, suffix binary")
        suffixes = store(down, name)
    return suffixes


_OUT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _verdicts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for block in runs(batches, "run"):
        tree = _tree(block, bits)
        proofs = sweep_down(tree, unpack(block.column("suffix")[0].as_py()))
        subroot, root = block.column("subroot")[0].as_py().hex(), block.column("root")[0].as_py().hex()
        folded = [fold(shown.hex().encode() if shown else own, proof) for own, shown, proof in zip(tree[0], block.column("shown").to_pylist(), proofs, strict=True)]
        n = len(folded)
        yield pa.RecordBatch.from_pydict({
            "doc_id": block.column("doc_id").combine_chunks(), "leaf": pa.array([d.decode() for d in tree[0]]), "subroot": pa.array([subroot] * n), "root": pa.array([root] * n),
            "proof_sha256": pa.array([p.decode() for _, p in folded]), "folded_root": pa.array([r.decode() for r, _ in folded]), "verified": pa.array([r.decode() == root for r, _ in folded])})


def manifest(docs: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the row as shown: every row whose id's crc32 7 divides is shown with
    a changed n_chars) and verified (it equals the root), a row for each row of docs."""
    spark = docs.sparkSession
    rows = store(numbered(store(leaves(docs), "leaves"), "key", ["doc_id", "leaf"], "leaves-sorted"), "leaves-numbered")
    nodes = rows.select("key", "place", "size", F.col("leaf").alias("digest"))
    largest = rows.agg(F.max("size")).first()[0]
    if largest is None:
        return spark.createDataFrame([], _OUT)
    tiers = climb(nodes, largest, block_bits, "tops")
    subroots = tiers[-1].select("key", F.col("digest").alias("subroot"))
    # The languages' own tree, over all subroots in order.
    langs = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("lang"), F.col("subroot").alias("digest")), "key", ["lang"], "subroots")
    langs = store(langs, "subroots-numbered")
    above = climb(langs.select("key", "place", "size", "digest"), langs.count(), block_bits, "roots")
    top = above[-1]
    start = top.select("key", F.lit(0).cast("bigint").alias("place"), F.lit(b"").alias("suffix"))
    down = descend(above, start, block_bits, "root-suffixes")
    last = _blocks(_with_suffix(langs.select("key", "place", "size", "digest"), down, block_bits), block_bits, "place", "suffix").mapInArrow(lambda batches: _suffixes(batches, block_bits), "key string, place bigint, suffix binary")
    suffixes = last.join(langs.select("key", "place", "lang"), ["key", "place"]).select(F.col("lang").alias("key"), F.lit(0).cast("bigint").alias("place"), "suffix")
    blocks = descend(tiers, store(suffixes, "suffixes"), block_bits, "suffixes")
    # One row a block: its suffix, subroot and the root (a single row).
    blocks = blocks.join(subroots, "key").crossJoin(F.broadcast(top.select(F.col("digest").alias("root"))))
    joined = _with_suffix(rows.withColumnRenamed("leaf", "digest"), blocks.select("key", "place", F.struct("suffix", "subroot", "root").alias("suffix")), block_bits)
    joined = joined.select("key", "place", "size", "digest", "doc_id", "shown", "suffix.*")
    return _blocks(joined, block_bits, "doc_id", "shown", "suffix", "subroot", "root").mapInArrow(lambda batches: _verdicts(batches, block_bits), _OUT)
