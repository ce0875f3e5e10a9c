"""Prefix trie of conversations with a minimal-perfect-hash node table per shard.

Turns are ordered and chained to prefix digests (SHA-256 of the parent's digest and the turn) in one streamed pass; only digests go on from there. A shard
holds some whole conversations, so a prefix that a third of all conversations share is one node in each shard and never a
group of rows. In a shard the distinct prefix digests get the slots 0..n-1 by a minimal perfect hash (levels of bit
vectors: keys that meet at a place go on to the next level, and a key's slot is the rank of its bit). The digest stored
in a slot is compared with the key that asks for it, so an unknown key is never taken for a node. Counts are scattered into flat
arrays by slot. Two passes over the shards:

1. members, ends and least member of each local node; summed over the shards by digest.
2. with the sums: the shard that holds a node's least member owns it. What an owned node adds (a leaf, its saved tokens, a child of its parent) is
   scattered into its slot and accumulated through the array of parent slots, deepest first. The partial sums are added up by digest.

The members that end in a node are hashed in order from pieces joined in a range shuffle.

Defined cases: rows without conv_id belong to no conversation. A null role or text is empty. Turns of equal number follow each other by role, then
text; repeated rows are turns of their own. Negative ids take the remainder's sign, as in SQL. Extra columns are ignored. An empty table gives no
node. A conversation is the unit of a shard: its digests (not its texts) are held in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilake.llm import text as T
from equilake.llm.runs import runs
from equilake.session import store

FAMILY = 100
SHARD_ROWS = 200_000
MOST_HEAD = 6
PIECE_IDS = 50_000
ROOT = hashlib.sha256(b"").digest()
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


# -- minimal perfect hash --------------------------------------------------------------------------------------------

class SlotTable:
    """A minimal perfect hash of distinct 32-byte digests, with the digest of each slot for verification."""

    def __init__(self, digests: np.ndarray):
        """digests: (n, 4) uint64, distinct."""
        self.size = len(digests)
        self.bits: list[np.ndarray] = []
        self.base: list[int] = []
        left, base = digests, 0
        while len(left):
            width = max(2 * len(left), 8)
            at = self._place(left, len(self.bits), width)
            alone = np.bincount(at, minlength=width) == 1
            self.bits.append(alone)
            self.base.append(base)
            base += int(alone.sum())
            left = left[~alone[at]]
        self.rank = [np.cumsum(b) - 1 for b in self.bits]
        self.digests = np.empty_like(digests)
        self.digests[self._slots(digests)] = digests

    @staticmethod
    def _place(digests: np.ndarray, level: int, width: int) -> np.ndarray:
        # Every level mixes other words of the digest, so keys that agree in one word part sooner or later.
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        mixed = digests[:, level % 4] ^ T.mix(digests[:, (level + 1) % 4] + seed)
        return (T.mix(mixed) % np.uint64(width)).astype(np.int64)

    def _slots(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1, dtype=np.int64)
        open_ = np.arange(len(digests))
        for level, bits in enumerate(self.bits):
            at = self._place(digests[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.base[level] + self.rank[level][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slots of digests; -1 for those that are not in the table."""
        if not self.size or not len(digests):
            return np.full(len(digests), -1, dtype=np.int64)
        out = self._slots(digests)
        known = out >= 0
        known[known] = (self.digests[out[known]] == digests[known]).all(axis=1)
        return np.where(known, out, -1)


def _words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Binary digests as (n, 4) uint64."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 4) if len(column) else np.zeros((0, 4), dtype=np.uint64)


def _digests(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


# -- prefixes --------------------------------------------------------------------------------------------------------

_STEPS = "shard bigint, conv_id bigint, depth bigint, node binary, parent binary, chars bigint, last boolean"


def _chain(batches: Iterator[pa.RecordBatch], shard_rows: int) -> Iterator[pa.RecordBatch]:
    """Prefix digests of the rebuilt conversations from turns sorted by family, conversation and order.

    A family's first conversation is the one whose id 100 divides, if there is one; its first turns are the heads of the others.
    """
    part = TaskContext.get().partitionId()
    number, in_shard = 0, 0
    family = conv = None
    head: list[tuple[bytes, int]] = []
    seen = depth = skip = 0
    node = ROOT
    out: list[tuple] = []

    def step(digest: bytes, chars: int) -> None:
        nonlocal node, depth
        parent, node = node, hashlib.sha256(node + digest).digest()
        depth += 1
        out.append((part << 32 | number, conv, depth, node, parent, chars, False))

    def close() -> None:
        if conv is not None:
            out[-1] = (*out[-1][:6], True)

    def rows(upto: int) -> pa.RecordBatch:
        done = out[:upto]
        del out[:upto]
        columns = list(zip(*done, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "conv_id", "depth", "node", "parent", "chars", "last"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("family", "conv_id", "taken", "digest", "chars")]
        for fam, c, taken, digest, chars in zip(*columns, strict=True):
            if c != conv:
                close()
                if in_shard >= shard_rows:
                    number, in_shard = number + 1, 0
                if fam != family:
                    family, head = fam, []
                conv, seen, depth, skip, node = c, 0, 0, taken, ROOT
                out.append((part << 32 | number, conv, 0, ROOT, None, 0, False))
                if c != family:
                    for d, n in head[:skip]:
                        step(d, n)
            if c == family and seen < MOST_HEAD:
                head.append((digest, chars))
            if c == family or seen >= skip:
                step(digest, chars)
            seen += 1
            in_shard += 1
        # The last row may still become the end of its conversation.
        if len(out) > 1:
            yield rows(len(out) - 1)
    close()
    if out:
        yield rows(len(out))


def prefixes(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: shard, conv_id, depth, node, parent, chars of the last turn, and whether it is the whole conversation.

    Conversation c begins with the first h turns of conversation c - c % 100, h = crc32(c as text) % 6; its own turns after its first h follow.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    first = F.col("conv_id") != F.col("family")
    ordered = turns.repartition("family").sortWithinPartitions("family", first, "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    # Only digests and lengths reach Python.
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD
    small = ordered.select("family", "conv_id", taken.alias("taken"), digest.alias("digest"), F.char_length("text").cast("bigint").alias("chars"))
    return small.mapInArrow(lambda batches: _chain(batches, shard_rows), _STEPS)


# -- shards ----------------------------------------------------------------------------------------------------------

_LOCAL = "shard bigint, node binary, parent binary, depth bigint, chars bigint, members bigint, ends bigint, least bigint"


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct nodes of each shard with their counts."""
    for shard in runs(batches, "shard"):
        node = _words(shard.column("node"))
        distinct = np.unique(node, axis=0)
        table = SlotTable(distinct)
        slot = table.slots(node)
        n = table.size
        conv, last = _numbers(shard, "conv_id"), shard.column("last").to_numpy(zero_copy_only=False)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, slot, conv)
        any_row = np.empty(n, dtype=np.int64)
        any_row[slot] = np.arange(len(slot))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, shard.column("shard")[0].as_py())), _digests(table.digests), shard.column("parent").take(pa.array(any_row)).combine_chunks(), pa.array(_numbers(shard, "depth")[any_row]), pa.array(_numbers(shard, "chars")[any_row]),
             pa.array(np.bincount(slot, minlength=n)), pa.array(np.bincount(slot[last], minlength=n)), pa.array(least)],
            names=["shard", "node", "parent", "depth", "chars", "members", "ends", "least"])


_PARTIAL = "node binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def accumulate(parent: np.ndarray, depth: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Subtree sums by slot: values are added to the parent's slot (-1: none), deepest nodes first."""
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    sums = [v.astype(np.int64, copy=True) for v in values]
    for level in np.split(order, cuts):
        level = level[parent[level] >= 0]
        for s in sums:
            np.add.at(s, parent[level], s[level])
    return sums


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of each shard: what its owned nodes add to themselves and to the nodes above."""
    for shard in runs(batches, "shard"):
        node = _words(shard.column("node"))
        table = SlotTable(node)
        slot = table.slots(node)
        n = table.size
        back = np.empty(n, dtype=np.int64)
        back[slot] = np.arange(n)
        shard = shard.take(pa.array(back))
        up = shard.column("parent")
        has = ~up.is_null().to_numpy(zero_copy_only=False)
        parent = np.full(n, -1, dtype=np.int64)
        parent[has] = table.slots(_words(up.filter(pa.array(has))))
        depth, members, conv = _numbers(shard, "depth"), _numbers(shard, "n_convs"), _numbers(shard, "conv_id")
        owned = _numbers(shard, "least") == conv
        leaf = owned & (_numbers(shard, "ends_all") == members)
        gain = np.where(owned, (members - 1) * _numbers(shard, "chars"), 0)
        leaves, saved = accumulate(parent, depth, leaf, gain)
        children = np.zeros(n, dtype=np.int64)
        below = owned & has
        np.add.at(children, parent[below], 1)
        up_conv = np.where(has, conv[parent], 0)
        nobody = ~owned
        yield pa.RecordBatch.from_arrays(
            [_digests(table.digests), pa.array(conv, mask=nobody), pa.array(depth, mask=nobody), pa.array(up_conv, mask=nobody | ~has), pa.array(members, mask=nobody), pa.array(children), pa.array(leaves), pa.array(saved)],
            names=["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"])


# -- ends ------------------------------------------------------------------------------------------------------------

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined ids of stretches of a node's ends, of PIECE_IDS at most, from rows sorted by node and id."""
    for batch in batches:
        nodes, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
        out: list[tuple[bytes, int, str]] = []
        first = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or nodes[i] != nodes[first] or i - first >= PIECE_IDS:
                out.append((nodes[first], ids[first], ",".join(map(str, ids[first:i]))))
                first = i
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate([pa.binary(), pa.int64(), pa.string()])], names=["node", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node in order; one digest state is held."""
    node, state = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if n != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def ends_digest(steps: DataFrame) -> DataFrame:
    """node, ends_sha256: the hash of the ids of the conversations that end in a node, ascending."""
    rows = steps.where("last").select("node", "conv_id")
    joined = rows.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node binary, first bigint, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_hashed, "node binary, ends_sha256 string")


def trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    steps = store(prefixes(conversations, shard_rows), "prefixes")
    local = store(steps.repartition("shard").sortWithinPartitions("shard").mapInArrow(_enumerate, _LOCAL), "nodes")
    sums = local.groupBy("node").agg(F.sum("members").alias("n_convs"), F.sum("ends").alias("ends_all"), F.min("least").alias("conv_id"))
    known = local.join(sums, "node").repartition("shard").sortWithinPartitions("shard")
    partial = known.mapInArrow(_sum_up, _PARTIAL)
    total = partial.groupBy("node").agg(
        *[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")], *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    return total.join(ends_digest(steps), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
