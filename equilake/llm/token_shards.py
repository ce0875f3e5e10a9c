"""Token ids in files of range asymmetric numeral system (rANS) blocks.

Documents are ordered by doc_id with a range shuffle and cut into segments of about SEGMENT ids. A segment has one static frequency
table, shared by its blocks, and blocks of BLOCK ids. A block's ids are dealt in turn to LANES interleaved
coders, each with a 64-bit state and 32-bit words; the block index keeps, for each block, its place, its count of ids and a
checksum, and for each lane the final state and the number of words: checkpoints from which any block, and any lane of it,
is decoded alone. Files are written by Spark's committed Parquet writer, a row a segment, so a lost executor
leaves no half-written file and any store that Spark writes will do.

Segment bytes, little-endian: magic "EQR2", u32 ids, u32 block size, u32 lanes, u32 table bytes, table (zlib: u32 count, u32 symbols,
u32 frequencies that sum to 2**20), u32 blocks, index (u32 offset, u32 bytes, u32 ids, u32 crc32 per block), blocks. A block: u64 states,
u32 word counts, u32 words lane by lane.

Defined cases: a null or empty text is the end id alone. Rows that share a doc_id follow each other in the order of a
hash of the text; a null doc_id comes first. Repeated rows are kept. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equilake.llm import text as T
from equilake.session import shared_folder

SEGMENT = 1 << 21
BLOCK = 1 << 15
LANES = 32
PRECISION = 20
END_ID = 0
_MAGIC = b"EQR2"
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_P = np.uint64(PRECISION)


# -- coder ---------------------------------------------------------------------------------------------------------

def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their frequencies, 1 at least, that sum to 2**PRECISION."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    total = 1 << PRECISION
    if len(symbols) > total:
        raise ValueError("more symbols than the precision of the table holds")
    spare = total - len(symbols)
    exact = counts[symbols] * (spare / counts.sum())
    freq = 1 + np.floor(exact).astype(np.int64)
    left = total - int(freq.sum())
    freq[np.argsort(np.floor(exact) - exact, kind="stable")[:left]] += 1
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def _lane_counts(ids: int, block: int, lanes: int) -> np.ndarray:
    """Ids of each (block, lane)."""
    sizes = np.minimum(block, ids - np.arange(0, max(ids, 1), block))
    return np.maximum(0, (sizes[:, None] - np.arange(lanes) + lanes - 1) // lanes)


def encode_segment(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> bytes:
    """The bytes of one segment."""
    ids = np.ascontiguousarray(ids, dtype=np.int64)
    head = struct.pack("<III", len(ids), block, lanes)
    if not len(ids):
        return _MAGIC + head + struct.pack("<II", 0, 0)
    symbols, freq = frequencies(ids)
    place = np.zeros(int(symbols[-1]) + 1, dtype=np.int64)
    place[symbols] = np.arange(len(symbols))
    f64, cum = freq.astype(np.uint64), np.concatenate(([0], np.cumsum(freq.astype(np.int64))))[:-1].astype(np.uint64)
    counts = _lane_counts(len(ids), block, lanes)
    blocks, steps = len(counts), int(counts.max())
    grid = np.zeros((blocks, steps * lanes), dtype=np.int64)
    for b in range(blocks):
        part = ids[b * block : (b + 1) * block]
        grid[b, : len(part)] = place[part]
    order = np.argsort(-counts.ravel(), kind="stable")
    grid = grid.reshape(blocks, steps, lanes).transpose(1, 0, 2).reshape(steps, -1)[:, order]
    need = counts.ravel()[order]
    active = np.searchsorted(-need, -np.arange(steps), side="left")
    state = np.full(blocks * lanes, _LOW, dtype=np.uint64)
    words = np.zeros((blocks * lanes, steps + 1), dtype=np.uint32)
    used = np.zeros(blocks * lanes, dtype=np.int64)
    for j in range(steps - 1, -1, -1):
        k = int(active[j])
        s = grid[j, :k]
        f, x = f64[s], state[:k]
        full = np.flatnonzero(x >= (f << np.uint64(63 - PRECISION)))
        words[full, used[full]] = x[full].astype(np.uint32)
        used[full] += 1
        x[full] >>= _WORD
        q = x // f
        state[:k] = (q << _P) + (x - q * f) + cum[s]
    back = np.argsort(order, kind="stable")
    state, used, words = state[back], used[back], words[back]
    table = zlib.compress(np.array([len(symbols)], "<u4").tobytes() + symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    bodies, index, at = [], [], 0
    for b in range(blocks):
        r = slice(b * lanes, (b + 1) * lanes)
        body = state[r].astype("<u8").tobytes() + used[r].astype("<u4").tobytes() + b"".join(words[i, : used[i]].astype("<u4").tobytes() for i in range(b * lanes, (b + 1) * lanes))
        index.append(struct.pack("<IIII", at, len(body), min(block, len(ids) - b * block), zlib.crc32(body)))
        bodies.append(body)
        at += len(body)
    return b"".join([_MAGIC, head, struct.pack("<I", len(table)), table, struct.pack("<I", blocks), *index, *bodies])


def decode_segment(data: bytes, only: list[int] | None = None) -> np.ndarray:
    """The ids of a segment, or of the named blocks in the order given. Raises ValueError if bytes are damaged."""
    data = bytes(data)
    if data[:4] != _MAGIC:
        raise ValueError("not a token segment")
    total, block, lanes, table_bytes = struct.unpack_from("<IIII", data, 4)
    table = np.frombuffer(zlib.decompress(data[20 : 20 + table_bytes]), "<u4") if table_bytes else np.zeros(1, "<u4")
    n = int(table[0])
    symbols, freq = table[1 : 1 + n].astype(np.int64), table[1 + n : 1 + 2 * n].astype(np.int64)
    (blocks,) = struct.unpack_from("<I", data, 20 + table_bytes)
    index = np.frombuffer(data, "<u4", blocks * 4, 24 + table_bytes).reshape(blocks, 4).astype(np.int64)
    base = 24 + table_bytes + blocks * 16
    chosen = list(range(blocks)) if only is None else only
    if not chosen or not total:
        return np.zeros(0, np.int64)
    states, useds, bodies = [], [], []
    for b in chosen:
        at, size, _, crc = index[b]
        body = data[base + at : base + at + size]
        if zlib.crc32(body) != crc:
            raise ValueError(f"checksum of block {b} does not match")
        states.append(np.frombuffer(body, "<u8", lanes))
        useds.append(np.frombuffer(body, "<u4", lanes, 8 * lanes))
        bodies.append(np.frombuffer(body, "<u4", -1, 12 * lanes))
    sizes = index[chosen, 2]
    counts = np.maximum(0, (sizes[:, None] - np.arange(lanes) + lanes - 1) // lanes).ravel()
    used = np.concatenate(useds).astype(np.int64)
    words = np.concatenate([*bodies, np.zeros(1, "<u4")]).astype(np.uint64)
    order = np.argsort(-counts, kind="stable")
    state = np.concatenate(states).astype(np.uint64)[order]
    top, need = np.cumsum(used)[order] - 1, counts[order]
    steps = int(counts.max())
    active = np.searchsorted(-need, -np.arange(steps), side="left")
    slot = np.repeat(np.arange(n, dtype=np.int32), freq)
    f64, cum = freq.astype(np.uint64), np.concatenate(([0], np.cumsum(freq)))[:-1].astype(np.uint64)
    out = np.zeros((steps, len(counts)), dtype=np.int32)
    low = np.uint64((1 << PRECISION) - 1)
    for j in range(steps):
        k = int(active[j])
        x = state[:k]
        r = x & low
        s = slot[r.astype(np.int64)]
        out[j, :k] = s
        x = f64[s] * (x >> _P) + r - cum[s]
        short = np.flatnonzero(x < _LOW)
        x[short] = (x[short] << _WORD) | words[top[short]]
        top[short] -= 1
        state[:k] = x
    if (state != _LOW).any():
        raise ValueError("a lane does not end in its first state")
    grid = np.empty_like(out)
    grid[:, order] = out
    grid = grid.reshape(steps, len(chosen), lanes).transpose(1, 0, 2).reshape(len(chosen), steps * lanes)
    return symbols[np.concatenate([grid[b, : sizes[b]] for b in range(len(chosen))])]


# -- tokenizer -----------------------------------------------------------------------------------------------------

class _Encoder:
    """Ids of units from the tokenizers library, as it is: an added token in a text (like an end mark) gets its own id.

    Units that begin with white space and end with a word are joined to long texts, since pre-tokens never
    cross their ends; others go alone. Added tokens hold no white space, so each lies in one unit; a vocabulary in which one takes
    the white space beside it is refused. Ids are dealt back to units by the byte lengths of the tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], dtype=np.int64)
        for i, added in self.tokenizer.get_added_tokens_decoder().items():
            if added.lstrip or added.rstrip or added.single_word or set(added.content) & set(" \t\n\x0b\x0c\r"):
                raise ValueError(f"added token {added.content!r} depends on what stands beside it")
            self.width[i] = len(added.content.encode())

    def __call__(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts, held, size = [], [], 0
        group: list[int] = []
        alone = [u[0] not in b" \t\n\x0b\x0c\r" or u[-1] <= 32 or u[-1] in (0x85, 0xA0, 0x80, 0xA8, 0xA9, 0xAF, 0x9F) for u in units]
        groups = [[i] for i, one in enumerate(alone) if one]
        for i, one in enumerate(alone):
            if not one:
                group.append(i)
                size += len(units[i])
                if size > 8192:
                    groups.append(group)
                    group, size = [], 0
        if group:
            groups.append(group)
        texts = [b"".join(units[i] for i in g).decode("utf-8", "replace") for g in groups]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        lengths = np.zeros(len(units), dtype=np.int64)
        for g, e in zip(groups, encoded, strict=True):
            ids = np.array(e.ids, dtype=np.int32)
            ends = np.cumsum([len(units[i]) for i in g])
            upto = np.searchsorted(np.cumsum(self.width[ids]), ends, "right") if len(g) > 1 else np.array([len(ids)])
            lengths[g] = np.diff(upto, prepend=0)
            held.append(ids)
        flat = np.concatenate(held) if held else np.zeros(0, np.int32)
        order = np.concatenate([np.array(g) for g in groups]) if groups else np.zeros(0, np.int64)
        by = lengths[order]
        begin = np.empty(len(units), dtype=np.int64)
        begin[order] = np.cumsum(by) - by
        skip = begin - (np.cumsum(lengths) - lengths)
        return flat[np.repeat(skip, lengths) + np.arange(int(lengths.sum()))], lengths


_CACHES: dict[str, T.UnitCache] = {}


def token_ids(column: pa.Array, path: str, end_id: int = END_ID) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids, ids of each row) of slices of a string column, the end id after each row."""
    cache = _CACHES.get(path) or _CACHES.setdefault(path, T.UnitCache(_Encoder(path)))
    for first, last in T.slices(column):
        raw, offsets = T.byte_view(column.slice(first, last - first))
        starts, ends, at = T.unit_spans(raw, offsets)
        ids, lengths = cache.gather(raw, starts, ends)
        upto = np.concatenate(([0], np.cumsum(lengths)))[at]
        yield first, last, np.insert(ids, upto[1:], end_id).astype(np.int32), np.diff(upto) + 1


# -- files ---------------------------------------------------------------------------------------------------------

_SHARD_SCHEMA = "part int, segment int, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, payload binary"


def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, segment: int) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ids, docs, sizes, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        flat = np.concatenate(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([sum(docs, [])], pa.list_(pa.int64())), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([encode_segment(flat)], pa.binary())],
            names=["part", "segment", "n_tokens", "doc_ids", "doc_tokens", "payload"])

    for batch in batches:
        names = batch.column("doc_id").to_pylist()
        for first, last, flat, counts in token_ids(batch.column("text"), path, end_id):
            ids.append(flat)
            docs.append(names[first:last])
            sizes.append(counts)
            held += len(flat)
            if held >= segment:
                yield flush()
                ids, docs, sizes, held, number = [], [], [], 0, number + 1
    if held:
        yield flush()


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Write the ids of docs (doc_id, text) in ascending doc_id order to a folder of segment files."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(lambda batches: _shards(batches, tokenizer_path, end_id, segment), _SHARD_SCHEMA).write.parquet(folder)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = decode_segment(batch.column("payload")[i].as_py()).astype("<u4")
            doc_ids, sizes = batch.column("doc_ids")[i].values, batch.column("doc_tokens")[i].values.to_numpy()
            ends = np.cumsum(sizes)
            if len(ids) != batch.column("n_tokens")[i].as_py() or int(sizes.sum()) != len(ids):
                raise ValueError("a segment's count of ids does not match")
            crc = [zlib.crc32(memoryview(ids[e - s : e]).cast("B")) for s, e in zip(sizes, ends, strict=True)]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch.column("part")[i].as_py(), np.int32)), pa.array(np.full(n, batch.column("segment")[i].as_py(), np.int32)), doc_ids, pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                names=["part", "segment", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_shards(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian u32), decoded from the files."""
    files = spark.read.schema(_SHARD_SCHEMA).parquet(folder)
    rows = files.mapInArrow(_decoded, "part int, segment int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    # Two levels of prefix sums: a row a part, then the segments of each part.
    heads = files.select("part", "segment", "n_tokens")
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")
    base = heads.withColumn("inside", inside).join(parts, "part").select("part", "segment", (F.col("before") + F.col("inside")).alias("base"))
    return rows.join(base, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("inner")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write docs to files (by default in the shared folder) and return what the files hold."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_shards(docs, folder, tokenizer_path)
    return read_shards(spark, folder)
