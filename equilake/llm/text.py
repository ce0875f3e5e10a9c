"""Words and shingles of whole texts as NumPy arrays, for use inside Arrow batches.

A word is a run of bytes other than space and tab to carriage return; those are ASCII, so cutting the
UTF-8 bytes equals cutting the characters. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Text worked on at a time: the arrays of a slice take about 50 times as much.
SLICE_BYTES = 1 << 20
SHINGLE = 5

_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit constants."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * step) | np.uint64(1)


_BYTE_CODE = stream(256, 1)
_SHINGLE_CODE = stream(SHINGLE + 1, 2)
_POWER = stream(256, 3)


def _powers(n: int) -> np.ndarray:
    global _POWER
    if n > len(_POWER):
        _POWER = stream(2 * n, 3)
    return _POWER


def _trim() -> None:
    """Inside a task, give freed memory back to the system: an executor's workers are reused by all stages, and Arrow's own
    pools and the C library keep freed pages."""
    if TaskContext.get() is None:
        return
    if pa.default_memory_pool().backend_name != "system":
        pa.default_memory_pool().release_unused()
        pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes of text, one row at least, so that memory stays bounded."""
    sizes = np.cumsum(np.diff(byte_view(column)[1]))
    first = 0
    while first < len(column):
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + size, "right")))
        yield first, last
        first = last
    _trim()


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def _edges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _WORD_BYTE[raw]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    at = offsets[full]
    starts[at] = inside[at]
    at = offsets[full + 1] - 1
    ends[at] = inside[at]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that lie in order and do not overlap.

    Works through the bytes in pieces of about a MB of whole spans.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + (1 << 20), "right")))
        base, stop = starts[first], ends[last - 1]
        s, e = starts[first:last] - base, ends[first:last] - base
        lengths = e - s
        keep = np.zeros(stop - base + 1, dtype=np.int8)
        keep[s] += 1
        keep[e] -= 1
        keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        value = _BYTE_CODE[raw[base:stop][keep]] * _powers(int(lengths.max()))[place]
        value ^= value >> np.uint64(29)
        out[first:last] = np.add.reduceat(value, begin) + lengths.astype(np.uint64)
        first = last
    return mix(out)


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the offsets of the rows among them. lower: A-Z only."""
    starts, ends = _edges(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    hashes = hash_spans(_LOWER[raw] if lower else raw, starts, ends)
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(word: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `size` words of each row, in order, and the rows' offsets among them.

    A row with fewer words, but one at least, has one shingle: its whole sequence.
    """
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(n)), count)
    first = at[:-1][row] + np.arange(out_at[-1]) - out_at[:-1][row]
    out = np.zeros(len(first), dtype=np.uint64)
    end = at[1:][row]
    for k in range(size):
        here = first + k
        ok = here < end
        out[ok] += mix(word[here[ok]] + _SHINGLE_CODE[k]) * _SHINGLE_CODE[k]
    short = np.minimum(n, size)[row].astype(np.uint64)
    return mix(out + short * _SHINGLE_CODE[size]), out_at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the rows' offsets among them."""
    parts = [np.unique(values[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the rows' offsets among them."""
    raw, offsets = byte_view(column)
    return distinct(*shingles(*words(raw, offsets), size))


def unit_spans(raw: np.ndarray, offsets: np.ndarray, blanks_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units of each row (white space, then a word), and the rows' offsets among them.

    The units cover every byte. They are cut where ASCII white space follows a character that is neither
    white space of any script nor a control character, so that no pre-token of a byte-level or of a
    SentencePiece tokenizer crosses a cut. blanks_only: cut before blanks only, for pieces that hold other white space.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = raw == 32 if blanks_only else ~_WORD_BYTE[raw]
    cut = np.zeros(len(raw), dtype=bool)
    cut[1:] = space[1:] & (raw[:-1] > 32)
    p2 = np.concatenate(([0], raw))[:-2] if len(raw) > 1 else raw[:0]
    p3 = np.concatenate(([0, 0], raw))[:-3] if len(raw) > 1 else raw[:0]
    wide = ((p2 == 0xC2) & ((raw[:-1] == 0xA0) | (raw[:-1] == 0x85))) | ((p3 >= 0xE1) & (p3 <= 0xE3) & np.isin(p2, [0x80, 0x81, 0x9A]))
    cut[1:] &= ~wide
    full = np.flatnonzero(np.diff(offsets))
    cut[offsets[full]] = True
    starts = np.flatnonzero(cut)
    return starts, np.concatenate((starts[1:], [len(raw)])), np.searchsorted(starts, offsets).astype(np.int64)


class UnitCache:
    """What a function of a unit has given so far, kept by 64-bit hash for a worker's life.

    encode(list of byte strings) returns (flat values, lengths). The cache is emptied when it holds `most` units or
    `most_bytes` bytes; that changes only the speed.
    """

    def __init__(self, encode, most: int = 1_500_000, most_bytes: int = 128 << 20):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self._clear()

    @property
    def size(self) -> int:
        """Bytes held."""
        return 32 * len(self.keys) + (0 if self.values is None else self.values.nbytes)

    def _clear(self) -> None:
        self.keys, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lengths, self.begins = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values: np.ndarray | None = None

    def slots(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the units among the distinct ones, cache slots of the distinct ones)."""
        import pandas as pd

        codes, unique = pd.factorize(hash_spans(raw, starts, ends))
        if len(self.keys) + len(unique) > self.most or self.size > self.most_bytes:
            self._clear()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        if not known.all():
            first = np.empty(len(unique), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            new = np.flatnonzero(~known)
            data = raw.tobytes()
            flat, lengths = self.encode([data[starts[i] : ends[i]] for i in first[new]])
            slot = len(self.lengths) + np.arange(len(new))
            base = 0 if self.values is None else len(self.values)
            self.begins = np.concatenate((self.begins, base + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.values = flat if self.values is None else np.concatenate((self.values, flat))
            order = np.argsort(unique[new])
            place = np.searchsorted(self.keys, unique[new][order])
            self.keys = np.insert(self.keys, place, unique[new][order])
            self.where = np.insert(self.where, place, slot[order])
            at = np.searchsorted(self.keys, unique)
        return codes, self.where[at]

    def gather(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all units in order, and how many each unit has."""
        if not len(starts):
            return (self.values[:0] if self.values is not None else np.zeros(0, np.int32)), np.zeros(0, np.int64)
        codes, slot = self.slots(raw, starts, ends)
        lengths, begins = self.lengths[slot][codes], self.begins[slot][codes]
        skip = begins - (np.cumsum(lengths) - lengths)
        return self.values[np.repeat(skip, lengths) + np.arange(int(lengths.sum()))], lengths
