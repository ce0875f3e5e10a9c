"""SentencePiece pieces of whole texts: the best segmentation, the N best, and decoding.

The lattice of a text has an edge for every piece of the model that matches at a place (the blank stands for the model's mark, and a blank
is put before the text, as the model's own encoder does), and an edge of byte pieces for a character that is no piece. An edge weighs
-log(2 + rank) by the rank the model gives the piece (its score is the negative rank), a byte BYTE_SCORE: a Zipf estimate of
its log probability. White space is kept, so decoding gives back the text exactly.

No piece goes on after a blank that follows another character, so the lattice falls apart into units that end before such
blanks, and a text's score is the sum of its units'. For distinct units, forward Viterbi scores and, with backward scores,
the loss of the second best path are computed for many units at once and kept for a worker's life. Only the N - 1 units of a text
that lose least can differ among its N best segmentations; on those the N-best search runs: A-star backwards from the end of the
lattice, with the forward Viterbi scores, which are exact, as heuristic, so paths come out in order of their scores. The lists of
the units are then merged. Ties in score are resolved in favour of the longer last piece, and of the earlier unit.

A unit longer than LONG_UNIT bytes (a text without blanks) falls apart further, at the places that no edge crosses: every path goes through them, so
they cut the lattice exactly. What is kept of units, and the units worked on at once, are bounded by bytes.

Defined cases: a null or empty text has no pieces, the score 0 and one segmentation. Repeated rows are kept. Units of any length are searched whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilake.llm import text as T

N_BEST = 3
BYTE_SCORE = -12.0
LONG_UNIT = 64
#: Bytes of units whose lattices are held at once (an edge takes about 100 bytes), and bytes of a worker's caches.
LATTICE_BYTES, CACHE_BYTES, LIST_BYTES = 64 << 10, 32 << 20, 16 << 20
_NONE = -1e300


class Pieces:
    """Byte strings, ids and scores of a model's pieces, and a table of their prefixes by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.by_bytes: dict[bytes, int] = {}
        self.text: list[bytes] = [b""] * size
        self.score = np.full(size + 1, BYTE_SCORE)
        self.byte_id = np.zeros(256, dtype=np.int32)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.text[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.text[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                data = piece.replace("▁", " ").encode()
                if b" " in data.lstrip(b" "):
                    raise ValueError(f"piece {i} goes on after an inner blank")
                self.text[i] = data
                self.by_bytes[data] = i
                self.score[i] = -np.log(2.0 - model.get_score(i))
        self.longest = max(map(len, self.by_bytes))
        prefixes = {}
        for data, i in self.by_bytes.items():
            for n in range(1, len(data)):
                prefixes.setdefault(data[:n], -1)
            prefixes[data] = i
        # Prefix hash h(p + c) = (h(p) + code(c)) * R, extended a byte at a time along the text.
        self.code, self.base = T.stream(256, 21), np.uint64(0x9E3779B97F4A7C15)
        keys = np.zeros(len(prefixes), dtype=np.uint64)
        for k, p in enumerate(prefixes):
            h = 0
            for c in p:
                h = (h + int(self.code[c])) * int(self.base) & 0xFFFFFFFFFFFFFFFF
            keys[k] = h
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(prefixes.values()), dtype=np.int64)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("prefix hashes collide")
        # A first level of 2**16 ranges makes the search in the sorted keys short.

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is a prefix of a piece, id of the piece or -1)."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        ok = self.keys[at] == h
        return ok, np.where(ok, self.ids[at], -1)

    def cuts(self, unit: np.ndarray) -> np.ndarray:
        """The inner places of a unit that no edge crosses."""
        crossed = np.zeros(len(unit) + 1, dtype=np.int32)
        heads = np.flatnonzero((unit & 0xC0) != 0x80)
        np.add.at(crossed, heads + 1, 1)
        np.add.at(crossed, np.append(heads[1:], len(unit)), -1)
        for base in range(0, len(unit), LATTICE_BYTES):
            alive = np.arange(base, min(base + LATTICE_BYTES, len(unit)))
            h = np.zeros(len(alive), dtype=np.uint64)
            for n in range(self.longest):
                inside = alive + n < len(unit)
                alive, h = alive[inside], h[inside]
                if not len(alive):
                    break
                h = (h + self.code[unit[alive + n]]) * self.base
                ok, found = self.find(h)
                hit = alive[found >= 0]
                np.add.at(crossed, hit + 1, 1)
                np.add.at(crossed, hit + n + 1, -1)
                alive, h = alive[ok], h[ok]
        return np.flatnonzero(np.cumsum(crossed)[1:-1] == 0) + 1

    def edges_of(self, unit: bytes) -> list[list[tuple[int, int, float]]]:
        """For each end in a unit the edges (start, id or -1 for byte pieces, score), longest first."""
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(unit) + 1)]
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - self.longest), end):
                i = self.by_bytes.get(unit[start:end])
                if i is not None:
                    out[end].append((start, i, float(self.score[i])))
        for start, end in _characters(unit):
            if unit[start:end] not in self.by_bytes:
                out[end].append((start, -1, BYTE_SCORE * (end - start)))
        for edges in out:
            edges.sort()
        return out

    def pieces(self, unit: bytes, start: int, end: int, i: int) -> list[int]:
        return [i] if i >= 0 else [int(self.byte_id[b]) for b in unit[start:end]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a list of ids, without the blank put before it."""
        return b"".join([self.text[i] for i in ids])[1:]


def _characters(unit: bytes) -> list[tuple[int, int]]:
    starts = [i for i, c in enumerate(unit) if c & 0xC0 != 0x80] or [0]
    starts[0] = 0
    return list(zip(starts, [*starts[1:], len(unit)], strict=True))


def forward(edges: list[list[tuple[int, int, float]]]) -> list[float]:
    """Viterbi scores of the best path from the start to each place."""
    best = [_NONE] * len(edges)
    best[0] = 0.0
    for end in range(1, len(edges)):
        for start, _, score in edges[end]:
            if best[start] > _NONE and best[start] + score > best[end]:
                best[end] = best[start] + score
    return best


def a_star(pieces: Pieces, unit: bytes, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a unit, best first: A-star from the end, the forward scores as heuristic."""
    edges = pieces.edges_of(unit)
    ahead = forward(edges)
    heap: list[tuple[float, int, int, float, tuple | None]] = [(-ahead[-1], 0, len(unit), 0.0, None)]
    out, pushed = [], 0
    while heap and len(out) < n:
        _, _, place, done, path = heapq.heappop(heap)
        if place == 0:
            ids: list[int] = []
            while path is not None:
                start, end, i, path = path
                ids += pieces.pieces(unit, start, end, i)
            out.append((done, ids))
            continue
        for start, i, score in edges[place]:
            if ahead[start] > _NONE:
                pushed += 1
                heapq.heappush(heap, (-(done + score + ahead[start]), pushed, start, done + score, (start, place, i, path)))
    return out


def best_paths(pieces: Pieces, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids one after another, counts, scores, losses of the second best path; inf where there is none)."""
    counts, scores, losses = np.zeros(len(units), np.int64), np.zeros(len(units)), np.full(len(units), np.inf)
    held: list = [None] * len(units)
    short = [k for k, u in enumerate(units) if len(u) <= LONG_UNIT]
    for k, u in enumerate(units):
        if len(u) > LONG_UNIT:
            paths = a_star(pieces, u, 2)
            held[k], scores[k] = paths[0][1], paths[0][0]
            if len(paths) > 1:
                losses[k] = paths[0][0] - paths[1][0]
    groups = np.cumsum([len(units[k]) for k in short], dtype=np.int64) // LATTICE_BYTES
    for part in np.split(np.array(short, dtype=np.int64), np.flatnonzero(np.diff(groups)) + 1) if short else []:
        for k, (ids, score, loss) in zip(part, _many([units[k] for k in part], pieces), strict=True):
            held[k], scores[k], losses[k] = ids, score, loss
    for k, ids in enumerate(held):
        counts[k] = len(ids)
    return np.array([i for ids in held for i in ids], dtype=np.int32), counts, scores, losses


def _many(units: list[bytes], pieces: Pieces) -> Iterator[tuple[list[int], float, float]]:
    """The same for many short units at once: edges, forward and backward scores as arrays."""
    raw = np.frombuffer(b"".join(units), np.uint8)
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    unit_of = np.repeat(np.arange(len(units)), sizes)
    stop = (begin + sizes)[unit_of]
    # Places are numbered so that unit k has sizes[k] + 1 of them.
    place = np.arange(len(raw)) + unit_of
    alive, h = np.arange(len(raw)), np.zeros(len(raw), dtype=np.uint64)
    starts, ends, ids = [], [], []
    for n in range(pieces.longest):
        inside = alive + n < stop[alive]
        alive, h = alive[inside], h[inside]
        if not len(alive):
            break
        h = (h + pieces.code[raw[alive + n]]) * pieces.base
        ok, found = pieces.find(h)
        hit = np.flatnonzero(found >= 0)
        starts.append(alive[hit])
        ends.append(alive[hit] + n + 1)
        ids.append(found[hit])
        alive, h = alive[ok], h[ok]
    first = (raw & 0xC0) != 0x80
    first[begin] = True
    heads = np.flatnonzero(first)
    tails = np.concatenate((heads[1:], [len(raw)]))
    single = np.zeros(len(raw), dtype=np.int64)
    s, e = np.concatenate(starts), np.concatenate(ends)
    width = np.zeros(len(raw), dtype=np.int64)
    width[heads] = tails - heads
    exact = s[e - s == width[s]]
    single[exact] = 1
    bare = heads[single[heads] == 0]
    s = np.concatenate((s, bare))
    e = np.concatenate((e, bare + width[bare]))
    i = np.concatenate([*ids, np.full(len(bare), -1)])
    w = np.where(i >= 0, pieces.score[i], BYTE_SCORE * (e - s))
    unit = unit_of[s]
    a, b = place[s], place[s] + e - s
    local = b - (begin + np.arange(len(units)))[unit]
    order = np.lexsort((a, b, local))
    a, b, w, i, local, unit = a[order], b[order], w[order], i[order], local[order], unit[order]
    total = len(raw) + len(units)
    alpha, via = np.full(total, _NONE), np.full(total, -1)
    alpha[begin + np.arange(len(units))] = 0.0
    cuts = np.searchsorted(local, np.arange(1, int(local.max()) + 2))
    for k in range(len(cuts) - 1):
        lo, hi = cuts[k], cuts[k + 1]
        if lo == hi:
            continue
        value = alpha[a[lo:hi]] + w[lo:hi]
        heads = np.flatnonzero(np.concatenate(([True], b[lo + 1 : hi] != b[lo : hi - 1])))
        top = np.maximum.reduceat(value, heads)
        target = b[lo:hi][heads]
        alpha[target] = top
        equal = value == np.repeat(top, np.diff(np.append(heads, hi - lo)))
        via[target] = lo + np.minimum.reduceat(np.where(equal, np.arange(hi - lo), hi - lo), heads)
    # Backward scores, for the loss of the best path through each edge.
    order = np.lexsort((b, a, local - (b - a)))
    ra, rb, rw = a[order], b[order], w[order]
    rlocal = (local - (b - a))[order]
    beta = np.full(total, _NONE)
    last = begin + np.arange(len(units)) + sizes
    beta[last] = 0.0
    cuts = np.searchsorted(rlocal, np.arange(int(rlocal.max()) + 2))
    for k in range(len(cuts) - 2, -1, -1):
        lo, hi = cuts[k], cuts[k + 1]
        if lo == hi:
            continue
        value = beta[rb[lo:hi]] + rw[lo:hi]
        heads = np.flatnonzero(np.concatenate(([True], ra[lo + 1 : hi] != ra[lo : hi - 1])))
        beta[ra[lo:hi][heads]] = np.maximum.reduceat(value, heads)
    score = alpha[last]
    used = np.zeros(len(a), dtype=bool)
    here, path_edges, path_units = last.copy(), [], []
    open_ = np.arange(len(units))
    while len(open_):
        edge = via[here[open_]]
        used[edge] = True
        path_edges.append(edge)
        path_units.append(open_)
        here[open_] = a[edge]
        open_ = open_[here[open_] > (begin + np.arange(len(units)))[open_]]
    loss = np.full(len(units), np.inf)
    through = score[unit] - (alpha[a] + w + beta[b])
    through[used | (alpha[a] <= _NONE / 2) | (beta[b] <= _NONE / 2)] = np.inf
    np.minimum.at(loss, unit, np.maximum(through, 0.0))
    edge, of = np.concatenate(path_edges), np.concatenate(path_units)
    order = np.lexsort((a[edge], of))
    edge, of = edge[order], of[order]
    upto = np.searchsorted(of, np.arange(len(units) + 1))
    chosen = i[edge]
    from_, to = a[edge] - of, b[edge] - of
    if (chosen >= 0).all():
        flat = chosen.tolist()
        for k in range(len(units)):
            yield flat[upto[k] : upto[k + 1]], float(score[k]), float(loss[k])
        return
    for k in range(len(units)):
        ids = []
        for j in range(upto[k], upto[k + 1]):
            ids += [int(chosen[j])] if chosen[j] >= 0 else pieces.byte_id[raw[from_[j] : to[j]]].tolist()
        yield ids, float(score[k]), float(loss[k])


class Segmenter:
    """Encodes slices of texts; units are kept by hash for a worker's life."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.scores, self.losses = np.zeros(0), np.zeros(0)
        self.cache = T.UnitCache(self._encode, most_bytes=CACHE_BYTES)
        self.lists: dict[bytes, list[tuple[float, list[int]]]] = {}
        self.list_bytes = 0

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts, scores, losses = best_paths(self.pieces, units)
        if not len(self.cache.keys):
            self.scores, self.losses = self.scores[:0], self.losses[:0]
        self.scores, self.losses = np.concatenate((self.scores, scores)), np.concatenate((self.losses, losses))
        return ids, counts

    def n_best(self, unit: bytes, n: int) -> list[tuple[float, list[int]]]:
        paths = self.lists.get(unit)
        if paths is None:
            paths = a_star(self.pieces, unit, n)
            self.list_bytes += 200 + len(unit) + sum(100 + 40 * len(p) for _, p in paths)
            if self.list_bytes > LIST_BYTES:
                self.lists.clear()
                self.list_bytes = 0
            self.lists[unit] = paths
        return paths

    def encode(self, column: pa.Array, n: int) -> Iterator[tuple]:
        """(ids of each row, scores of the n best of each row, changes of each alternative, decoded bytes equal the text)."""
        raw, offsets = T.byte_view(column)
        full = np.flatnonzero(np.diff(offsets))
        led = np.insert(raw, offsets[full], 32)
        led_at = offsets + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
        starts, ends, at = T.unit_spans(led, led_at, blanks_only=True)
        long = np.flatnonzero(ends - starts > LONG_UNIT)
        if len(long):
            more = [starts[k] + self.pieces.cuts(led[starts[k] : ends[k]]) for k in long]
            starts = np.sort(np.concatenate((starts, *more)))
            ends = np.append(starts[1:], len(led))
            at = np.searchsorted(starts, led_at).astype(np.int64)
        if len(starts):
            codes, slot = self.cache.slots(led, starts, ends)
            lengths, begins = self.cache.lengths[slot][codes], self.cache.begins[slot][codes]
            upto = np.concatenate(([0], np.cumsum(lengths)))
            ids = self.cache.values[np.repeat(begins - upto[:-1], lengths) + np.arange(int(upto[-1]))]
            scores, losses = self.scores[slot][codes], self.losses[slot][codes]
        data, led_data = raw.tobytes(), led.tobytes()
        for r in range(len(offsets) - 1):
            lo, hi = int(at[r]), int(at[r + 1])
            if lo == hi:
                yield np.zeros(0, np.int32), [0.0], [[]], True
                continue
            own = ids[upto[lo] : upto[hi]]
            total, loss = float(scores[lo:hi].sum()), losses[lo:hi]
            few = np.argsort(loss, kind="stable")[: n - 1] if hi - lo < 64 or n < 2 else self._least(loss, n - 1)
            lists = [[(s - scores[lo + u], p) for s, p in self.n_best(led_data[starts[lo + u] : ends[lo + u]], n)] for u in few if np.isfinite(loss[u])]
            merged: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
            for options in lists:
                merged = sorted(((d + o[0], c + (k,)) for d, c in merged for k, o in enumerate(options)), key=lambda x: (-x[0], x[1]))[:n]
            changes = [[(int(few[k]), lists[k][c][1]) for k, c in enumerate(combo) if c] for _, combo in merged]
            yield own, [total + min(d, 0.0) for d, _ in merged], changes, self.pieces.decode(own) == data[offsets[r] : offsets[r + 1]]

    @staticmethod
    def _least(loss: np.ndarray, n: int) -> np.ndarray:
        """Indexes of the n least values, the earlier first among equal ones."""
        edge = np.partition(loss, n - 1)[n - 1]
        near = np.flatnonzero(loss <= edge)
        return near[np.argsort(loss[near], kind="stable")][:n]


_SEGMENTERS: dict[str, Segmenter] = {}
_ADDED = "pieces array<int>, n_pieces bigint, score double, scores array<double>, changes array<array<struct<unit:int,pieces:array<int>>>>, exact boolean"
_CHANGES = pa.list_(pa.list_(pa.struct([("unit", pa.int32()), ("pieces", pa.list_(pa.int32()))])))


def _segment(batches: Iterator[pa.RecordBatch], text: str, path: str, n: int) -> Iterator[pa.RecordBatch]:
    segmenter = _SEGMENTERS.get(path) or _SEGMENTERS.setdefault(path, Segmenter(path))
    for batch in batches:
        for first, last in T.slices(batch.column(text)):
            part = batch.slice(first, last - first)
            rows = list(segmenter.encode(part.column(text), n))
            sizes = np.array([len(r[0]) for r in rows], dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate([r[0] for r in rows]).astype(np.int32)))
            changes = pa.array([[[{"unit": u, "pieces": p} for u, p in alternative] for alternative in r[2]] for r in rows], type=_CHANGES)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, lists, pa.array(sizes), pa.array([r[1][0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), changes, pa.array([r[3] for r in rows], pa.bool_())],
                names=[*part.schema.names, "pieces", "n_pieces", "score", "scores", "changes", "exact"])


def segment(docs: DataFrame, path: str, text: str = "text", n_best: int = N_BEST) -> DataFrame:
    """docs with pieces (ids of the best segmentation), n_pieces, score, scores (of the n best, best first), changes (for
    each of those the units whose pieces differ from the best) and exact (the decoded pieces are the text). Clashing columns are replaced.
    """
    docs = docs.drop("pieces", "n_pieces", "score", "scores", "changes", "exact").withColumn(text, F.col(f"`{text}`").cast("string"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(lambda batches: _segment(batches, text, path, n_best), ", ".join([*fields, _ADDED]))
