"""Scores of texts under a bigram model with deleted interpolation, learned from the training rows of the same table.

p(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of the context's count (powers of two). The weights of
each bucket are learned by expectation-maximisation: counts without the deleted fold predict the events of that fold. The final counts are those of all
training rows. Every word is a context of its own, however rare. A text starts in a start context and ends with an end token.

Words and pairs are few when frequent and many when rare, so they are counted in two ways, both exact; which words go which way changes no score:
* At most 1 / WORD_SHARE words and 1 / PAIR_SHARE pairs can have such a share of all tokens. They are found by the partition method (what is frequent
  in the whole is frequent in some chunk) and counted in a second pass as dense arrays, combined before they move. These arrays
  are all that is broadcast; their size is bounded by those two numbers.
* All other occurrences are rows (key, other side, document), dealt out by the rare word (the predicted one if both are), or by the pair if both words are
  frequent. A key has at most 2 * PAIR_SHARE or 4 * WORD_SHARE of the tokens, so no task gets a hot key. A task sorts its rows, counts groups, and gives for each bucket
  and estimates the documents of the events, in steps of 1 / STEPS of a decade (0.2 %); the model uses the estimates so rounded.
* A word is followed by a token wherever it stands, so its count as a context is its count as a word. Where both words are rare, the pairs and their counts are dealt out
  once more, by context, and meet the context's count there.
The events of the deleted fold are summed by bucket and estimates, in steps of 1 / EM_STEPS; that table is bounded by the roundings, and EM runs on it.

Defined cases: null and empty texts are the end token alone. A null doc_id counts as the text "" for the fold. Rows with the same doc_id and text share
their rare events and divide them; rows with the same doc_id and other texts are told apart by a hash. If no row is for training, all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilake.llm import text as T
from equilake.session import store

WORD_SHARE = 1e-6
PAIR_SHARE = 2e-6
CHUNK_TOKENS = 4_000_000
EVENTS = 200_000
STEPS, EM_STEPS = 500, 50
FOLDS, HELD_OUT, DELETED = 7, 2, 3
ROUNDS = 60

FIT, DEL, OUT = 0, 1, 2
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)
_NEVER = 8191
_PAIR = T.stream(2, 31)
#: Kinds of events: both words frequent; rare word in a frequent context; both rare; frequent word in a rare context.
_FREQUENT, _WORD, _BOTH, _CONTEXT = 0, 1, 2, 3
SORTED_ROWS = 500_000
#: Events that a task packs at a time, and that it reads at most on average.
PACK_EVENTS, TASK_EVENTS = 1_500_000, 2_000_000


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, fold and d, the key of a row's events."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    left = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = rows.withColumn("fold", F.when(left == HELD_OUT, OUT).when(left == DELETED, DEL).otherwise(FIT))
    twice = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.coalesce("doc_id", F.lit(0)).alias("key"), F.col("doc_id").isNull().alias("none"))
    if twice.isEmpty():
        return rows.withColumn("d", F.col("doc_id"))
    marked = rows.withColumn("key", F.coalesce("doc_id", F.lit(0))).withColumn("none", F.col("doc_id").isNull()).join(twice.withColumn("again", F.lit(True)), ["key", "none"], "left")
    return marked.select("doc_id", "text", "fold", F.when(F.col("again"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("d"))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, contexts, row of each token) of a string column."""
    raw, offsets = T.byte_view(column)
    word, at = T.words(raw, offsets)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at) + 1)
    return np.insert(word, at[1:], _END), np.insert(word, at[:-1], _START), row


def _pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return T.mix(context * _PAIR[0] + T.mix(token ^ _PAIR[1]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, contexts) of slices, gathered to about CHUNK_TOKENS."""
    held: list[tuple] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        out = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        held.clear()
        return out

    for batch in batches:
        for first, last in T.slices(batch.column("text")):
            token, context, _ = _tokens(batch.column("text").slice(first, last - first))
            held.append((token, context))
            size += len(token)
            if size >= CHUNK_TOKENS:
                yield joined()
                size = 0
    if held:
        yield joined()


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and pairs that have their share in a chunk, and the number of tokens (pair null, key null)."""
    for token, context in _chunks(batches):
        out = []
        for pair, share in ((False, WORD_SHARE), (True, PAIR_SHARE)):
            codes, unique = pd.factorize(_pair(context, token) if pair else token)
            n = np.bincount(codes, minlength=len(unique))
            del codes
            keep = n >= share * len(token)
            out.append((np.full(int(keep.sum()), pair), unique[keep].view(np.int64), n[keep]))
        pairs, keys, n = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([None, *pairs.tolist()], pa.bool_()), pa.array([0, *keys.tolist()], pa.int64()), pa.array([len(token), *n.tolist()], pa.int64())], names=["pair", "key", "n"])


class Frequent:
    """The frequent words and pairs: sorted hashes. Bounded by 1 / WORD_SHARE + 2 and 1 / PAIR_SHARE."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        self.words = np.unique(np.concatenate((words.astype(np.uint64), np.array([_START, _END], np.uint64))))
        self.pairs = np.unique(pairs.astype(np.uint64))

    @staticmethod
    def _at(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(sorted_):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
        return np.where(sorted_[at] == values, at, -1)

    def place(self, token: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word index or -1, context index or -1, index of the frequent pair or -1)."""
        both = np.concatenate((token, context))
        codes, unique = pd.factorize(both)
        at = self._at(self.words, unique)[codes]
        w, v = at[: len(token)], at[len(token) :]
        dense = np.full(len(token), -1)
        known = np.flatnonzero((w >= 0) & (v >= 0))
        dense[known] = self._at(self.pairs, _pair(context[known], token[known]))
        return w, v, dense


def _dense(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Exact counts of the frequent words (as tokens), contexts and dense events in a task's rows, by fold: kind, index, fit, deleted, and of an event its context and word."""
    f: Frequent = shared.value
    sizes = (len(f.words), len(f.words), len(f.pairs))
    totals = [np.zeros((2, n), dtype=np.int64) for n in sizes]
    tokens = np.zeros(2, dtype=np.int64)
    of_context, of_word = np.zeros(sizes[2], np.int64), np.zeros(sizes[2], np.int64)
    for batch in batches:
        fold = batch.column("fold").to_numpy()
        for first, last in T.slices(batch.column("text")):
            token, context, row = _tokens(batch.column("text").slice(first, last - first))
            w, v, dense = f.place(token, context)
            of = fold[first:last][row]
            full = dense >= 0
            of_context[dense[full]], of_word[dense[full]] = v[full], w[full]
            for k in (FIT, DEL):
                here = of == k
                tokens[k] += int(here.sum())
                totals[0][k] += np.bincount(w[here & (w >= 0)], minlength=sizes[0])
                totals[1][k] += np.bincount(v[here & (v >= 0)], minlength=sizes[1])
                totals[2][k] += np.bincount(dense[here & (dense >= 0)], minlength=sizes[2])
    kinds, places, counts, sides = [np.full(1, 3)], [np.zeros(1, np.int64)], [tokens[:, None]], [np.zeros((2, 1), np.int64)]
    for kind, total in enumerate(totals):
        used = np.flatnonzero(total.any(axis=0))
        kinds.append(np.full(len(used), kind))
        places.append(used)
        counts.append(total[:, used])
        sides.append(np.stack((of_context[used], of_word[used])) if kind == 2 else np.zeros((2, len(used)), np.int64))
    n, (contexts, words) = np.concatenate(counts, axis=1), np.concatenate(sides, axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds), pa.int32()), pa.array(np.concatenate(places), pa.int64()), pa.array(n[FIT]), pa.array(n[DEL]), pa.array(contexts), pa.array(words)], names=["kind", "place", "fit", "deleted", "context", "word"])


class Model:
    """Dense counts by fold, and the context and word of each dense event."""

    def __init__(self, frequent: Frequent):
        self.frequent = frequent
        n, m = len(frequent.words), len(frequent.pairs)
        self.word, self.context, self.event = np.zeros((2, n), np.int64), np.zeros((2, n), np.int64), np.zeros((2, m), np.int64)
        self.tokens = np.zeros(2, np.int64)
        self.of_context, self.of_word = np.zeros(m, np.int64), np.zeros(m, np.int64)


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64), 0)


def _steps(a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """-log10(a / b) in so many steps to a decade; _NEVER where a or b is 0."""
    ok = (a > 0) & (b > 0)
    return np.where(ok, np.minimum(np.rint(-steps * np.log10(np.where(ok, a, 1) / np.where(ok, b, 1))), _NEVER - 1), _NEVER).astype(np.int64)


def _cell(bucket: np.ndarray, two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bucket and both estimates in 32 bits; 13 bits hold 16 decades in 500 steps."""
    return ((bucket << 26) | (two << 13) | one).astype(np.uint32)


def _uncell(cell: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cell = cell.astype(np.int64)
    p = lambda x: np.where(x == _NEVER, 0.0, 10.0 ** (-x / steps))
    return cell >> 26, p((cell >> 13) & 8191), p(cell & 8191)


def _packed(key: np.ndarray, x: np.ndarray, d: np.ndarray) -> bytes:
    """Events sorted by key as bytes: the keys' differences, x and d, each laid out byte by byte of its value, then zstd."""
    columns = np.stack([np.diff(key.view(np.uint64), prepend=np.uint64(0)), x.view(np.uint64), d.view(np.uint64)])
    planes = columns.view(np.uint8).reshape(3, len(key), 8).transpose(0, 2, 1)
    return np.int64(len(key)).tobytes() + pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    planes = np.frombuffer(pa.decompress(data[8:], 24 * n, codec="zstd"), np.uint8).reshape(3, 8, n)
    columns = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64).reshape(3, n)
    return np.cumsum(columns[0], dtype=np.uint64).view(np.int64), columns[1].view(np.int64), columns[2].view(np.int64)


def _events(batches: Iterator[pa.RecordBatch], shared, buckets: int) -> Iterator[pa.RecordBatch]:
    """Occurrences that are not dense: (key, x, d). The key is the rare word (both indexes if none is); x holds the other side (an index, or 60 bits
    of a rare context's hash), the kind and the fold. Those of PACK_EVENTS or more are sorted and packed to a row for each bucket of keys."""
    f: Frequent = shared.value
    held: list[tuple] = []
    size = 0

    def packed() -> pa.RecordBatch:
        key, x, d = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        bucket = (T.mix(key.view(np.uint64)) & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        order = np.lexsort((key.view(np.uint64), bucket))
        bucket, key, x, d = bucket[order], key[order], x[order], d[order]
        del order
        cuts = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(key))
        rows = [_packed(key[a:b], x[a:b], d[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int64)), pa.array(rows, pa.binary())], names=["bucket", "payload"])

    for batch in batches:
        fold, row_key = batch.column("fold").to_numpy().astype(np.int64), batch.column("d").to_numpy()
        for first, last in T.slices(batch.column("text")):
            token, context, row = _tokens(batch.column("text").slice(first, last - first))
            w, v, dense = f.place(token, context)
            here = np.flatnonzero(dense < 0)
            w, v, row, token, context = w[here], v[here], row[here] + first, token[here].view(np.int64), context[here].view(np.int64)
            kind = np.where(w >= 0, np.where(v >= 0, _FREQUENT, _CONTEXT), np.where(v >= 0, _WORD, _BOTH))
            key = np.choose(kind, ((v << 32) | w, token, token, context))
            other = np.choose(kind, (np.zeros_like(v), v << 4, context & ~15, w << 4))
            held.append((key, other | (kind << 2) | fold[row], row_key[row]))
            size += len(key)
            if size >= PACK_EVENTS:
                yield packed()
                size = 0
    if size:
        yield packed()


def _group(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows of a sorted 2-d array (columns compared)."""
    return np.flatnonzero(np.concatenate(([True], (values[:, 1:] != values[:, :-1]).any(axis=0))))


_NAMES = ["cell", "c", "d", "gone", "n", "v", "fit", "deleted", "c_fit"]
_EVENT_FIELDS = "cell int, c int, d array<bigint>, gone bigint, n bigint, v bigint, fit bigint, deleted bigint, c_fit bigint"
_EVENT_TYPES = [pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * 6]


def _event_rows(n: int, /, **columns: pa.Array) -> pa.RecordBatch:
    """n rows of the events table; columns that are not named are null."""
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in zip(_NAMES, _EVENT_TYPES, strict=True)], names=_NAMES)


def _cell_rows(cell: np.ndarray, count: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each cell and count with the d of its events, in batches of about EVENTS events; a long list goes on in a further row."""
    both = (cell.astype(np.int64) << 32) | (count.astype(np.int64) & 0xFFFFFFFF)
    by = np.lexsort((d, both))
    both, d, cell, count = both[by], d[by], cell[by], count[by]
    starts = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    starts = np.unique(np.concatenate((starts, np.arange(0, len(d), EVENTS))))
    cuts = np.append(starts, len(d))
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + EVENTS, "right")) - 1)
        k = starts[at:end]
        yield _event_rows(len(k), cell=pa.array(cell[k]), c=pa.array(count[k]), d=pa.ListArray.from_arrays(pa.array(cuts[at : end + 1] - cuts[at], pa.int32()), pa.array(d[cuts[at] : cuts[end]])))
        at = end


def _gone_rows(cell: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """The deleted fold's events by their coarser cell."""
    gone, place = np.unique(cell, return_inverse=True)
    return _event_rows(len(gone), gone=pa.array(gone.astype(np.int64)), n=pa.array(np.bincount(place, weight, minlength=len(gone)).astype(np.int64)))


def _cells(pair: np.ndarray, context: np.ndarray, word: np.ndarray, tokens: int, steps: int) -> np.ndarray:
    return _cell(_bucket(context), _steps(pair, context, steps), _steps(word, np.full(len(word), tokens), steps))


def _estimates(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """For the rows of a task, which hold whole keys: a row for each cell and count (of a rare word, else -1) with the d of its events; the deleted fold's events by
    coarser cell; a row for each pair of rare words (v: the context), with its counts, those of its word and its events; a row for each rare word (v) with
    its counts; and the number of rare words of the training rows (n alone)."""
    model: Model = shared.value
    parts = [_unpacked(payload.as_py()) for b in batches for payload in b.column("payload")]
    if not parts:
        return
    all_keys, all_x, all_d = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    # Sorted in pieces of whole keys, so that the arrays of a piece stay small.
    pieces = -(-len(all_keys) // SORTED_ROWS)
    piece = (T.mix(all_keys.view(np.uint64)) >> np.uint64(40)) % np.uint64(max(pieces, 1))
    done, gone, new = [], [], 0
    tokens, tokens_fit = int(model.tokens.sum()), int(model.tokens[FIT])
    for p in range(pieces):
        here = np.flatnonzero(piece == p)
        if not len(here):
            continue
        key, x, d = all_keys[here], all_x[here], all_d[here]
        # A key of indexes is never grouped with a hash.
        order = np.lexsort((x, key, (x & 12) == 0))
        key, x, d = key[order], x[order], d[order]
        fold, kind, side = x & 3, (x >> 2) & 3, x >> 4
        plain = kind == _FREQUENT
        is_fit, is_del = (fold == FIT).astype(np.int64), (fold == DEL).astype(np.int64)
        as_word = (kind == _WORD) | (kind == _BOTH)
        inner, outer = _group(np.stack([key, x >> 2])), _group(np.stack([key, plain.astype(np.int64)]))

        def sums(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.repeat(np.add.reduceat(n, starts), np.diff(np.append(starts, len(n))))

        pair = [sums(inner, n) for n in (is_fit, is_del)]
        own = [sums(outer, n * as_word) for n in (is_fit, is_del)]
        w, v = np.where(plain, key & 0xFFFFFFFF, np.where(kind == _CONTEXT, side, 0)), np.where(plain, key >> 32, np.where(kind == _WORD, side, 0))
        one = [np.where(as_word, own[k], model.word[k][w]) for k in (FIT, DEL)]
        context = [np.where(kind == _CONTEXT, own[k], model.context[k][v]) for k in (FIT, DEL)]
        count = np.where(as_word, one[0] + one[1], -1).astype(np.int32)
        known = np.flatnonzero(kind != _BOTH)
        cell = _cells(pair[0][known] + pair[1][known], context[0][known] + context[1][known], one[0][known] + one[1][known], tokens, STEPS)
        done.append((cell.view(np.int32), count[known], d[known]))
        held = np.flatnonzero((kind != _BOTH) & (fold == DEL))
        gone.append(_cells(pair[0][held], context[0][held], one[0][held], tokens_fit, EM_STEPS))
        words = outer[(own[0][outer] + own[1][outer]) > 0]
        new += len(words)
        if len(words):
            yield _event_rows(len(words), v=pa.array(key[words] & ~15), fit=pa.array(own[0][words]), deleted=pa.array(own[1][words]))
        rare = np.flatnonzero(kind == _BOTH)
        if len(rare):
            starts = np.flatnonzero(np.isin(rare, inner, assume_unique=True))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rare)), pa.int32()), pa.array(d[rare]))
            k = rare[starts]
            yield _event_rows(len(k), c=pa.array(count[k]), d=lists, v=pa.array(x[k] & ~15), fit=pa.array(pair[0][k]), deleted=pa.array(pair[1][k]), c_fit=pa.array(one[0][k]))
    del all_keys, all_x, all_d, piece
    yield from _cell_rows(*(np.concatenate(x) for x in zip(*done, strict=True)))
    cells = np.concatenate(gone)
    yield _gone_rows(cells, np.ones(len(cells)))
    yield _event_rows(1, n=pa.array([new]))


def _rare_contexts(batches: Iterator[pa.RecordBatch], tokens: int, tokens_fit: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rare words meet the counts of their context: cells with the d of their events, and the deleted fold's events by coarser cell.
    A task holds all rows of its contexts."""
    words, pairs, lists = [], [], []
    for b in batches:
        is_word = b.column("c").is_null()
        part = b.filter(is_word)
        words.append(np.stack([part.column(c).to_numpy() for c in ("v", "fit", "deleted")]))
        part = b.filter(pa.compute.invert(is_word))
        pairs.append(np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("v", "fit", "deleted", "c", "c_fit")]))
        lists.append((pa.compute.list_value_length(part.column("d")).to_numpy(zero_copy_only=False).astype(np.int64), part.column("d").flatten().to_numpy()))
    if not pairs:
        return
    (word, fit, deleted), (v, pair_fit, pair_del, count, count_fit) = np.concatenate(words, axis=1), np.concatenate(pairs, axis=1)
    sizes, d = (np.concatenate(x) for x in zip(*lists, strict=True))
    del words, pairs, lists
    order = np.argsort(word)
    word, fit, deleted = word[order], fit[order], deleted[order]
    at = Frequent._at(word, v)
    context = [np.where(at >= 0, x[at], 0) if len(x) else np.zeros(len(v), np.int64) for x in (fit, deleted)]
    cell = _cells(pair_fit + pair_del, context[0] + context[1], count, tokens, STEPS).view(np.int32)
    yield from _cell_rows(np.repeat(cell, sizes), np.repeat(count, sizes).astype(np.int32), d)
    held = np.flatnonzero(pair_del)
    yield _gone_rows(_cells(pair_fit[held], context[0][held], count_fit[held], tokens_fit, EM_STEPS), pair_del[held])


def learn_weights(cell: np.ndarray, weight: np.ndarray, words: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bucket x [pair, word, uniform]) by expectation-maximisation on weighted events."""
    out = np.full((64, 3), 1 / 3)
    bucket, two, one = _uncell(cell, EM_STEPS)
    p = np.stack([two, one, np.full(len(cell), 1.0 / (words + 1))])
    for _ in range(rounds):
        share = out[bucket].T * p
        share *= weight / share.sum(axis=0)
        # One event is added to each component, so that none gets the weight 0.
        total = np.stack([np.bincount(bucket, share[k], minlength=64) for k in range(3)], axis=1) + 1.0
        out = total / total.sum(axis=1, keepdims=True)
    return out


def _documents(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """For every row: tokens, and of its dense events and frequent words the known tokens and the two scores."""
    f, dense_log, word_log, word_known = shared.value
    for batch in batches:
        for first, last in T.slices(batch.column("text")):
            part = batch.slice(first, last - first)
            token, context, row = _tokens(part.column("text"))
            w, _, dense = f.place(token, context)
            n = last - first
            hot, full = w >= 0, dense >= 0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("d"), pa.array(part.column("fold").to_numpy() == OUT), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row[hot], word_known[w[hot]], minlength=n).astype(np.int64)),
                 pa.array(np.bincount(row[hot], word_log[w[hot]], minlength=n).astype(np.float64)), pa.array(np.bincount(row[full], dense_log[dense[full]], minlength=n).astype(np.float64))],
                names=["doc_id", "d", "held_out", "n_tokens", "known", "base", "score"])


def _freed(df: DataFrame, name: str) -> DataFrame:
    """store(), with the shuffle files behind the table removed once it is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return store(df, name)
    finally:
        conf.set(key, before)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = _rows(docs)
    train = rows.where(F.col("fold") != OUT)
    found = store(train.select("text").mapInArrow(_frequent, "pair boolean, key bigint, n bigint").groupBy("pair", "key").agg(F.sum("n").alias("n")), "frequent")
    total = found.where("pair is null").agg(F.sum("n")).first()[0] or 0
    # At most 1 / share keys reach the share of the total.
    kept = found.where(F.col("pair").isNotNull() & (F.col("n") >= F.when(F.col("pair"), PAIR_SHARE * total).otherwise(WORD_SHARE * total))).select("pair", "key").toPandas()
    frequent = Frequent(kept.key[~kept.pair.astype(bool)].to_numpy(np.int64).view(np.uint64), kept.key[kept.pair.astype(bool)].to_numpy(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(frequent)

    model = Model(frequent)
    counts = train.select("text", "fold").mapInArrow(lambda b: _dense(b, shared), "kind int, place bigint, fit bigint, deleted bigint, context bigint, word bigint")
    counts = counts.groupBy("kind", "place").agg(F.sum("fit").alias("fit"), F.sum("deleted").alias("deleted"), F.max("context").alias("context"), F.max("word").alias("word")).toPandas()
    for kind, target in enumerate((model.word, model.context, model.event)):
        part = counts[counts.kind == kind]
        target[FIT, part.place], target[DEL, part.place] = part.fit, part.deleted
    part = counts[counts.kind == 3]
    model.tokens[:] = [part.fit.sum(), part.deleted.sum()]
    part = counts[counts.kind == 2]
    model.of_context[part.place], model.of_word[part.place] = part.context, part.word
    del counts, part, kept

    counted = spark.sparkContext.broadcast(model)
    tokens, tokens_fit = int(model.tokens.sum()), int(model.tokens[FIT])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total * FOLDS / (FOLDS - 1)) // TASK_EVENTS))
    events = rows.select("text", "fold", "d").mapInArrow(lambda b: _events(b, shared, 8 * parts), "bucket bigint, payload binary").repartition(parts, "bucket")
    first = _freed(events.mapInArrow(lambda b: _estimates(b, counted), _EVENT_FIELDS), "events")
    again = first.where("v is not null").repartition("v").mapInArrow(lambda b: _rare_contexts(b, tokens, tokens_fit), _EVENT_FIELDS)
    events = first.where("v is null").select("cell", "c", "d", "gone", "n").union(_freed(again.select("cell", "c", "d", "gone", "n"), "context_events"))

    def dense_cells(folds: list[int], steps: int) -> np.ndarray:
        pick = lambda x: x[folds].sum(axis=0)
        return _cells(pick(model.event), pick(model.context)[model.of_context], pick(model.word)[model.of_word], int(model.tokens[folds].sum()), steps)

    # Cells are bounded by the buckets and the roundings.
    gone = events.where("cell is null").groupBy("gone").agg(F.sum("n").alias("n")).toPandas()
    words = int(gone.n[gone.gone.isna()].sum()) + int((model.word.sum(axis=0) > 0).sum())
    gone = gone[gone.gone.notna()]
    used = model.event[DEL] > 0
    cell, weight = np.concatenate((gone.gone.to_numpy(np.int64).astype(np.uint32), dense_cells([FIT], EM_STEPS)[used])), np.concatenate((gone.n.to_numpy(np.float64), model.event[DEL][used].astype(float)))
    weights = learn_weights(cell, weight, words)

    def log_p(cell: np.ndarray) -> np.ndarray:
        bucket, two, one = _uncell(cell)
        l = weights[bucket]  # noqa: E741
        return np.log10(l[:, 0] * two + l[:, 1] * one + l[:, 2] / (words + 1))

    word = model.word.sum(axis=0)
    dense = spark.sparkContext.broadcast((frequent, log_p(dense_cells([FIT, DEL], STEPS)), np.log10((word + 1) / (tokens + words + 1)), (word > 0).astype(np.float64)))
    per_row = store(rows.select("doc_id", "text", "fold", "d").mapInArrow(lambda b: _documents(b, dense), "doc_id bigint, d bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double"), "scored_rows")

    # The other events: the same estimates as columns, spread to their rows and summed by row.
    weight = [F.array(*[F.lit(float(x)) for x in weights[:, k]]) for k in range(3)]
    bucket = F.shiftrightunsigned("cell", 26)
    two, one = F.shiftright("cell", 13).bitwiseAND(F.lit(8191)), F.col("cell").bitwiseAND(F.lit(8191))
    p = lambda x: F.when(x == _NEVER, 0.0).otherwise(F.pow(F.lit(10.0), -x / F.lit(float(STEPS))))
    log = F.log10(F.get(weight[0], bucket) * p(two) + F.get(weight[1], bucket) * p(one) + F.get(weight[2], bucket) / F.lit(words + 1.0))
    base = F.when(F.col("c") >= 0, F.log10((F.col("c") + 1) / F.lit(tokens + words + 1.0))).otherwise(0.0)
    rest = events.where("cell is not null").select((F.col("c") > 0).cast("bigint").alias("known"), base.alias("base"), log.alias("score"), F.explode("d").alias("d"))
    rest = rest.groupBy("d").agg(F.sum("known").alias("rare_known"), F.sum("base").alias("rare_base"), F.sum("score").alias("rare_score"))
    times = per_row.groupBy("d").agg(F.count("*").alias("rows"))
    joined = per_row.join(times, "d").join(rest, "d", "left")
    add = lambda own, other: F.col(own) + F.coalesce(F.col(other) / F.col("rows"), F.lit(0.0))
    return joined.select("doc_id", "held_out", "n_tokens", F.round(add("known", "rare_known")).cast("bigint").alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"), add("base", "rare_base").alias("base_score"), add("score", "rare_score").alias("score"))
