"""Language of documents: text likelihoods fused with declared language, address suffix and host priors.

log posterior(l) = TEXT_WEIGHT * sum of log p(byte trigram | l) + log p(declared | l) + log p(l | host), normalised over the languages.

* Trigrams of the lower-cased letters, hashed to BINS bins, with add-one smoothing. Every declared language has a table, fitted on the distinct texts that
  declare it and whose hash falls under the language's own cut: about FIT_ROWS / languages are expected, FIT_ROWS / GROUP at least, and all if there are no more.
  FIT_ROWS is a parameter. Tables are broadcast for GROUP languages at a time; with more languages the scores are stored group by group.
* p(declared | l) and the host priors come from all rows, by grouped counts of the most likely language of each text.
* Host priors are smoothed down a hierarchy: overall, then address suffix (where there is a url), then host, each with the
  strength PRIOR_ROWS of its parent. The host is a column or is cut from the url; the suffix is the host's last label.

A document is rejected when it has no letter, when its best posterior is under MIN_POSTERIOR, or when its trigrams are
less likely than a uniform draw in every language (LETTERS or more of them). Ties go to the language that sorts first.

Defined cases: null and empty texts have no letters and are rejected with a null language. Null or unknown declared languages are one
value of their own; null hosts share one host. If no row declares a language, the result has null languages and
all rows are rejected. Repeated rows are kept; columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilake.llm import text as T

BINS = 1 << 16
FIT_ROWS = 20_000
GROUP = 64
TEXT_WEIGHT = 1 / 3
PRIOR_ROWS = 20.0
MIN_POSTERIOR = 0.5
LETTERS = 50
MOST_HOSTS = 200_000

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of the trigram that ends at each byte, whether it counts, row of each byte)."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    c = _FOLD[raw]
    h = c.copy()
    ok = np.zeros(len(raw), dtype=bool)
    if len(raw) > 2:
        h[2:] = c[2:] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[:-2] * np.uint32(0xC2B2AE3D)
        ok[2:] = (row[2:] == row[:-2]) & ((c[2:] != 32) | (c[1:-1] != 32))
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(16), ok, row


def _fit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = pd.factorize(np.array(batch.column("label").to_pylist(), dtype=object))
        for first, last in T.slices(batch.column("text")):
            bins, ok, row = _trigrams(*T.byte_view(batch.column("text").slice(first, last - first)))
            place, n = np.unique(labels[0][first:last][row[ok]] * BINS + bins[ok], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(labels[1][place // BINS], pa.string()), pa.array(place % BINS, pa.int64()), pa.array(n.astype(np.int64))], names=["label", "bin", "n"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each (label, hash) of a task; as many as the sample has at most."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        keep = []
        for k, pair in enumerate(zip(batch.column("label").to_pylist(), batch.column("hash").to_pylist(), strict=True)):
            if pair not in seen:
                seen.add(pair)
                keep.append(k)
        yield batch.take(pa.array(keep, pa.int64()))


class TextModel:
    """Languages and their log probabilities by bin. Bounded by GROUP x BINS."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, last row, log likelihoods rows x languages, trigrams and letters of each row) of slices of a batch's text."""
        column = batch.column("text")
        for first, last in T.slices(column):
            raw, offsets = T.byte_view(column.slice(first, last - first))
            bins, ok, every = _trigrams(raw, offsets)
            folded = _FOLD[raw]
            bins, row = bins[ok], every[ok]
            count = np.bincount(row, minlength=last - first)
            letters = np.bincount(every[folded != 32], minlength=last - first)
            yield first, last, self.likelihoods(batch.slice(first, last - first), bins, count), count, letters

    def likelihoods(self, part: pa.RecordBatch, bins: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = np.zeros((len(count), len(self.languages)))
        full = np.flatnonzero(count)
        if len(full):
            begin = (np.cumsum(count) - count)[full]
            for k in range(len(self.languages)):
                out[full, k] = np.add.reduceat(self.table[k][bins], begin, dtype=np.float64)
        return out


class StoredScores(TextModel):
    """All languages, whose log likelihoods are in the column __scores."""

    def __init__(self, languages: list[str]):
        super().__init__(languages, np.zeros((0, BINS), np.float32))

    def likelihoods(self, part: pa.RecordBatch, bins: np.ndarray, count: np.ndarray) -> np.ndarray:
        return part.column("__scores").flatten().to_numpy().reshape(len(count), len(self.languages))


def fit(docs: DataFrame, label: str, fit_rows: int = FIT_ROWS) -> tuple[list[str], Iterator[TextModel]]:
    """All languages that docs (text and a label column) declare, and their text models, GROUP languages in each."""
    from equilake.session import store

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label")).where("label is not null and text is not null").withColumn("hash", F.xxhash64("text"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("texts")).collect()
    languages = sorted(r["label"] for r in sizes)
    if not languages:
        return [], iter(())
    share = max(1, fit_rows // min(len(languages), GROUP))
    cuts = docs.sparkSession.createDataFrame([(r["label"], 1.0 if r["n"] <= share else min(1.0, share / max(r["texts"], 1))) for r in sizes], "label string, cut double")
    part = rows.join(F.broadcast(cuts), "label").where((F.col("cut") >= 1) | ((F.col("hash") / F.lit(2.0**63)) < 2 * F.col("cut") - 1)).select("text", "label", "hash")
    once = part.mapInArrow(_once, "text string, label string, hash bigint").dropDuplicates(["label", "hash"])
    found = store(once.select("text", "label").mapInArrow(_fit_counts, "label string, bin bigint, n bigint").groupBy("label", "bin").agg(F.sum("n").alias("n")), "language_bins")

    def models() -> Iterator[TextModel]:
        for first in range(0, len(languages), GROUP):
            names = languages[first : first + GROUP]
            known = {x: i for i, x in enumerate(names)}
            counts = np.ones((len(names), BINS))
            for r in found.where(F.col("label").between(names[0], names[-1])).toLocalIterator():
                counts[known[r["label"]], r["bin"]] += r["n"]
            counts /= counts.sum(axis=1, keepdims=True)
            yield TextModel(names, np.log(counts).astype(np.float32))

    return languages, models()


def _add_scores(batches: Iterator[pa.RecordBatch], model: TextModel) -> Iterator[pa.RecordBatch]:
    """The batches with the model's log likelihoods after those in __scores."""
    for batch in batches:
        n = len(batch)
        new = np.concatenate([score for _, _, score, _, _ in model.scores(batch)]) if n else np.zeros((0, len(model.languages)))
        had = batch.column("__scores").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
        both = np.concatenate((had, new), axis=1) if n else new
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * both.shape[1], pa.int32()), pa.array(both.ravel()))
        yield pa.RecordBatch.from_arrays([lists if c == "__scores" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)


def _best(batches: Iterator[pa.RecordBatch], model: TextModel) -> Iterator[pa.RecordBatch]:
    """The most likely language by text alone; rows without letters are left out of the counts."""
    for batch in batches:
        for first, last, score, count, _ in model.scores(batch):
            part = batch.slice(first, last - first)
            best = np.array(model.languages, dtype=object)[score.argmax(axis=1)]
            out = pa.RecordBatch.from_arrays([part.column("host"), part.column("suffix"), part.column("declared"), pa.array(best, pa.string())], names=["host", "suffix", "declared", "best"])
            yield out.filter(pa.array(count > 0))


def _fuse(batches: Iterator[pa.RecordBatch], model: TextModel, declared: dict, min_posterior: float) -> Iterator[pa.RecordBatch]:
    n = len(model.languages)
    names = np.array([*model.languages, None], dtype=object)
    unseen = np.zeros(n)
    floor = -np.log(BINS)
    for batch in batches:
        prior = np.array(batch.column("__prior").to_pylist(), dtype=np.float64).reshape(-1, n)
        said = batch.column("__declared").to_pylist()
        parts = []
        for first, last, score, count, letters in model.scores(batch):
            log = TEXT_WEIGHT * score + np.array([declared.get(d, unseen) for d in said[first:last]]) + np.log(prior[first:last])
            log -= log.max(axis=1, keepdims=True)
            p = np.exp(log)
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            top = p[np.arange(len(p)), best]
            strange = (count >= LETTERS) & (score.max(axis=1) < floor * count)
            lettered = letters > 0
            parts.append((np.where(lettered, best, n), np.where(lettered, top, 0.0), lettered & (top >= min_posterior) & ~strange))
        best, top, fine = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
        keep = [c for c in batch.schema.names if c not in ("__prior", "__declared", "__scores")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(top), pa.array(fine)], names=[*keep, "language", "posterior", "accepted"])


def identify(docs: DataFrame, declared: str | None = "lang", host: str | None = "source", url: str | None = None, fit_rows: int = FIT_ROWS, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """docs (text, and the named columns) with language, posterior and accepted; columns of these three names are replaced, all others are kept."""
    hidden = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c.lower() in _OWN}
    shown = lambda c: hidden.get(c, c)
    out = _identify(docs.drop("language", "posterior", "accepted").withColumnsRenamed(hidden), shown(declared), shown(host), shown(url), fit_rows, min_posterior)
    return out.withColumnsRenamed({v: k for k, v in hidden.items()})


def markup_language(html: str) -> Column:
    """The language that a page's markup declares: the lang attribute of its html element, without the region."""
    tag = F.regexp_extract(html, r"(?i)<html\b([^>]*)>", 1)
    return F.nullif(F.lower(F.regexp_extract(tag, r"(?i)\blang\s*=\s*[\"']?([a-z]+)", 1)), F.lit(""))


_OWN = {"__declared", "__host", "__suffix", "__prior", "__scores"}


def _identify(docs: DataFrame, declared: str | None, host: str | None, url: str | None, fit_rows: int, min_posterior: float) -> DataFrame:
    null = F.lit(None).cast("string")
    said = F.lower(F.col(declared).cast("string")) if declared else null
    address = F.lower(F.regexp_extract(F.col(url).cast("string"), r"^(?:[a-zA-Z]+://)?([^/?#:]*)", 1)) if url else null
    at = F.coalesce(F.col(host).cast("string") if host else address, F.lit(""))
    suffix = F.coalesce(F.element_at(F.split(address, r"\."), -1), F.lit("")) if url else F.lit("")
    marked = docs.select("*", said.alias("__declared"), at.alias("__host"), suffix.alias("__suffix"))
    languages, models = fit(marked, "__declared", fit_rows)
    n = len(languages)
    if not n:
        return docs.select("*", null.alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    from equilake.session import store

    scores = []
    if n <= GROUP:
        model = next(models)
    else:
        marked, scores = marked.withColumn("__scores", F.array().cast("array<double>")), [F.col("__scores")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields)
        for group in models:
            marked = store(marked.mapInArrow(lambda batches, group=group: _add_scores(batches, group), schema), "language_scores")
        model = StoredScores(languages)

    seen = marked.select(F.col("text").cast("string").alias("text"), F.col("__host").alias("host"), F.col("__suffix").alias("suffix"), F.col("__declared").alias("declared"), *scores).mapInArrow(
        lambda batches: _best(batches, model), "host string, suffix string, declared string, best string")

    counts = store(seen.groupBy("host", "suffix", "declared", "best").agg(F.count("*").alias("n")), "language_counts")
    # At most (languages + 1) x languages; every declared language is in the model.
    pairs = counts.groupBy("declared", "best").agg(F.sum("n").alias("n")).collect()
    table = {(r["declared"], r["best"]): r["n"] for r in pairs}
    values = [*model.languages, None]
    total = {b: sum(table.get((d, b), 0) for d in values) for b in model.languages}
    reliability = {d: np.log([(table.get((d, b), 0) + 1.0) / (total[b] + n + 1.0) for b in model.languages]) for d in values}
    overall = np.array([total[b] + 1.0 for b in model.languages])
    overall /= overall.sum()

    def shares(*group: str) -> DataFrame:
        """A map from language to its number of rows, by group."""
        return counts.groupBy(*group, "best").agg(F.sum("n").alias("n")).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("rows"), F.sum("n").alias("total"))

    def smoothed(parent):
        own = lambda b: F.coalesce(F.try_element_at("rows", b), F.lit(0))
        return F.zip_with(F.array(*[F.lit(b) for b in languages]), parent, lambda b, p: (own(b) + PRIOR_ROWS * p) / (F.col("total") + PRIOR_ROWS))

    suffixes = shares("suffix").select("suffix", smoothed(F.array(*[F.lit(float(x)) for x in overall])).alias("parent"))
    hosts = shares("host", "suffix").join(suffixes, "suffix").select(F.col("host").alias("__host"), F.col("suffix").alias("__suffix"), smoothed(F.col("parent")).alias("__prior"))
    hosts = store(hosts, "host_priors")
    if hosts.count() * n <= MOST_HOSTS * GROUP:
        hosts = F.broadcast(hosts)
    # Without a lettered text in its host and suffix a row is rejected anyway; the overall shares stand in.
    joined = marked.join(hosts, ["__host", "__suffix"], "left").withColumn("__prior", F.coalesce("__prior", F.array(*[F.lit(float(x)) for x in overall])))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__declared", "__prior", *scores).mapInArrow(
        lambda batches: _fuse(batches, model, reliability, min_posterior), ", ".join([*fields, "language string", "posterior double", "accepted boolean"]))
