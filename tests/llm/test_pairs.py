"""MinHash near-duplicates and decontamination against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilake.llm import decontaminate, minhash_dedup, text
from equilake.llm.graph import components, merge

from .conftest import ROOT, shingles, words


def brute_components(rows):
    parent = {d: d for d, _ in rows if d is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    posting = defaultdict(list)
    for k, (d, s) in enumerate(sets):
        shared = Counter(j for x in s for j in posting[x])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = find(d), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for x in s:
            posting[x].append(k)
    return {d: find(d) for d in parent}


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = minhash_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((d or -1, len(shingles(t))) for d, t in rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_documents_equal_brute_force(documents):
    check(documents)


def test_odd_rows(odd, nothing):
    check(odd)
    assert minhash_dedup.near_duplicates(nothing).count() == 0


def test_chains_and_groups_under_the_threshold(spark, monkeypatch):
    """A hot group of copies whose links form chains, and one whose members share a passage only; small blocks, so that all paths run."""
    monkeypatch.setattr(minhash_dedup, "SMALL", 4)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(w)))
    passage = [f"p{i}" for i in range(60)]
    rows += [(100 + k, " ".join(passage + [f"q{k}_{i}" for i in range(rng.randint(10, 30))])) for k in range(60)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.unique(pool[:300]), np.unique(pool[100:])
    values, at = np.concatenate((a, b, pool[:1])), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1, len(a) + len(b) + 1])
    s = minhash_dedup.sketch(values, at, 1024)
    assert (s[:3] != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (s[3] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert (s[0] == s[1]).mean() == pytest.approx(0.5, abs=0.06)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (103, 100)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}}
    assert components(edges.where("a < 0")).count() == 0
    known = spark.createDataFrame([(1, 1), (2, 1), (5, 4), (4, 4)], "node bigint, component bigint")
    links = spark.createDataFrame([(2, 5), (9, 10)], "a bigint, b bigint")
    assert {r.node: r.component for r in merge(known, links).collect()} == {1: 1, 2: 1, 4: 1, 5: 1, 9: 9, 10: 9}


def test_word_hashes_cut_like_the_definition(documents):
    import pyarrow as pa

    texts = [r.text for r in documents.limit(50).collect()] + [None, "", "  a  ", "é A\x0bB c", "x" * 5000]
    raw, offsets = text.byte_view(pa.array(texts))
    hashes, at = text.words(raw, offsets)
    lists = [words(t) for t in texts]
    assert np.diff(at).tolist() == [len(x) for x in lists]
    seen = {}
    for h, w in zip(hashes.tolist(), (w for x in lists for w in x), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def brute_items(docs, items):
    out = set()
    for i, t in items:
        s = shingles(t)
        for d, u in docs:
            n = len(s & shingles(u))
            if n and 100 * n >= 75 * len(s):
                out.add((i, d, len(s), n))
    return out


def test_decontamination_equals_brute_force(spark, documents, odd, nothing):
    items = spark.read.parquet(f"{ROOT}/benchmark.parquet").select("item_id", "text")
    more = spark.createDataFrame([(900, "one two three four"), (901, "the quick brown fox jumps over the lazy dog while"), (902, None), (903, ""), (901, "the quick brown fox jumps over the lazy dog while"), (None, "w0 w7919 w5831 w3743 w1655")], "item_id bigint, text string")
    for docs, found in ((documents, items), (odd, more), (odd, items.limit(0)), (nothing, items)):
        plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = decontaminate.contained_items(docs, found)
        assert {tuple(r) for r in got.collect()} == brute_items(plain, [(r.item_id, r.text) for r in found.collect()])
    kept = decontaminate.decontaminated(odd, more)
    # The other text under the id 6 holds nothing, so it stays.
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {1, 2, 3, 4, 6, 10, 11} and kept.columns == odd.columns
    assert [r.text for r in kept.where("doc_id = 6").select("text").collect()] == ["another text under the same id it is"]


def test_least_hits_never_exclude_an_item():
    for n in range(1, 400):
        most = int(decontaminate._lack(np.int64((2 << int(np.log2(n))) - 1)))
        k = min(n, most + decontaminate.SLACK)
        assert 1 <= k - int(decontaminate._lack(np.int64(n))) <= k


def test_kept_count_follows_the_classes(documents):
    out = minhash_dedup.near_duplicates(documents)
    assert out.where("kept").count() == out.select(F.countDistinct("component_id")).first()[0]


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, "a clean text without an id"), (None, f"before {item} after"), (7, "a clean text of the same id"), (7, f"then {item}"), (8, f"{item} again"), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("row", "hits", "text_hash", "text_size", "item_id")}).repartition(3)
    got = decontaminate.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([rows[0], rows[2], rows[5], rows[6]], key=repr)
