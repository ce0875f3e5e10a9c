"""Prefix trie, substring dedup and Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilake.llm import merkle, prefix_trie, substring_dedup

from .conftest import LONG, ROOT


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- trie ----------------------------------------------------------------------------------------

def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    built = {}
    for c, turns in own.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        head = [(r, t) for *_, r, t in sorted(own.get(base, []))]
        built[c] = turns if c == base else head[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def walk(p):
        below = [walk(q) for q in children[p]]
        gain = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        return sum(b[0] for b in below) or 1, gain + sum(b[1] for b in below)

    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *walk(p), sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items()), key=repr)


TURNS = "conv_id bigint, turn bigint, role string, text string"


def check_trie(spark, rows, **options):
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("node", "shard", "family", "digest", "depth")}).repartition(3)
    got = rows_of(prefix_trie.trie(df, **options))
    assert got == brute_trie(rows)
    return got


@pytest.mark.parametrize("shard_rows", [7, 200_000])
def test_trie_equals_brute_force(spark, shard_rows):
    """A hot conversation, a hot first turn, null turns and texts, ties, repeated rows, negative ids, conversations left without a turn."""
    rng = random.Random(3)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"hello {min(t, 2)}") for c in range(300, 420) for t in range(4)]
    rows += [(c, t, rng.choice(["user", "tool"]), rng.choice(["a", "b", "", "é€"])) for c in range(-150, 160, 3) for t in range(rng.randrange(1, 7))]
    rows += [(700, None, None, None), (700, 0, "user", "x"), (700, 0, "user", "a"), (701, 1, "user", "x"), (701, 1, "user", "x"), (None, 0, "user", "lost"), (905, 0, "u", "only"), (905, 0, "u", "only")]
    rows += [(1000, t, "user", f"turn {t}") for t in range(120)]
    got = check_trie(spark, rows, shard_rows=shard_rows)
    assert got and sum(1 for r in got if r[1] == 0) == 1


def test_trie_without_rows_and_of_one_turn(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    check_trie(spark, [(5, 0, "user", "long text " * 50_000)])
    # A conversation that loses its only turn to an absent head.
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    assert check_trie(spark, [(c, 0, "user", "x")])[0][:4] == (c, 0, None, 1)


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**64, (20_000, 4), dtype=np.uint64)
    keys[:500, :3] = keys[0, :3]  # digests that agree in three words
    table = prefix_trie.SlotTable(keys)
    assert sorted(table.slots(keys)) == list(range(len(keys))) and (table.digests[table.slots(keys)] == keys).all()
    other = rng.integers(0, 2**64, (1000, 4), dtype=np.uint64)
    other[:500, :3], other[:500, 3] = keys[0, :3], 1
    assert (table.slots(other) == -1).all()
    assert prefix_trie.SlotTable(keys[:0]).slots(keys[:2]).tolist() == [-1, -1]


def test_sums_go_up_deepest_first():
    parent, depth = np.array([-1, 0, 1, 1, 0]), np.array([0, 1, 2, 2, 1])
    (total,) = prefix_trie.accumulate(parent, depth, np.array([1, 10, 100, 1000, 5]))
    assert total.tolist() == [1116, 1110, 100, 1000, 5]


# -- substring dedup -------------------------------------------------------------------------------

def brute_removed(rows):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - 12) if d is not None else ():
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 12) if d is not None else ():
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=repr)


def check_removed(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(substring_dedup.remove_repeats(docs)) == brute_removed(rows)


def test_removed_words_equal_brute_force(spark, odd, nothing):
    check_removed(spark.read.parquet(f"{ROOT}/documents.parquet"))
    check_removed(odd)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_shared_passages_branches_and_copies(spark):
    """Passages that branch, overlap and turn up inside repeated lines; windows of 12, 13 and 14 words; texts that share an id; hot copies in many slices."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    passage = [" ".join(rng.choice(words) for _ in range(n)) for n in (12, 13, 14, 60, 200)]
    rows = [(i, " ".join(rng.choice([*passage, rng.choice(words), "été", "x\ty"]) for _ in range(rng.randrange(1, 8)))) for i in range(150)]
    rows += [(1000 + i % 7, passage[3] + " tail") for i in range(60)] + [(5, passage[4]), (5, "another text of the same id " + passage[3]), (None, passage[4]), (2000, "so so " * 40), (2001, "so so " * 45), (2002, LONG[:200_000]), (2003, "a " + LONG[:200_000])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("variant", F.lit("clash")).repartition(9)
    check_removed(df)


def test_window_hashes_depend_on_the_window_only():
    word = np.random.default_rng(1).integers(0, 2**64, 60, dtype=np.uint64)
    edge, anchor = substring_dedup.windows(word)
    again, anchor_again = substring_dedup.windows(word[17:40])
    assert (edge[17:28] == again).all() and (anchor[17:28] == anchor_again).all() and len(again) == 11
    assert [len(x) for x in substring_dedup.windows(word[:12])] == [0, 0]


# -- manifest ----------------------------------------------------------------------------------------

def brute_manifest(rows):
    def leaf(r, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)))

    def climb(nodes):
        tree = [nodes]
        while len(tree[-1]) > 1:
            tree.append([sha("".join(tree[-1][i : i + 2])) for i in range(0, len(tree[-1]), 2)])
        return tree

    def steps(tree, i):
        for level in tree[:-1]:
            j = i ^ 1
            yield (level[j] if j < len(level) else None, i & 1)
            i >>= 1

    groups = defaultdict(list)
    for r in rows:
        groups[(r.lang is not None, (r.lang or "").encode())].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.n_chars), r))
    keys = sorted(groups)
    trees = {k: climb([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in keys}
    top = climb([trees[k][-1][0] for k in keys])
    out = []
    for g, k in enumerate(keys):
        for i, (_, _, own, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            path = [*steps(trees[k], i), *steps(top, g)]
            shown = leaf(r, r.n_chars + 1) if r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 else own
            for sibling, odd in path:
                shown = sha(shown if sibling is None else sibling + shown if odd else shown + sibling)
            out.append((r.doc_id, own, trees[k][-1][0], top[-1][0], sha("".join(s for s, _ in path if s)), shown, shown == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [1, 14])
def test_manifest_equals_brute_force(odd, documents, nothing, bits):
    """Small blocks give many tiers; a single language over many blocks; null languages and ids; repeated rows."""
    hot = documents.limit(70).withColumn("lang", F.lit("one"))
    for docs in (hot.unionByName(odd.select(hot.columns)), hot.limit(1)) if bits == 1 else (odd,):
        docs = docs.cache()
        rows = docs.collect()
        got = rows_of(merkle.manifest(docs, bits))
        assert got == brute_manifest(rows)
        shown = [r for r in rows if r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0]
        assert sum(not r[6] for r in got) == len(shown)
    assert merkle.manifest(nothing, bits).count() == 0


def test_proof_bytes_round_trip():
    proof = (True, sha("a").encode(), (False, None, (False, sha("b").encode(), None)))
    assert merkle.unpack(merkle.pack(proof)) == proof and merkle.unpack(b"") is None and merkle.unpack(None) is None
