"""Pieces, token files and the pipeline: brute force and exact round trips."""

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from equilake.llm import nbest_pieces, token_shards
from equilake.llm.queries import vocabulary

from .conftest import ROOT, words


@pytest.fixture(scope="module")
def segmenter():
    return nbest_pieces.Segmenter(vocabulary("piece_bpe_32k.model"))


def every(pieces, unit):
    """All segmentations of a short text, best first."""
    edges, out = pieces.edges_of(unit), []

    def go(place, score, ids):
        if place == 0:
            out.append((score, ids))
        for start, i, w in edges[place] if place else ():
            go(start, score + w, pieces.pieces(unit, start, place, i) + ids)

    go(len(unit), 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", [" the", " thbleat", "  é ç", "\t\nab", " 𝕏x", " aaaaaaa", "a;\r\nb", "  x"])
def test_n_best_of_a_unit_equals_all_paths(segmenter, text):
    unit = text.encode()
    want, got = every(segmenter.pieces, unit), nbest_pieces.a_star(segmenter.pieces, unit, 6)
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:6]]) and len({tuple(p) for _, p in got}) == len(got)
    for ids, score, loss in nbest_pieces._many([unit, b"x", unit], segmenter.pieces):
        if ids != got[0][1]:
            continue
        assert score == pytest.approx(got[0][0]) and (len(want) < 2 or loss == pytest.approx(want[0][0] - want[1][0]))


def test_n_best_of_a_text_equals_all_paths(segmenter):
    for text in ("the cat", "é bo", "aab ba c "):
        want = every(segmenter.pieces, b" " + text.encode())[:5]
        ((ids, scores, changes, exact),) = segmenter.encode(pa.array([text]), 5)
        assert scores == pytest.approx([s for s, _ in want]) and exact and len(changes) == len(scores) and not changes[0]
        assert segmenter.pieces.decode(ids).decode() == text


def test_segment_rows(spark, odd, nothing):
    out = nbest_pieces.segment(odd, vocabulary("piece_bpe_32k.model")).collect()
    assert len(out) == odd.count() and all(r.exact and len(r.pieces) == r.n_pieces and list(r.scores) == sorted(r.scores, reverse=True) for r in out)
    assert all(r.n_pieces == 0 and r.scores == [0.0] for r in out if not r.text)
    long_ = spark.createDataFrame([(1, "a1b2" * 2000)], "doc_id bigint, text string")
    assert nbest_pieces.segment(long_, vocabulary("piece_bpe_32k.model")).first().exact
    assert nbest_pieces.segment(nothing, vocabulary("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 31, 32, 33, 5000, 70_001])
def test_segments_decode_exactly(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_257).astype(np.int32)
    data = token_shards.encode_segment(ids)
    assert (token_shards.decode_segment(data) == ids).all()
    if n > 40_000:
        b = token_shards.BLOCK
        assert (token_shards.decode_segment(data, [1]) == ids[b : 2 * b]).all()
        broken = bytearray(data)
        broken[-5] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            token_shards.decode_segment(bytes(broken))


def test_token_files_round_trip(spark, documents, odd, nothing, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    mark = "<|endoftext|>"
    assert tokenizer.encode(f"hello {mark} world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    marked = [mark, f"{mark} start", f"{mark}start", f"end {mark}", f"end{mark}", f"in the {mark} middle", f"in{mark}{mark}side", f"two  {mark}  blanks", f"\n{mark}\n\t{mark} ", f"{mark} " * 50]
    hard = [*marked, "a  b", "a  b　 c", "tabs\t\tand\n\n lines \r\n", "<|endoftext|> x", " lead", "trail  ", "it's é'll 12 34", "\x1c a\x1f b", "𝕏 𝕐"]
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id is null or doc_id < 6 or doc_id > 6")).union(spark.createDataFrame([(2000 + i, t) for i, t in enumerate(hard)], "doc_id bigint, text string"))
    rows = {}
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        rows.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    token_shards.write_shards(docs, str(tmp_path / "files"), path, segment=20_000)
    got = sorted(token_shards.read_shards(spark, str(tmp_path / "files")).collect(), key=lambda r: r.start)
    assert len(got) == docs.count() and got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in pairwise(got))
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    for r in got:
        assert (r.n_tokens, r.ids_crc32) in rows[r.doc_id]
    assert token_shards.round_trip(nothing, path).count() == 0


def test_pipeline_stages(spark, documents):
    """Each stage against its own input, by plain definitions."""
    import corpus_pipeline
    from equilake.llm.surrogates import find

    from .test_pairs import brute_components, brute_items

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "decontamination", "pii", "sentencepiece"]
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.store(stage(spark, docs, ROOT), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert len(after) >= len(before) - 1
        elif name == "minhash_dedup":
            assert set(after) == set(brute_components(list(before.items())).values())
        elif name == "decontamination":
            assert set(after) == set(before) - {d for _, d, *_ in brute_items(list(before.items()), items)}
        elif name == "pii":
            assert set(after) == set(before)
            for d, t in after.items():
                assert (t == before[d]) == (not find(before[d])) and not {c for *_, c in find(t)} & {c for *_, c in find(before[d])}
        else:
            assert set(after) == set(before) and docs.where("not exact").count() == 0
        if name != "sentencepiece":
            assert docs.columns == documents.columns
    assert all(words(t) for t in after.values())


def test_pipeline_keeps_texts_that_share_an_id(spark, documents, nothing):
    """Dedup of rows with null, shared and repeated ids; a run over an empty table and with columns whose names operators use."""
    import corpus_pipeline

    one, two = documents.where("length(text) > 400").select("text").limit(2).collect()
    rows = [(5, one.text, "en", "a", 1), (5, two.text, "en", "a", 2), (5, two.text, "en", "a", 2), (9, one.text, "en", "b", 3), (None, one.text, "en", "b", 3), (None, one.text, "en", "b", 3)]
    docs = spark.createDataFrame(rows, documents.schema).withColumns({c: F.lit("clash") for c in ("place", "kept", "component_id", "hash")})
    got = corpus_pipeline.near_dedup(spark, docs, ROOT)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(5, one.text), (5, two.text), (None, one.text), (None, one.text)], key=repr)
    left = nothing
    for name, stage in corpus_pipeline.STAGES:
        left = corpus_pipeline.store(stage(spark, left, ROOT), name)
    assert left.count() == 0


@pytest.mark.parametrize("make", [lambda r: "".join(r.choice("天地玄黄宇宙洪荒日月盈昃") for _ in range(3000)), lambda r: "".join(r.choice("abcab") for _ in range(400)), lambda r: "𝕏é" * 90, lambda r: "a" * 150])
def test_units_without_blanks_fall_apart_exactly(make):
    """Cut at the places that no edge crosses, a long unit has the same best score as when it is searched whole."""
    import random

    pieces = nbest_pieces.Pieces(vocabulary("piece_bpe_32k.model"))
    unit = b" " + make(random.Random(4)).encode()
    edges = pieces.edges_of(unit)
    crossed = {p for end, e in enumerate(edges) for start, *_ in e for p in range(start + 1, end)}
    cuts = pieces.cuts(np.frombuffer(unit, np.uint8)).tolist()
    assert cuts == [p for p in range(1, len(unit)) if p not in crossed]
    parts = [unit[a:b] for a, b in pairwise([0, *cuts, len(unit)])]
    assert sum(nbest_pieces.forward(pieces.edges_of(p))[-1] for p in parts) == pytest.approx(nbest_pieces.forward(edges)[-1])


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(nbest_pieces, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(nbest_pieces, "LIST_BYTES", 5_000)
    monkeypatch.setattr(nbest_pieces, "LATTICE_BYTES", 200)
    small, large = nbest_pieces.Segmenter(vocabulary("piece_bpe_32k.model")), None
    texts = pa.array([" ".join(f"word{i * k % 997}x" for i in range(300)) for k in range(1, 9)])
    got = [list(small.encode(texts.slice(i, 1), 3)) for i in range(len(texts))]
    assert small.list_bytes <= 5_000 and small.cache.size < 200_000
    monkeypatch.undo()
    large = nbest_pieces.Segmenter(vocabulary("piece_bpe_32k.model"))
    for (ids, scores, changes, exact), (ids2, scores2, changes2, exact2) in zip([g[0] for g in got], large.encode(texts, 3), strict=True):
        assert (ids == ids2).all() and scores == pytest.approx(scores2) and changes == changes2 and exact and exact2
