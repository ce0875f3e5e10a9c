"""How op12 deals its rows out."""

from equilake.llm.substring_dedup import _bitmap, _named, remove_repeats, repeated_paths


def test_answered_paths_of_a_document_stay_together(spark):
    line = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{line} own{i}", 0) for i in range(20)], "doc_id bigint, text string, variant bigint")
    found = repeated_paths(docs)
    assert {r.doc for r in found.collect()} == set(range(1, 20))
    # Rows that are only passed on go by document: dealt out singly they compress badly.
    assert "xxhash64" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_without_repeats_are_not_shuffled(spark):
    line = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{line if i < 3 else ''} " + " ".join(f"own{i}x{j}" for j in range(30))) for i in range(200)], "doc_id bigint, text string")
    out = remove_repeats(docs)
    lists = docs.where("doc_id in (1, 2)").select("doc_id")
    assert sorted(r.doc_id for r in _named(docs.selectExpr("doc_id", "text", "0L as variant"), _bitmap(lists)).collect()) == [1, 2]
    assert {r.doc_id: r.n_removed for r in out.collect()} == {i: 40 if i in (1, 2) else 0 for i in range(200)}
    # What is not named is finished in the scan, in a branch of its own.
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()
