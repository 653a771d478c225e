"""One document of each component where ids are null or repeated."""

from __future__ import annotations

from hazgrid.llm import jaccard


def test_null_and_repeated_ids_leave_one_of_each_component(spark):
    near = [" ".join(f"{name}{i}" for i in range(60)) + tail for name in "abc" for tail in ("", " x", " y")]
    ids = [5, 5, 9, None, None, None, 5, 7, None]
    docs = spark.createDataFrame([*zip(ids, near, strict=True), (5, near[0]), (None, ""), (5, "")], "doc_id long, text string")
    kept = [(x["doc_id"], x["text"]) for x in jaccard.one_of_each(docs).collect()]
    words = [(d, t.split()[0][0]) for d, t in kept if t]
    assert sorted(words, key=str) == sorted([(5, "a"), (None, "b"), (5, "c")], key=str) and len(kept) == 5
