"""The pipeline's first stage judges short documents by their figures, not by their length; op8's verdict keeps its contract."""

from __future__ import annotations

import pytest

import corpus_pipeline as P
from hazgrid.llm import quality

pytest.importorskip("sentencepiece")
LINE = "Bread, a lamp, some rope and the old map that her uncle had drawn."
CLEAN = {
    1: ("They came home late in the year.", "en"), 2: ("It was late in the year when the two of them set out along the river, and nobody thought that they would be back before the snow.", "en"),
    3: (f"{LINE}\nThey carried little.\n{LINE}", None), 4: ("Call me at +1 (555) 123-4567 or write to the office.", "en"), 5: ("私は昨日友達と一緒に公園へ行きました。とても楽しかったので、また来週も行きたいと思います。", "ja"),
    6: ("Sie kamen spät im Jahr nach Hause, und niemand im Dorf hatte das erwartet.", "de"),
}
JUNK = {
    11: ("", "en"), 12: (None, "en"), 13: (" \n\t", "en"), 14: ("The The The The river river river river of of of of snow snow snow snow", "en"), 15: ("river | lamp | rope | uncle | snow | bread | map | year", "en"),
    16: ("The%%% two*** of$$$ them&&& set### out", "en"), 17: ("river river lamp lamp uncle uncle bread bread rope rope snow snow", None), 18: ("go go go", "en"), 19: ("again " * 300, "en"), 20: ("short text", "en"),
    21: ("one of the two and " * 9, "en"), 22: ("aaaaaaaaaa" * 60, "en"),
}


def test_first_stage_keeps_short_prose(spark):
    docs = spark.createDataFrame([(i, *x) for i, x in (CLEAN | JUNK).items()], "doc_id long, text string, lang string").repartition(2)
    assert sorted(x["doc_id"] for x in dict(P.STAGES)["quality"](spark, docs, "").collect()) == sorted(CLEAN)
    x = {r["doc_id"]: r for r in quality.quality_metrics(docs).collect()}
    assert all(x[i]["base_failed"] and not x[i]["kept"] for i in CLEAN | JUNK)
    assert P.STAGES[0][1](spark, docs.limit(0), "").count() == 0


def test_long_texts_are_judged_as_before(spark):
    text = " ".join(w + str(i % 7) * (i % 3) for i, w in enumerate((LINE + " " + CLEAN[2][0]).split() * 6))
    rows = [(i, " ".join(text.split()[:n]), "en") for i, n in enumerate((50, 51, 90, 200))] + [(9, "river lamp " * 40, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {x["doc_id"] for x in quality.keep_good(docs, short=quality.Short()).collect()} == {x["doc_id"] for x in quality.keep_good(docs).collect()}


def test_full_caches_change_no_figure():
    """However much a worker has read, a text's figures are the same."""
    import pyarrow as pa

    parts = [pa.record_batch({"doc_id": [i], "text": [f"{CLEAN[2][0]} word{i}x{i * 7919} {LINE}"], "lang": ["en"]}) for i in range(200)]
    fresh, full = (quality.Judge(quality.QualityRules()) for _ in range(2))
    full.bytes_of.most_chunks = 20
    a, b = ([{k: v.tolist() for k, v in judge.judge(x, quality.Short()).items()} for x in parts] for judge in (fresh, full))
    assert a == b and len(full.bytes_of.codes) < len(fresh.bytes_of.codes)
