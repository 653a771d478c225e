"""Every stage of the pipeline on its own input, against brute force; then the run as a whole."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from hazgrid.llm import bpe, mixing, pii, quality
from tests.llm.test_jaccard import brute as components_brute
from tests.llm.test_jaccard import family
from tests.llm.test_mixing import targets_brute
from tests.llm.test_quality import brute as quality_brute

tokenizers = pytest.importorskip("tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    words = [w for w in "the of and to in it was that he his with as for had but her not at on she is they which be him all have from were by one so said no me my this there we would their been who when an if more or out up do what now into time could them some then your can like only other see about than how may made over did down man such any our little very before must upon men good much come great where most day way old before house place still made life own hand back long say left eyes off never through himself well went new make know might came same because here two thing under these right night water light world turned voice course road letter behind country toward".split()]
    texts = [t for _ in range(25) for t in family(r, words, r.randrange(1, 5), r.randrange(60, 200), 3)]
    texts += ["short text", "", None, "again " * 300, texts[0], texts[0] + " mail me at a.b@c.de or +1 (555) 123-4567"]
    rows = [(i, t, r.choice(["en", None]), r.choice(["a", "a", "a", "b", "c", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_and_run(spark, folder):
    docs, library = spark.read.parquet(f"{folder}/documents.parquet"), tokenizers.Tokenizer.from_file(bpe.BYTE_BPE)
    stage = dict(P.STAGES)
    good = stage["quality"](spark, docs, folder)
    assert good.columns == COLUMNS
    kept = rows_of(good)
    judge = quality.Judge(quality.QualityRules())
    for i, r in rows_of(docs).items():
        n, chars, _, _, repeat = quality_brute(r["text"])
        tokens, fallen, bits = (x[0] for x in judge.fertility([r["text"] or ""]))
        least = np.interp(np.log2(max(1, tokens)), np.log2([k for k, _ in quality.LEAST_BITS]), [b for _, b in quality.LEAST_BITS])
        fine = n >= 50 and 100 * repeat <= 50 * n and judge.within(r["lang"], r["text"] or "", chars / max(1, tokens), chars / max(1, len(library.encode(r["text"] or "", add_special_tokens=False).ids)), fallen / max(1, tokens), bits - least, bits)
        assert (i in kept) == fine, i
    assert 30 < len(kept) < docs.count()

    good = P.C.written(good, "good")
    distinct = stage["near_duplicates"](spark, good, folder)
    assert distinct.columns == COLUMNS
    want = components_brute([(i, r["text"]) for i, r in kept.items()])
    assert sorted(rows_of(distinct)) == sorted(i for i, (_, c) in want.items() if c == i) and distinct.count() < len(kept)

    distinct = P.C.written(distinct, "distinct")
    before, after = rows_of(distinct), rows_of(stage["pii"](spark, distinct, folder))
    f = pii.Finder()
    assert {i: r["text"] for i, r in after.items()} == {i: pii.masked(r["text"], f.spans(r["text"])) for i, r in before.items()}
    assert all(r["n_chars"] == len(r["text"]) and not f.spans(r["text"]) for r in after.values())

    private = P.C.written(stage["pii"](spark, distinct, folder), "private")
    mixed = stage["mix"](spark, private, folder)
    assert mixed.columns == COLUMNS
    sizes, source, taken = Counter(), {i: r["source"] for i, r in after.items()}, Counter()
    for r in after.values():
        sizes[r["source"]] += len(r["text"].split())
    copies = Counter(r["doc_id"] for r in mixed.collect())
    for i, n in copies.items():
        assert n <= 3
        taken[source[i]] += n * len(after[i]["text"].split())
    want = targets_brute(sizes, mixing.Mix().weights, mixing.Mix().most)
    assert all(abs(taken[s] - want[s]) <= 250 for s in sizes)

    out = P.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in out) == copies
    for r in out:
        assert r["text"] == after[r["doc_id"]]["text"] and r["ids"] == library.encode(r["text"], add_special_tokens=False).ids


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
