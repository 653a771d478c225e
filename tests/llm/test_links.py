"""Links of the Jaccard join."""

from __future__ import annotations

from collections import Counter

import pytest

from hazgrid.llm import jaccard
from tests.llm.test_jaccard import rows_of, shingles


def links_brute(rows, join):
    classes = {}
    for d, t in rows:
        if s := frozenset(shingles(t, join.words)):
            classes.setdefault(s, []).append(d)
    at = list(classes.items())
    out = Counter({(min(ids), min(ids)): len(ids) * (len(ids) - 1) // 2 for _, ids in at if len(ids) > 1})
    for i, (s, a) in enumerate(at):
        for t, b in at[:i]:
            if 100 * len(s & t) >= join.percent * len(s | t):
                out[tuple(sorted((min(a), min(b))))] += len(a) * len(b)
    return out


@pytest.mark.parametrize("join", [jaccard.Join(), jaccard.Join(words=4, percent=85, rare=4)])
def test_links_equal_brute_force(spark, join):
    rows = rows_of(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.linked(docs, join).collect()
    want = links_brute(rows, join)
    assert sum(x["n_links"] for x in got) == sum(want.values()) and len(got) == len(want) > 20
    assert {tuple(sorted((x["a"], x["b"]))): x["n_links"] for x in got} == want
    assert jaccard.linked(docs.limit(0), join).count() == 0
