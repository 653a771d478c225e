from __future__ import annotations

import random
import re

import pytest

from hazgrid.llm import jaccard
from hazgrid.llm.components import components


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, join=jaccard.Join()):
    sets = [shingles(t, join.words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= join.percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            name[find(i)] = min(name.get(find(i), d), d)
    return {d: (len(s), name[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def family(r, words, n, length, edits):
    base = [r.choice(words) for _ in range(length)]
    for _ in range(n):
        own = list(base)
        for _ in range(r.randrange(edits + 1)):
            k = r.randrange(len(own))
            own[k : k + r.choice([0, 1, 1])] = [r.choice(words)] * r.choice([0, 1, 1])
        yield " ".join(own)


def rows_of(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    out = [t for _ in range(12) for t in family(r, words, r.randrange(2, 9), r.randrange(3, 120), r.randrange(1, 9))]
    out += family(r, words, 150, 60, 6)  # more than are rare
    boiler = " ".join(r.choice(words) for _ in range(50))
    out += [boiler + " " + " ".join(r.choice(words) for _ in range(r.randrange(5, 25))) for _ in range(120)]
    out += ["", "  \n", None, "one two", "ONE  two", "one two three", "one two three four", "One Two Three Four", "a a a a a a a", "a a a a", "é É x y z", out[0].upper(), out[1] + "\n", out[2], out[2]]
    r.shuffle(out)
    return [(3 * i + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed, join", [(1, jaccard.Join()), (2, jaccard.Join(rare=3)), (3, jaccard.Join(rare=0, hashes=1)), (4, jaccard.Join(rare=8)), (5, jaccard.Join(words=4, percent=85)), (6, jaccard.Join(words=4, percent=85, rare=3))])
def test_equals_brute_force(spark, seed, join):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, component string").repartition(5)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(docs, join).collect()}
    want = brute(rows, join)
    assert got == want
    kept = jaccard.one_of_each(docs, join)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(d for d, (n, c) in want.items() if not n or c == d)


@pytest.mark.parametrize("seed", [5, 6])
def test_the_index_alone_finds_every_pair(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "hub_pairs", lambda sets: sets.where("false").selectExpr("tid a", "tid b"))
    rows = [(i, t) for i, t in dict((t, i) for i, t in rows_of(seed) if len(shingles(t)) > 5).items() for i, t in [(t, i)]]
    rows = [(i, t) for i, t in {frozenset(shingles(t)): (i, t) for i, t in rows}.values()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(docs, jaccard.Join(rare=4)).collect()}
    assert got == brute(rows)


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (None, "other words are here now")], "doc_id long, text string")
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0) for x in jaccard.near_duplicates(docs).collect()) == [(0, 0), (0, 5), (0, 5), (5, 5)]
    assert sorted((x["doc_id"] or 0, x["text"][0]) for x in jaccard.one_of_each(docs).collect()) == [(0, "o"), (5, "a")]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0 == jaccard.one_of_each(docs.limit(0)).count()


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (9, 9), (3, 1), (200, 5)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 1, 3: 1, 1: 1, 200: 5, 5: 5}
