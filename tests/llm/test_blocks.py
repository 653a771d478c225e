"""Very long texts, blocks by bytes, and parts in slices."""

from __future__ import annotations

import random
from collections import Counter

from hazgrid.llm import corpus, jaccard, substrings, suffixes

TIGHT = corpus.Sizes(block=1 << 20, task=1 << 20, part=1 << 14, slice=1 << 10)


def long_texts(n_bytes: int, n: int = 6):
    """Texts of words without repeats, every other one with a passage of 5,000 words between words of its own."""
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(5000))
    out = []
    for k in range(n):
        words = n_bytes // 7
        own = [f"{chr(97 + k)}{i:x}{chr(97 + k)}" for i in range(words)]
        own[r.randrange(words)] += "" if k % 2 else f" {chr(97 + k)} {passage} {chr(97 + k)} "
        out.append(" ".join(own))
    return out, passage


def test_texts_of_a_megabyte(spark):
    sizes = TIGHT
    texts, passage = long_texts(1 << 20)
    rows = [(i, t) for i, t in enumerate([*texts, *(f"short text number {i}" for i in range(400)), texts[1]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert len(texts[0]) > 1_000_000
    strings = {x["doc_id"]: x for x in suffixes.remove_repeats(docs, sizes=sizes, with_bytes=False).collect()}
    words = {x["doc_id"]: x for x in substrings.remove_repeats(docs, sizes=sizes, with_text=False).collect()}
    assert len(strings) == len(words) == len(rows)
    for i in range(len(rows)):
        whole = i in (1, 406)
        assert words[i]["n_removed"] == (words[i]["n_words"] if whole else 5000 if i < 6 and i % 2 == 0 else 0)
        # Spaces on either side of the passage repeat too.
        assert strings[i]["n_removed"] == (strings[i]["n_bytes"] if whole else len(passage) + 2 if i < 6 and i % 2 == 0 else 0)
        assert (strings[i]["n_shared"] > 0) == (strings[i]["n_removed"] > 0)
    got = {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(docs, sizes=sizes).collect()}
    assert all(got[i] == (1 if i == 406 else i) for i in range(6)) and got[406] == 1


def test_sizes_do_not_change_results(spark):
    from tests.llm.test_jaccard import brute, rows_of

    rows = rows_of(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(docs, sizes=corpus.Sizes(block=1 << 12, task=1 << 12, part=1 << 10, slice=1 << 8)).collect()}
    assert got == brute(rows)


def test_blocks_and_parts_follow_bytes(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "x" * (200_000 if i % 50 == 0 else 100)) for i in range(600)], "doc_id long, text string").repartition(1)
    held = corpus.corpus_of(docs, sizes=corpus.Sizes(block=1 << 20))
    size = Counter()
    for x in held.texts.collect():
        size[x["block"]] += x["n_bytes"]
    assert held.n_blocks == len(size) == 3 and max(size.values()) < (1 << 20) + 200_100
    assert held.parts(1.0) == 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) and held.slices(1.0) == 1


def test_short_repeats_are_reported(spark):
    r = random.Random(4)
    one = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = one(288)
    texts = [one(900) + passage + one(r.randrange(900)) for _ in range(30)] + [one(1500) for _ in range(30)] + [one(700) + passage[:150] + one(700) for _ in range(10)] + [passage, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_removed"], x["n_shared"]) for x in suffixes.remove_repeats(docs).collect()}
    assert all(got[i][0] == 0 and (got[i][1] > 0) == (i < 30 or i == 70) for i in range(len(texts)))
