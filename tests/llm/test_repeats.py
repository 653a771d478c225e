from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from hazgrid.llm import blocks, corpus, substrings, suffixes


def some_texts(seed: int, n: int = 60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(300)]
    passages = [" ".join(r.choice(words) for _ in range(r.choice([30, 36, 60, 110]))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 90))) for _ in range(r.randrange(1, 4))]
        for _ in range(r.randrange(0, 3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        out.append(r.choice([" ", "\n", "\t \r"]).join(parts))
    near = out[0].split()
    for k in (5, len(near) // 2):
        near[k] = "changed"
        out.append(" ".join(near))
    twice = " ".join(r.choice(words) for _ in range(50))
    return [*out, out[3], out[3], out[4] + " ", twice + " x " + twice, "the " * 200, "a b " * 90, "x" * 900, "ab" * 500, "", " \n ", None, "one", "z" * 399, "z" * 400, "é" * 300]


@pytest.fixture(scope="module", params=[1, 2])
def documents(spark, request):
    rows = [(i if i != 7 else None, t, "clash") for i, t in enumerate(some_texts(request.param))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(4)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def windows_brute(texts, size):
    at = defaultdict(list)
    split = [[] if t is None else blocks_split(t) for t in texts]
    for d, w in enumerate(split):
        for i in range(len(w) - size + 1):
            at[tuple(w[i : i + size])].append((d, i))
    gone = [np.zeros(len(w), bool) for w in split]
    for places in at.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + size] = True
    return split, gone


def blocks_split(t: str) -> list[str]:
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t)


@pytest.mark.parametrize("size, gram", [(35, 18), (5, 3)])
def test_substrings_equal_brute_force(documents, size, gram):
    rows, docs = documents
    split, gone = windows_brute([t for _, t, _ in rows], size)
    want = Counter((i, len(w), int(g.sum()), sha(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode())) for (i, _, _), w, g in zip(rows, split, gone, strict=True))
    got = substrings.remove_repeats(docs, substrings.Windows(size=size, gram=gram, max_cells=1 << 16)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert all(sha(r["kept"].encode()) == r["kept_sha256"] for r in got) and sum(r["n_removed"] > 0 for r in got) > 20


@pytest.mark.parametrize("cells", [1 << 5 + 6])
def test_a_crowded_sketch_loses_nothing(documents, cells):
    rows, docs = documents
    tight = substrings.remove_repeats(docs, substrings.Windows(max_cells=cells, slices=8)).collect()
    assert sorted((r["doc_id"] or 0, r["kept_sha256"]) for r in tight) == sorted((r["doc_id"] or 0, r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect())


def bytes_brute(texts, size):
    at = defaultdict(list)
    raw = [(t or "").encode() for t in texts]
    for d, b in enumerate(raw):
        for i in range(len(b) - size + 1):
            at[b[i : i + size]].append((d, i))
    gone = [np.zeros(len(b), bool) for b in raw]
    for places in at.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + size] = True
    return raw, gone


@pytest.mark.parametrize("s", [suffixes.Strings(), suffixes.Strings(size=40, gram=12, short=20, batch=64), suffixes.Strings(size=40, gram=12, short=20, batch=64, hot=4), suffixes.Strings(hot=2)])
def test_suffixes_equal_brute_force(documents, s):
    rows, docs = documents
    raw, gone = bytes_brute([t for _, t, _ in rows], s.size)
    want = Counter()
    for (i, _, _), b, g in zip(rows, raw, gone, strict=True):
        spans = int((np.diff(np.concatenate([[0], g.astype(np.int8)])) == 1).sum())
        want[i, len(b), int(g.sum()), spans, sha(np.frombuffer(b, np.uint8)[~g].tobytes())] += 1
    got = suffixes.remove_repeats(docs, s).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert all(sha(bytes(r["kept"])) == r["kept_sha256"] for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(none).count() == 0 and suffixes.remove_repeats(none).count() == 0


def test_levels_mark_all_that_repeat():
    r = np.random.default_rng(5)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    index = suffixes.SuffixLevels(data, 11)
    places = r.permutation(len(data) - 10)
    for k in range(0, len(places), 100):
        index.add(places[k : k + 100])
    count = Counter(data[i : i + 11].tobytes() for i in places.tolist())
    assert [bool(index.again[i]) for i in range(len(places))] == [count[data[i : i + 11].tobytes()] > 1 for i in range(len(places))]
    sizes = sorted(len(x) for x in index.levels.values())
    assert len(sizes) <= 6 and sum(sizes) == len(count)


def test_packed_keys_round_trip():
    r = np.random.default_rng(1)
    for bits in (3, 40, 64):
        keys = np.unique(r.integers(0, 2**63, 500, dtype=np.uint64) >> np.uint64(64 - bits) if bits < 64 else r.integers(0, 2**64 - 1, 500, dtype=np.uint64))
        n = r.integers(1, 255, len(keys))
        k, c, m = corpus.unpacked(corpus.packed(keys, keys.astype(np.uint32), n))
        assert (k == keys).all() and (c == keys.astype(np.uint32)).all() and (m == n).all()
        at = corpus.bounds(keys, 7, bits)
        assert at[0] == 0 and at[-1] == len(keys)


def test_words_and_windows_of_texts():
    import pyarrow as pa

    texts = ["a  bc\n", "", " ", "d", "bc a bc"]
    from hazgrid.llm.common import data_of

    w = blocks.find_words(*data_of(pa.array(texts)))
    assert w.n.tolist() == [2, 0, 0, 1, 3] and [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)] == [b"a", b"bc", b"d", b"bc", b"a", b"bc"]
    first, text = w.windows(2)
    assert first.tolist() == [0, 3, 4] and text.tolist() == [0, 4, 4]
    h = w.hashes()
    assert h[1] == h[3] == h[5] and h[0] == h[4] != h[1] and len({*h.tolist()}) == 3
