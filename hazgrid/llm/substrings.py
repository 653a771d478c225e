"""Removes repeated runs of words: windows of 35 words that the corpus has at another place too.

Pass 1, the count-min sketch. A window is counted by its least 18-word gram (by hash): equal windows have equal
least grams at equal places, so a gram's count is never below its windows'. Every block counts its grams into a sketch of two
rows of cells; blocks send the cells they touched, in slices, and the slices of all blocks are merged. What is kept of a
cell is whether it got two or more. The bits are broadcast; their number follows the corpus and has a proven bound (max_cells), beyond which
more windows are only estimated repeated.

Pass 2, exact. Only windows estimated repeated in both rows are grouped, by 96 bits of hash, in the exchange of `corpus`; it loses none,
since the estimate is never too low. Pass 3 marks them in each block and removes the words that they cover.

Equal texts are handled once, and all their windows are repeated. Null texts have no words. Texts shorter than a window keep all words.
An empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazgrid.llm import blocks as B
from hazgrid.llm import common as C
from hazgrid.llm import corpus as K

U = np.uint64


@dataclass(frozen=True)
class Windows:
    size: int = 35
    gram: int = 18
    #: Cells of a row of the sketch: a power of two, four for each gram, at most this; their bits are broadcast.
    max_cells: int = 1 << 28
    slices: int = 32


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i:i + width] for every i that has all of it."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).reshape(-1)
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


POSITION = U(26)


def windows_of(part: K.Part, w: Windows) -> tuple[B.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, each window's first word and text, and its least gram: 38 bits of hash, 26 of place (leftmost of equals)."""
    words = B.find_words(*C.data_of(part.text))
    hashes = words.hashes()
    first, text = words.windows(w.size)
    if not len(first):
        return words, hashes, first, text, np.zeros(0, U)
    every = np.arange(max(0, len(hashes) - w.gram + 1))
    # A window's grams lie in its text, whatever grams across texts are.
    grams = B.window_hashes(hashes, every, w.gram, salt=5) >> POSITION << POSITION | every.astype(U)
    return words, hashes, first, text, sliding_least(grams, w.size - w.gram + 1)[first]


def places(least: np.ndarray) -> np.ndarray:
    """The grams that are least somewhere, once for each place. Windows of one text that are equal have theirs at different places."""
    return least[np.flatnonzero(np.diff(least, prepend=U(2**64 - 1)))] >> POSITION


def cells_of(grams: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    return grams & U(cells - 1), B.mixed(grams, 11) & U(cells - 1)


def sketch(corpus: K.Corpus, w: Windows) -> list[np.ndarray]:
    """For each of two rows, bits of the cells that got two or more."""
    grams = corpus.n_bytes // 5 * 2 // (w.size - w.gram + 2) + 1
    cells = min(w.max_cells, max(1 << 16, 1 << (4 * grams - 1).bit_length()))
    slices, width = w.slices, cells // w.slices

    def send(block: K.Block) -> pa.Table:
        held: list[np.ndarray] = []
        for part in block.parts():
            held.append(places(windows_of(part, w)[-1]))
        grams = np.concatenate([np.zeros(0, U), *held])
        names, cells_out = [], []
        for row, cell in enumerate(cells_of(grams, cells)):
            cell, n = np.unique(cell, return_counts=True)
            at = np.searchsorted(cell, np.arange(slices + 1).astype(U) * U(width))
            for s in range(slices):
                mine = slice(at[s], at[s + 1])
                if at[s + 1] > at[s]:
                    own = (cell[mine] - U(s * width)).astype("<u4") << np.uint32(1) | (n[mine] > 1).astype("<u4")
                    names.append(row * slices + s)
                    cells_out.append(own.tobytes())
        return pa.table([pa.array(names, pa.int64()), pa.array(cells_out, pa.binary())], names=["slice", "cells"])

    def merge(table: pa.Table) -> pa.Table:
        own = np.concatenate([np.frombuffer(b, "<u4") for b in table["cells"].to_pylist()])
        n = np.bincount(own >> np.uint32(1), minlength=width) + np.bincount(own[own & np.uint32(1) > 0] >> np.uint32(1), minlength=width)
        return pa.table([pa.array([table["slice"][0].as_py()], pa.int64()), pa.array([np.packbits(n > 1).tobytes()], pa.binary())], names=["slice", "bits"])

    merged = K.each_block(corpus, send, "slice long, cells binary").groupBy("slice").applyInArrow(merge, "slice long, bits binary")
    bits = np.zeros((2 * slices, width // 8), np.uint8)
    for r in merged.toLocalIterator():  # 2 * cells bits, whatever the corpus
        bits[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return [bits[:slices].reshape(-1), bits[slices:].reshape(-1)]


def estimated(least: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Whether both rows have two or more for it."""
    cells = len(bits[0]) * 8
    found = np.ones(len(least), bool)
    for cell, row in zip(cells_of(least, cells), bits, strict=True):
        cell = cell.astype(np.int64)
        found &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
    return found


def candidates(part: K.Part, w: Windows, bits: list[np.ndarray]):
    """Words, and first word, text, key and check of the windows estimated repeated."""
    words, hashes, first, text, least = windows_of(part, w)
    keep = np.flatnonzero(estimated(least >> POSITION, bits))
    first, text = first[keep], text[keep]
    key = B.window_hashes(hashes, first, w.size)
    check = (B.window_hashes(hashes, first, w.size, base=0xE7037ED1A0B428DB, salt=3) >> U(32)).astype(np.uint32)
    return words, first, text, key, check


def remove_repeats(docs: DataFrame, w: Windows = Windows(), with_text: bool = True, sizes: K.Sizes = K.Sizes()) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, the digest of the kept words, and the kept text (null unless asked for)."""
    corpus = K.corpus_of(docs, sizes=sizes)
    schema = "digest binary, n_words long, n_removed long, kept_sha256 string, kept string"
    held = docs.sparkSession.sparkContext.broadcast(sketch(corpus, w))

    def keys_of(block: K.Block):
        keys, checks, counts = [np.zeros(0, U)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)]
        for part in block.parts():
            _, _, text, key, check = candidates(part, w, held.value)
            k, c, n, _ = K.distinct(key, check, np.where(part.many[text], 2, 1))
            keys.append(k), checks.append(c), counts.append(n)
        return K.distinct(*(np.concatenate(x) for x in (keys, checks, counts)))[:3]

    def remove(block: K.Block, answers: pa.Table) -> pa.Table:
        total = K.answered(answers)
        keys, checks, _ = keys_of(block)
        both = keys[total > 1], checks[total > 1]
        out: list[pa.RecordBatch] = []
        for part in block.parts():
            words, first, text, key, check = candidates(part, w, held.value)
            repeated = member(key, check, *both)
            marks = first[repeated]
            all_first, all_text = words.windows(w.size)
            marks = np.concatenate([marks, all_first[part.many[all_text]]])
            gone = B.covered(marks, w.size, len(words.starts))
            out.append(cut_words(part, words, gone, with_text))
        return pa.Table.from_batches(out, schema=RESULT)

    answers = K.exchanged(corpus, keys_of)
    return K.by_document(corpus, K.each_block(corpus, remove, schema, answers))


RESULT = pa.schema([("digest", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def member(key: np.ndarray, check: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which (key, check) are among the sorted (keys, checks)."""
    if not len(keys):
        return np.zeros(len(key), bool)
    at = np.searchsorted(keys, key)
    found, left = np.zeros(len(key), bool), np.arange(len(key))
    while len(left):  # a second round only for a key with several checks
        left = left[at[left] < len(keys)]
        left = left[keys[at[left]] == key[left]]
        hit = checks[at[left]] == check[left]
        found[left[hit]] = True
        left = left[~hit]
        at[left] += 1
    return found


def cut_words(part: K.Part, words: B.Words, gone: np.ndarray, with_text: bool) -> pa.RecordBatch:
    raw = words.data.tobytes()
    kept, removed = [], []
    for i in range(len(part.rows)):
        a, b = words.first[i], words.first[i + 1]
        text, cut = raw[words.at[i] : words.at[i + 1]].split(), gone[a:b]
        n = int(cut.sum())
        removed.append(n)
        kept.append(b" ".join(text) if not n else b" ".join(compress(text, ~cut)) if n < len(text) else b"")
    return pa.RecordBatch.from_arrays([part.digests.cast(pa.binary()), pa.array(words.n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept if with_text else [None] * len(kept), pa.binary()).cast(pa.string())], schema=RESULT)
