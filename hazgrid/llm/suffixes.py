"""Removes repeated byte strings: strings of 400 bytes that the corpus has at another place too.

Every string of 400 bytes has an anchor: the place of its least 192-byte gram, by hash. Equal strings have equal grams at equal
places in them, so the texts fall into segments, one an anchor with all strings that share it, and only segments
with equal grams can share strings. Grams are hashed once, written, and counted in the exchange of `corpus`; those that the corpus has once are done.

The other segments meet by gram. Equal segments repeat in whole. What is left goes into a logarithmic index family: each
batch of new strings is sorted into a suffix array (of suffixes cut to 400 bytes, which is all that decides a match), scanned against
each existing level, and then carried like a binary counter: levels of equal size merge into one of twice the size. Strings met
again are marked, with those they meet. Comparisons are of bytes, so the result is exact.

A passage that very many texts quote has grams with very many segments, all different at their ends. Segments of grams that reach the counter's
end (255) are therefore trimmed before they go into the index: their strings are first counted by 96 bits of hash in an exchange of their own,
and only runs of strings counted twice or more are sent. Those of one passage are then equal but for the few ways to quote a part of it, and a block
sends equal ones once. The index decides about them by bytes as about all others.

Besides, `n_shared` tells how many sampled grams of a text the corpus has at another place: the least gram of each string of 288 bytes is
one of them, so no repeat of 288 bytes or more goes unseen, and none under 192 counts. It is a report; only strings of 400 bytes are removed.

Null texts are empty; texts shorter than 400 bytes lose nothing; equal texts are handled once
and lose all if they are long enough. An empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazgrid.llm import blocks as B
from hazgrid.llm import common as C
from hazgrid.llm import corpus as K
from hazgrid.llm.substrings import sliding_least

U = np.uint64


@dataclass(frozen=True)
class Strings:
    size: int = 400
    gram: int = 192
    #: Repeats of so many bytes are reported, in `n_shared`.
    short: int = 288
    #: Strings of a new batch.
    batch: int = 8192
    #: Segments of grams at as many places (the counter ends at 255) are trimmed.
    hot: int = 255


class SuffixLevels:
    """Suffix arrays in levels of doubling size; each string is in one level once, by its first place."""

    BLOCK = 2048

    def __init__(self, data: np.ndarray, size: int):
        self.view = np.lib.stride_tricks.sliding_window_view(data, size)
        self.size, self.again, self.levels = size, np.zeros(len(data), bool), {}

    def strings(self, at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.view[at]).view(f"S{self.size}").reshape(-1)

    def add(self, at: np.ndarray) -> None:
        """A new batch of places."""
        keys = self.strings(at)
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        same = np.concatenate([[False], keys[1:] == keys[:-1]])
        self.again[at[same]] = True
        self.again[at[np.flatnonzero(same) - 1]] = True
        at = at[~same]
        for level in self.levels.values():
            place, met = self.scan(level, at)
            self.again[at[met]] = True
            self.again[level[place[met]]] = True
            at = at[~met]
        k = 0
        while len(at) and k in self.levels:
            older = self.levels.pop(k)
            at = np.insert(older, self.scan(older, at)[0], at)
            k += 1
        if len(at):
            self.levels[k] = at

    def scan(self, level: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted places: where each would stand in the level, and whether it meets an equal there. A block of either side is read at a time."""
        place, met = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        heads = self.strings(level[:: self.BLOCK])
        for begin in range(0, len(at), self.BLOCK):
            keys = self.strings(at[begin : begin + self.BLOCK])
            block = np.searchsorted(heads, keys, side="right") - 1
            for b in np.unique(block[block >= 0]):
                mine = np.flatnonzero(block == b)
                own = self.strings(level[b * self.BLOCK : (b + 1) * self.BLOCK])
                p = np.searchsorted(own, keys[mine])
                met[begin + mine] = (p < len(own)) & (own[np.minimum(p, len(own) - 1)] == keys[mine])
                place[begin + mine] = b * self.BLOCK + p
        return place, met


POSITION = U(30)


@dataclass
class Anchors:
    """Sampled grams of some texts, in order: their keys, each's segment (its first string, by its place in the text, and how many there are; 0 for
    grams that are least of shorter strings only), and where each text's begin, and the end."""

    gram: np.ndarray
    first: np.ndarray
    n: np.ndarray
    at: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def pack(self) -> bytes:
        head = np.array([len(self.at), len(self.gram)], U).tobytes()
        return head + self.at.astype("<u8").tobytes() + self.gram.tobytes() + self.first.astype("<u4").tobytes() + self.n.astype("<u4").tobytes()

    @staticmethod
    def unpack(blob) -> Anchors:
        texts, n = (int(x) for x in np.frombuffer(blob, U, 2))
        at = np.frombuffer(blob, "<u8", texts, 16).astype(np.int64)
        gram = np.frombuffer(blob, U, n, 16 + 8 * texts)
        first, size = (np.frombuffer(blob, "<u4", n, 16 + 8 * texts + (8 + 4 * k) * n).astype(np.int64) for k in (0, 1))
        return Anchors(gram, first, size, at)

    @staticmethod
    def joined(parts: list[Anchors]) -> Anchors:
        at = np.concatenate([[0], np.cumsum([k for p in parts for k in np.diff(p.at).tolist()])]).astype(np.int64)
        return Anchors(*(np.concatenate([np.zeros(0, kind), *(getattr(p, c) for p in parts)]) for c, kind in (("gram", U), ("first", np.int64), ("n", np.int64))), at)


def anchors_of(part: K.Part, s: Strings) -> Anchors:
    data, at = C.data_of(part.text)
    strings = B.Words(data, at, data, data, at)
    first, text = strings.windows(s.short)
    if not len(first):
        none = np.zeros(0, np.int64)
        return Anchors(np.zeros(0, U), none, none, np.zeros(len(at), np.int64))
    every = np.arange(len(data) - s.gram + 1)
    grams = B.run_hashes(data, every, every + s.gram, 0xC2B2AE3D27D4EB4F, 9)
    least = sliding_least(grams >> POSITION << POSITION | every.astype(U), s.short - s.gram + 1)
    long_first, long_text = strings.windows(s.size)
    of_long = sliding_least(least, s.size - s.short + 1)[long_first] & U((1 << 30) - 1) if len(long_first) else np.zeros(0, U)
    place = np.unique(least[first] & U((1 << 30) - 1)).astype(np.int64)
    # The strings that share an anchor are neighbours.
    begins = np.flatnonzero(np.diff(of_long, prepend=U(2**64 - 1)))
    own = np.searchsorted(place, of_long[begins].astype(np.int64))
    begin, n = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    begin[own], n[own] = long_first[begins] - at[long_text[begins]], np.diff(np.append(begins, len(of_long)))
    # Least hashes are all small; keys are dealt by their leading bits, so they are mixed again.
    return Anchors(B.mixed(grams[place], 21), begin, n, np.searchsorted(place, at))


KINDS = ("anchors", "grams", "strings", "marks")


def remove_repeats(docs: DataFrame, s: Strings = Strings(), with_bytes: bool = True, sizes: K.Sizes = K.Sizes()) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, the digest of the kept bytes, n_shared, and the kept bytes (null unless asked for)."""
    corpus = K.corpus_of(docs, "bytes", sizes)
    parts, size = 4 * corpus.parts(1.0), s.size

    def of_kind(answers: pa.Table, kind: str) -> pa.Table:
        return answers.filter(pa.array(answers["kind"].to_numpy() == KINDS.index(kind)))

    def sample(block: K.Block) -> pa.Table:
        return pa.table({"block": [block.name], "part": [0], "answer": [Anchors.joined([anchors_of(part, s) for part in block.parts()]).pack()]}, schema=ANSWERS)

    def counted(block: K.Block, answers: pa.Table) -> tuple[Anchors, tuple]:
        """The block's anchors; their distinct keys, each's count here, and each anchor's place among them."""
        a = Anchors.unpack(of_kind(answers, "anchors")["answer"][0].as_buffer())
        return a, K.distinct(a.gram, None, np.where(block.many[a.text], 2, 1))

    def totals(block: K.Block, answers: pa.Table) -> tuple[Anchors, np.ndarray]:
        """The block's anchors, and how often the corpus has each one's gram."""
        a, (_, _, _, place) = counted(block, answers)
        return a, K.answered(of_kind(answers, "grams"))[place]

    def hot_strings(block: K.Block, answers: pa.Table):
        """Segments of very frequent grams (gram, text, first, n); their strings' keys, checks and counts, one after another."""
        a, total = totals(block, answers)
        keep = np.flatnonzero((total >= s.hot) & (a.n > 0))
        gram, text, first, n = a.gram[keep], a.text[keep], a.first[keep], a.n[keep]
        keys, checks = [np.zeros(0, U)], [np.zeros(0, np.uint32)]
        for part in block.parts() if len(keep) else ():
            lo, hi = np.searchsorted(text, [part.begin, part.begin + len(part.rows)])
            if hi > lo:
                data, at = C.data_of(part.text)
                places = np.repeat(at[text[lo:hi] - part.begin] + first[lo:hi] - (np.cumsum(n[lo:hi]) - n[lo:hi]), n[lo:hi]) + np.arange(int(n[lo:hi].sum()))
                keys.append(B.run_hashes(data, places, places + size, 0xA24BAED4963EE407, 1))
                checks.append((B.run_hashes(data, places, places + size, 0x9FB21C651E98DF25, 2) >> U(32)).astype(np.uint32))
        return (gram, text, first, n), (np.concatenate(keys), np.concatenate(checks), np.where(block.many[np.repeat(text, n)], 2, 1))

    def repeated(block: K.Block, answers: pa.Table) -> tuple[np.ndarray, ...]:
        """Gram, text, first and n of the segments for the index, by text: those whose grams repeat, and trimmed ones."""
        a, total = totals(block, answers)
        keep = np.flatnonzero((total > 1) & (total < s.hot) & (a.n > 0))
        plain = a.gram[keep], a.text[keep], a.first[keep], a.n[keep]
        hot, strings = hot_strings(block, answers)
        if not len(hot[0]):
            return plain
        met = (K.answered(of_kind(answers, "strings")) > 1)[K.distinct(*strings)[3]]
        segment = np.repeat(np.arange(len(hot[0])), hot[3])
        begin = np.flatnonzero(met & (np.diff(segment, prepend=-1).astype(bool) | ~np.concatenate([[False], met[:-1]])))
        end = np.flatnonzero(met & (np.diff(segment, append=-1).astype(bool) | ~np.concatenate([met[1:], [False]])))
        of = segment[begin]
        trimmed = hot[0][of], hot[1][of], hot[2][of] + begin - (np.cumsum(hot[3]) - hot[3])[of], end - begin + 1
        both = [np.concatenate(x) for x in zip(plain, trimmed, strict=True)]
        order = np.argsort(both[1], kind="stable")
        return tuple(x[order] for x in both)

    def with_strings(block: K.Block, segments: tuple[np.ndarray, ...]):
        """Each part, with (gram, bytes, text in the part, first) of its segments."""
        gram, text, first, n = segments
        for part in block.parts():
            data, at = C.data_of(part.text)
            lo, hi = np.searchsorted(text, [part.begin, part.begin + len(part.rows)])
            raw, t = data.tobytes(), text[lo:hi] - part.begin
            begin = at[t] + first[lo:hi]
            yield part, data, at, [(g, raw[a:b], i, f) for g, a, b, i, f in zip(gram[lo:hi].tolist(), begin.tolist(), (begin + n[lo:hi] + (size - 1)).tolist(), t.tolist(), first[lo:hi].tolist(), strict=True)]

    def send(block: K.Block, answers: pa.Table) -> pa.Table:
        """Each distinct segment of a block once, with how often it is there."""
        held: dict[bytes, list] = {}
        for part, _, _, segments in with_strings(block, repeated(block, answers)):
            for gram, own, t, f in segments:
                n = 2 if part.many[t] else 1
                if own in held:
                    held[own][3] += n
                else:
                    held[own] = [gram, int(part.rows[t]), f, n]
        part_of = (np.array([h[0] for h in held.values()], U) >> U(32)) * U(parts) >> U(32)
        order, own = np.argsort(part_of, kind="stable"), list(held)
        table = np.array([(h[0], h[1], h[2], min(h[3], 2), len(k)) for k, h in held.items()], U).reshape(-1, 5)
        cuts = np.flatnonzero(np.diff(part_of[order])) + 1
        out = {"part": [], "block": [], "blob": []}
        for mine in np.split(order, cuts) if len(order) else []:
            out["part"].append(int(part_of[mine[0]]))
            out["block"].append(block.name)
            out["blob"].append(np.array([len(mine)], U).tobytes() + table[mine].tobytes() + b"".join([own[i] for i in mine]))
        return pa.table([pa.array(out["part"], pa.int64()), pa.array(out["block"], pa.string()), pa.array(out["blob"], pa.binary())], names=["part", "block", "blob"])

    def match(table: pa.Table) -> pa.Table:
        """Runs of repeated strings of each block's segments: row, first string, end."""
        entries: list[tuple[int, int, int, int]] = []  # number of the distinct segment, blob, row, first
        known: dict[bytes, int] = {}
        grams, counts = [], []
        for k, blob in enumerate(table["blob"].to_pylist()):
            n = int(np.frombuffer(blob, U, 1)[0])
            rows = np.frombuffer(blob, U, 5 * n, 8).reshape(n, 5).astype(np.int64)
            at = 8 + 40 * n
            for gram, row, first, count, length in rows.tolist():
                own = blob[at : (at := at + length)]
                i = known.setdefault(own, len(known))
                if i == len(grams):
                    grams.append(gram), counts.append(0)
                counts[i] += count
                entries.append((i, k, row, first))
        lengths = np.array([len(x) for x in known], np.int64)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(known), np.uint8)
        index = SuffixLevels(data, size)
        _, back, same = np.unique(np.array(grams), return_inverse=True, return_counts=True)
        several = np.flatnonzero(same[back] > 1)
        several = several[np.argsort(back[several], kind="stable")]
        n = lengths[several] - (size - 1)
        places = np.repeat(starts[several] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        for k in range(0, len(places), s.batch):
            index.add(places[k : k + s.batch])
        out: dict[int, list[np.ndarray]] = {}
        for i, k, row, first in entries:
            a, n = starts[i], lengths[i] - (size - 1)
            if counts[i] > 1:
                found = np.array([[row, first, first + n]])
            else:
                edge = np.flatnonzero(np.diff(index.again[a : a + n].astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                found = np.column_stack([np.full(len(edge), row), edge + first])
            if len(found):
                out.setdefault(k, []).append(found)
        names = table["block"].to_pylist()
        return pa.table([pa.array([names[k] for k in out], pa.string()), pa.array([0] * len(out), pa.int64()), pa.array([np.concatenate(x).astype("<u4").tobytes() for x in out.values()], pa.binary())], schema=ANSWERS)

    def remove(block: K.Block, answers: pa.Table) -> pa.Table:
        marks = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(b, "<u4").reshape(-1, 3).astype(np.int64) for b in of_kind(answers, "marks")["answer"].to_pylist())])
        a, total = totals(block, answers)
        shared = np.bincount(a.text[total > 1], minlength=len(block.rows))
        segments = repeated(block, answers)
        held: dict[bytes, list] = {}
        for part, _, _, own_segments in with_strings(block, segments):
            for _, own, t, f in own_segments:
                held.setdefault(hashlib.blake2b(own, digest_size=16).digest(), []).append((int(part.rows[t]), f, f + len(own) - (size - 1)))
        # Of a block's equal segments only one was sent.
        local = [x for same in held.values() if len(same) > 1 for x in same]
        marks = np.concatenate([marks, np.array(local, np.int64).reshape(-1, 3)])
        marks = marks[np.argsort(marks[:, 0], kind="stable")]
        out = []
        for part in block.parts():
            data, at = C.data_of(part.text)
            lo, hi = np.searchsorted(marks[:, 0], [part.rows[0], part.rows[-1] + 1])
            mine = marks[lo:hi]
            base = at[:-1][np.searchsorted(part.rows, mine[:, 0])]
            step = np.zeros(len(data) + 1, np.int64)
            np.add.at(step, base + mine[:, 1], 1)
            np.add.at(step, base + mine[:, 2] + size - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            whole = np.flatnonzero(part.many & (np.diff(at) >= size))
            for i in whole.tolist():
                gone[at[i] : at[i + 1]] = True
            out.append(cut_bytes(part, data, at, gone, shared[part.begin : part.begin + len(part.rows)], with_bytes))
        return pa.Table.from_batches(out, schema=RESULT)

    def so_far(*known: DataFrame) -> DataFrame:
        """What is known by now, each kind in order of KINDS."""
        return reduce(DataFrame.unionByName, [x.select("block", "part", "answer", F.lit(k).alias("kind")) for k, x in enumerate(known)])

    anchors = C.written(K.each_block(corpus, sample, K.ANSWERS), "anchors")
    grams = C.written(K.exchanged(corpus, lambda block, earlier: counted(block, earlier)[1][:3], answers=so_far(anchors), share=0.2), "grams")
    strings = C.written(K.exchanged(corpus, lambda block, earlier: K.distinct(*hot_strings(block, earlier)[1])[:3], answers=so_far(anchors, grams)), "strings")
    marks = K.each_block(corpus, send, "part long, block string, blob binary", so_far(anchors, grams, strings)).repartition(parts, "part").groupBy("part").applyInArrow(match, K.ANSWERS)
    return K.by_document(corpus, K.each_block(corpus, remove, "digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, kept binary", so_far(anchors, grams, strings, marks)))


ANSWERS = pa.schema([("block", pa.string()), ("part", pa.int64()), ("answer", pa.binary())])
RESULT = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_shared", pa.int64()), ("kept", pa.binary())])


def cut_bytes(part: K.Part, data: np.ndarray, at: np.ndarray, gone: np.ndarray, shared: np.ndarray, with_bytes: bool) -> pa.RecordBatch:
    removed, spans, kept = [], [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = gone[a:b]
        n = int(own.sum())
        removed.append(n)
        spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0)
        kept.append((data[a:b][~own] if n else data[a:b]).tobytes())
    return pa.RecordBatch.from_arrays([part.digests.cast(pa.binary()), pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(shared, pa.int64()), pa.array(kept if with_bytes else [None] * len(kept), pa.binary())], schema=RESULT)
