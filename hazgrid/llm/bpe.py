"""BPE encoding and decoding with the files of public byte-level tokenizers.

Texts are cut into words by the tokenizer's own pattern. Words not met before are encoded together: the symbols of
all of them lie in one flat array, and each round finds the rank of every neighbouring pair by binary search
over the sorted pair keys, takes the lowest rank of each word and merges its pairs. A bounded cache keeps
the ids of what stands between spaces, so a text is a gather of runs of ids, and decoding a gather of runs of bytes.

Null texts count as empty: no ids. Strings of special tokens in a text become their ids, as in the tokenizers library with its default
settings. Files with a normalizer, another pre-tokenizer or other kinds of merging are refused. Equal texts get equal ids; rows keep their order; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hazgrid.llm import common as C

BYTE_BPE = f"{C.TOKENIZER_DIR}/byte_bpe_50k.json"
#: The pattern of byte-level pre-tokenisation; white space is Unicode's property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Unicode's White_Space.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
NONE = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def refuse_others(path: str, spec: dict) -> None:
    """Raises for a file whose settings the encoder does not follow: it cuts by PATTERN and merges bytes, and nothing else."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    by_bytes = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    added = not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if spec.get("normalizer") or not (plain and by_bytes and added):
        raise ValueError(f"{path} is not a plain byte-level BPE file")


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of the runs starts[i]:starts[i] + sizes[i], one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Vocabulary:
    """Ids, their bytes, and the merges as sorted pair keys."""

    def __init__(self, path: str = BYTE_BPE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_others(path, spec)
        letters = byte_letters()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        raw: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            raw[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.byte_n = np.array([len(x) for x in raw], np.int64)
        self.byte_at = np.cumsum(self.byte_n) - self.byte_n
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in merges), strict=True))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # All pairs of a word with the lowest rank can merge in one round if no merge makes a pair of lower rank.
        born = np.full(self.size, -1, np.int64)
        born[made] = np.arange(len(made))
        self.by_rounds = len(np.unique(made)) == len(made) and bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has. No word is empty."""
        sizes = np.array([len(w) for w in words], np.int64)
        ids, word = self.of_byte[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), sizes)
        done_ids, done_words = [], []
        while len(ids):
            pair = word[1:] == word[:-1]
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(pair & (self.keys[at] == key), self.ranks[at], NONE)
            first = np.flatnonzero(np.concatenate([[True], ~pair]))
            low = np.minimum.reduceat(np.concatenate([rank, [NONE]]), first)
            own = np.repeat(low, np.diff(np.concatenate([first, [len(ids)]])))
            ended = own == NONE
            chosen = np.flatnonzero((rank == own[:-1]) & ~ended[:-1])
            if self.by_rounds:  # of overlapping pairs, every other one from the left
                run = np.concatenate([[True], np.diff(chosen) != 1])
                begin = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0)) if len(chosen) else chosen
                chosen = chosen[(np.arange(len(chosen)) - begin) % 2 == 0]
            else:
                chosen = chosen[np.concatenate([[True], word[chosen][1:] != word[chosen][:-1]])] if len(chosen) else chosen
            ids[chosen] = self.made[at[chosen]]
            stays = ~ended
            done_ids.append(ids[ended])
            done_words.append(word[ended])
            stays[chosen + 1] = False
            ids, word = ids[stays], word[stays]
        every_word = np.concatenate([*done_words, word])
        order = np.argsort(every_word, kind="stable")
        return np.concatenate([*done_ids, ids])[order], np.bincount(every_word, minlength=len(words))


class Codes(dict):
    """Chunks by number; one that isn't there gets the next, and is listed as new."""

    def __init__(self, known: dict):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        code = self[key] = len(self)
        self.new.append(key)
        return code


class Encoder:
    """Encodes texts with a cache of their chunks; by merge rounds here, or by the tokenizers library.

    A chunk is what lies between spaces, with the space before it; the pattern always cuts before a space that a
    character other than white space follows. Texts with other spaces are cut by the pattern itself.
    Keys: "x" for the chunk " x", and "x " for a chunk "x" that has no space before it (the first, or a word by the pattern).
    """

    def __init__(self, path: str = BYTE_BPE, library: bool = False, most_chunks: int = 400_000, most_chars: int = 12 << 20):
        import regex

        self.vocabulary, self.most_chunks, self.most_chars = Vocabulary(path), most_chunks, most_chars
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")").split if self.vocabulary.special else None
        self.library = None
        if library:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
        special = list(self.vocabulary.special.values())
        self.codes = Codes({i: n for n, i in enumerate(special)})
        self.ids, self.n = np.array(special, np.int32), np.ones(len(special), np.int64)
        self.odd, self.uses = np.zeros(len(special), bool), np.zeros(len(special), np.int64)
        self.n_special, self.n_chars = len(special), 0

    def forget(self) -> None:
        """Keeps the half of the cache that is used most, without long chunks."""
        often = max(2, int(np.partition(self.uses, -self.most_chunks // 2)[-self.most_chunks // 2]) + 1 if len(self.uses) > self.most_chunks // 2 else 0)
        keys = list(self.codes)
        keep = [i for i, (k, u) in enumerate(zip(keys, self.uses.tolist(), strict=True)) if i < self.n_special or (u >= often and len(k) < 200)]
        at = np.array(keep, np.int64)
        self.ids = self.ids[gather((np.cumsum(self.n) - self.n)[at], self.n[at])]
        self.n, self.odd, self.uses = self.n[at], self.odd[at], self.uses[at] >> 1
        self.codes = Codes({keys[i]: n for n, i in enumerate(keep)})
        self.n_chars = sum(len(k) for k in self.codes if isinstance(k, str))

    def chunks(self, text: str, by_pattern: bool) -> list[str | int]:
        if self.split is not None and any(s in text for s in self.vocabulary.special):
            return list(chain.from_iterable([self.vocabulary.special[x]] if x in self.vocabulary.special else self.plain(x, by_pattern) for x in self.split(text)))
        return self.plain(text, by_pattern)

    def plain(self, text: str, by_pattern: bool) -> list[str | int]:
        if by_pattern:
            return [w[1:] if len(w) > 1 and w[0] == " " and w[1] not in WHITE else w + " " for w in self.find(text)]
        out = text.split(" ")
        out[0] += " "
        return out

    def learn(self, keys: list[str]) -> None:
        odd = np.array([not k or (k[0] in WHITE and k[-1] != " ") for k in keys], bool)
        if self.library is not None:
            ids, n = self.by_library(keys, odd)
        else:
            cut = [[] if o else self.find(k[:-1] if k[-1] == " " else " " + k) for k, o in zip(keys, odd.tolist(), strict=True)]
            words = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
            of_words, n_words = self.vocabulary.merge_words([w.encode() for w in words]) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            flat = np.fromiter(map(words.__getitem__, chain.from_iterable(cut)), np.int64)
            ids = of_words[gather((np.cumsum(n_words) - n_words)[flat], n_words[flat])].astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(n_words[flat])])[np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)]
            n = np.diff(ends)
        self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
        self.odd, self.uses = np.concatenate([self.odd, odd]), np.concatenate([self.uses, np.zeros(len(keys), np.int64)])
        self.n_chars += sum(map(len, keys))

    def by_library(self, keys: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of each chunk. Those with a space before them are encoded as one text, which it cuts where they join."""
        spaced = [i for i, (k, o) in enumerate(zip(keys, odd.tolist(), strict=True)) if not o and k[-1] != " "]
        rest = [i for i, k in enumerate(keys) if k and k[-1] == " "]
        first = self.library.encode_batch_fast([keys[i][:-1] for i in rest], add_special_tokens=False)
        joined = self.library.encode_batch_fast(["".join(" " + keys[i] for i in spaced)], add_special_tokens=False)[0].ids
        ends = np.cumsum([len(keys[i].encode()) + 1 for i in spaced])
        n = np.zeros(len(keys), np.int64)
        n[spaced] = np.diff(np.searchsorted(np.cumsum(self.vocabulary.byte_n[joined]), ends), prepend=-1)
        n[rest] = [len(e.ids) for e in first]
        ids = np.zeros(int(n.sum()), np.int32)
        starts = np.cumsum(n) - n
        ids[gather(starts[spaced], n[spaced])] = joined
        ids[gather(starts[rest], n[rest])] = list(chain.from_iterable(e.ids for e in first))
        return ids, n

    def coded(self, cut: list[list[str | int]]) -> np.ndarray:
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        if self.codes.new:
            self.learn(self.codes.new)
            self.codes.new = []
        return codes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin, and the end."""
        if len(self.codes) > self.most_chunks or self.n_chars > self.most_chars:
            self.forget()
        cut = [self.chunks(t, False) if t else [] for t in texts]
        codes = self.coded(cut)
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        odd = np.flatnonzero(self.odd[codes])
        if len(odd):
            for i in np.unique(np.searchsorted(ends, odd, side="right") - 1).tolist():
                cut[i] = self.chunks(texts[i], True)
            codes = self.coded(cut)
            ends = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        self.uses += np.bincount(codes, minlength=len(self.uses))
        n = self.n[codes]
        return self.ids[gather((np.cumsum(self.n) - self.n)[codes], n)], np.concatenate([[0], np.cumsum(n)])[ends]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that aren't UTF-8 become U+FFFD."""
        v = self.vocabulary
        n = v.byte_n[ids]
        raw = v.bytes[gather(v.byte_at[ids], n)].tobytes()
        at = np.concatenate([[0], np.cumsum(n)])[ends]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, library: bool = False) -> Encoder:
    """One a Python worker."""
    if (path, library) not in _ENCODERS:
        _ENCODERS[path, library] = Encoder(path, library)
    return _ENCODERS[path, library]


ROUND = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """One row a document: its tokens, the digest of its ids, and that of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for part in C.cut(batches, most=4 << 20):
            ids, ends = e.encode(C.texts(part).to_pylist())
            raw = ids.astype("<u4").tobytes()
            yield C.made(
                ROUND, doc_id=part.column("doc_id").cast(pa.int64()), n_tokens=np.diff(ends), ids_sha256=[hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)],
                decoded_sha256=[hashlib.sha256(t.encode()).hexdigest() for t in e.decode(ids, ends)],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str = BYTE_BPE, out: str = "ids") -> DataFrame:
    """docs with a column of ids (array<int>); it replaces one of that name."""
    schema = docs.withColumn(out, docs["text"].cast("string")).drop(out).schema.add(out, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for part in C.cut(batches, most=4 << 20):
            ids, ends = e.encode(C.texts(part).to_pylist())
            kept = {n: part.column(n) for n in part.schema.names if n != out} | {out: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))}
            yield pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))

    return docs.mapInArrow(run, schema)
