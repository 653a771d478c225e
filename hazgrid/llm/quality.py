"""Quality rules: word counts and the fertility of a public tokeniser.

Every whole text is encoded with two public vocabularies: a SentencePiece one that falls back to bytes, and a byte-level one. Four figures
judge it: characters of words per token of either, the share of byte-fallback tokens, and the entropy of the first's
tokens in bits. Each has a rejection band for the language, or for the script where the language has none.
One pass over the scan, no shuffle.

Fewer than `min_words` words fail by the base rules (op8's contract). A filter given `Short` judges such texts by their figures instead
of turning them away for their length: most of them are prose, and a text without spaces between words has few words however long it is.

A null text counts as empty: no words, every count 0, base_failed. A text without tokens has figures 0
and fails. Null or unknown languages are judged by script. Equal rows get equal verdicts; an empty table
gives an empty table. The filter passes all columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazgrid.llm import blocks as B
from hazgrid.llm import bpe
from hazgrid.llm import common as C


@dataclass(frozen=True)
class Band:
    """What a text of a language may have: bounds are included."""

    chars_per_token: tuple[float, float]
    chars_per_byte_token: tuple[float, float]
    byte_share: float
    #: The least entropy is that of LEAST_BITS for the text's length, and this more.
    more_bits: float = 0.0
    most_bits: float = 14.0


#: Least entropy of the tokens of prose, by the number of tokens: more tokens show more of a language. Between them the logarithm counts.
LEAST_BITS = ((32, 3.6), (64, 4.6), (115, 5.25), (184, 5.6), (345, 5.92), (690, 6.14), (1380, 6.32), (2760, 6.45), (6900, 6.54))


#: Bands of characters per byte-level token. Lower ends lie a tenth below the least of clean labelled documents of even doc_id of the small check table; real prose has 3 to 5.
BYTE = {"en": (1.65, 9.0), "de": (1.62, 9.0), "fr": (1.54, 9.0), "es": (1.45, 9.0), "latin": (1.4, 9.0), "cjk": (0.25, 4.0), "other": (0.25, 6.0)}


@dataclass(frozen=True)
class QualityRules:
    tokenizer: str = f"{C.TOKENIZER_DIR}/piece_bpe_32k.model"
    byte_tokenizer: str = bpe.BYTE_BPE
    min_words: int = 50
    max_repeat_percent: int = 50
    by_language: dict[str, Band] = field(default_factory=lambda: {
        "en": Band((1.62, 9.0), BYTE["en"], 0.2, 0.08),
        "de": Band((1.70, 9.0), BYTE["de"], 0.2, 0.03),
        "fr": Band((1.42, 9.0), BYTE["fr"], 0.2),
        "es": Band((1.52, 9.0), BYTE["es"], 0.2, 0.03),
    })
    by_script: dict[str, Band] = field(default_factory=lambda: {
        "latin": Band((1.40, 9.0), BYTE["latin"], 0.3),
        "cjk": Band((0.25, 4.0), BYTE["cjk"], 0.9, -1.0),
        "other": Band((0.40, 6.0), BYTE["other"], 0.8, -1.5),
    })


@dataclass(frozen=True)
class Short:
    """What a text of fewer than min_words words may have. Few tokens say less than many: their bounds are wider, and from 184 tokens on those of the bands."""

    #: Least entropy by the number of tokens, before the band's more_bits. A tenth below the least of clean labelled short documents of even doc_id of the small check table.
    least_bits: tuple[tuple[int, float], ...] = ((6, 1.9), (12, 2.3), (16, 2.75), (32, 3.25), (64, 3.8), (115, 4.5), *LEAST_BITS[3:])
    #: The share of the bands' lower ends of characters per token that counts, by the number of tokens: a single number is much of a short text.
    least_chars: tuple[tuple[int, float], ...] = ((90, 0.55), (184, 1.0))
    #: Symbols in 100 words.
    most_symbols: int = 20
    #: Percent of words in repeated windows, and of words equal to the one before, lines equal to an earlier one left out.
    max_repeat_percent: int = 50
    max_echo_percent: int = 40


METRICS = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64()), ("chars_per_byte_token", pa.float64()),
])
METRICS_SQL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, chars_per_byte_token double"
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def repeat_words(w: B.Words, size: int = 3) -> np.ndarray:
    """Words of each text in windows of `size` that the text has twice or more."""
    first, text = w.windows(size)
    if not len(first):
        return np.zeros(len(w.at) - 1, np.int64)
    key = B.mixed(B.window_hashes(w.hashes(), first, size) ^ B.mixed(text.astype(np.uint64), 7), 3)
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return per_text(B.covered(first[count[back] > 1], size, len(w.starts)), w.first)


def echoes(w: B.Words) -> np.ndarray:
    """Words of each text that equal the one before."""
    first, text = w.windows(2)
    hashes = w.hashes()
    return np.bincount(text[hashes[first] == hashes[first + 1]], minlength=len(w.at) - 1)


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def without_dup_lines(text: str) -> str:
    return "\n".join(dict.fromkeys(text.split("\n")))


def by_tokens(n: np.ndarray, knots: tuple[tuple[int, float], ...]) -> np.ndarray:
    """The knots' value at each number of tokens; between them the logarithm counts."""
    return np.interp(np.log2(n), np.log2([k for k, _ in knots]), [v for _, v in knots])


def script_of(text: str) -> str:
    """The script of most letters: of latin, cjk (Han, kana, Hangul) and other."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cjk = int((((x >= 0x3040) & (x <= 0x9FFF)) | ((x >= 0xAC00) & (x <= 0xD7AF))).sum())
    other = int(((x >= 0x370) & (x < 0x1E00)).sum() + (x >= 0x10000).sum())
    latin = int((((x | 32) >= 97) & ((x | 32) <= 122)).sum() + ((x >= 0xC0) & (x < 0x250)).sum())
    return max((("latin", latin), ("cjk", cjk), ("other", other)), key=lambda p: p[1])[0]


class Judge:
    def __init__(self, rules: QualityRules):
        import sentencepiece

        self.rules, self.model = rules, sentencepiece.SentencePieceProcessor(model_file=rules.tokenizer)
        # An encoder of its own with a small cache, as a worker keeps it beside what other operators load.
        self.bytes_of = bpe.Encoder(rules.byte_tokenizer, most_chunks=200_000, most_chars=6 << 20)
        self.is_byte = np.array([self.model.IsByte(i) for i in range(self.model.vocab_size())])

    def fertility(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, byte tokens and entropy of each text."""
        n, fallen, bits = (np.zeros(len(strings)) for _ in range(3))
        for i, ids in enumerate(self.model.encode(strings, num_threads=1)):
            if ids:
                ids = np.array(ids)
                n[i], fallen[i] = len(ids), self.is_byte[ids].sum()
                p = np.bincount(ids)
                p = p[p > 0] / len(ids)
                bits[i] = -(p * np.log2(p)).sum()
        return n, fallen, bits

    def judge(self, batch: pa.RecordBatch, short: Short | None = None) -> dict[str, np.ndarray]:
        """Counts, figures and verdicts. With `short`, texts of few words are kept if they are within its bounds; base_failed stays."""
        text = C.texts(batch)
        w = B.find_words(*C.data_of(text))
        strings = text.to_pylist()
        # A word's code points: its bytes that continue no other.
        points = per_text(~B.SPACE[w.data] & ((w.data & 0xC0) != 0x80), w.at)
        out = {"n_words": w.n, "word_chars": points, "n_symbols": per_text(SYMBOL[w.data], w.at), "n_repeat_words": repeat_words(w)}
        raw, at = w.data.tobytes(), w.at
        out["n_dup_lines"] = np.array([dup_lines(raw[at[i] : at[i + 1]]) for i in range(len(strings))], np.int64)
        out["base_failed"] = (w.n < self.rules.min_words) | (100 * out["n_repeat_words"] > self.rules.max_repeat_percent * w.n)
        n, fallen, bits = self.fertility(strings)
        some = np.maximum(n, 1)
        by_bytes = points / np.maximum(np.diff(self.bytes_of.encode(strings)[1]), 1)
        out |= {"n_tokens": n.astype(np.int64), "chars_per_token": points / some, "byte_share": fallen / some, "token_entropy": bits, "chars_per_byte_token": by_bytes}
        langs = batch.column("lang").to_pylist() if "lang" in batch.schema.names else [None] * len(strings)
        floor = by_tokens(some, LEAST_BITS)
        figures = zip(out["base_failed"].tolist(), langs, strings, out["chars_per_token"].tolist(), by_bytes.tolist(), out["byte_share"].tolist(), (bits - floor).tolist(), bits.tolist(), strict=True)
        out["kept"] = np.array([not failed and self.within(lang, string, *rest) for failed, lang, string, *rest in figures], bool)
        if short is not None:
            few = np.flatnonzero((w.n > 0) & (w.n < self.rules.min_words))
            out["kept"][few] = self.short_kept(short, [langs[i] for i in few], [strings[i] for i in few], {k: v[few] for k, v in out.items()})
        return out

    def short_kept(self, short: Short, langs: list[str | None], strings: list[str], x: dict[str, np.ndarray]) -> np.ndarray:
        """The verdicts of texts with few words, and one at least."""
        once = B.find_words(*C.data_of(pa.array([without_dup_lines(s) for s in strings], pa.string())))
        some = np.maximum(x["n_tokens"], 1)
        share, above = by_tokens(some, short.least_chars), x["token_entropy"] - by_tokens(some, short.least_bits)
        figures = zip(langs, strings, (x["chars_per_token"] / share).tolist(), (x["chars_per_byte_token"] / share).tolist(), x["byte_share"].tolist(), above.tolist(), x["token_entropy"].tolist(), strict=True)
        varied = (100 * repeat_words(once) <= short.max_repeat_percent * once.n) & (100 * echoes(once) <= short.max_echo_percent * once.n)
        return np.array([self.within(*f) for f in figures], bool) & varied & (100 * x["n_symbols"] <= short.most_symbols * x["n_words"])

    def within(self, lang: str | None, text: str, chars: float, by_bytes: float, share: float, above: float, bits: float) -> bool:
        """above: the entropy less the least for the text's length."""
        band = self.rules.by_language.get(lang) or self.rules.by_script[script_of(text)]
        return band.chars_per_token[0] <= chars <= band.chars_per_token[1] and band.chars_per_byte_token[0] <= by_bytes <= band.chars_per_byte_token[1] and share <= band.byte_share and above >= band.more_bits and bits <= band.most_bits


_JUDGES: dict[str, Judge] = {}


def judge_for(rules: QualityRules) -> Judge:
    """One model a Python worker, however many batches it gets."""
    key = repr(rules)
    if key not in _JUDGES:
        _JUDGES[key] = Judge(rules)
    return _JUDGES[key]


def quality_metrics(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row a document: doc_id, counts, figures and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.cut(batches):
            yield C.made(METRICS, doc_id=part.column("doc_id").cast(pa.int64()), **judge_for(rules).judge(part))

    wanted = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    return docs.select(*wanted).mapInArrow(run, METRICS_SQL)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), short: Short | None = None) -> DataFrame:
    """The documents whose verdict is kept, with all their columns; with `short`, also those of few words that are within its bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.cut(batches):
            yield part.filter(pa.array(judge_for(rules).judge(part, short)["kept"]))

    return docs.mapInArrow(run, docs.schema)
