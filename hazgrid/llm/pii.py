"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over the whole text and finds anchors: at-signs, schemes, plus
signs, digits and identifier cues. Local parsers expand each anchor to the span around it and validate
it. Every parser reads on from where its kind's last span ended, so a text is read a fixed number of times.

Kinds: email, ip, card, phone, then those beyond them: account (IBAN by its check digits, or the
identifier that a cue names), secret (what a key, token or password cue assigns), url (with user data,
or an address as host). Offsets are code points, ends exclusive.

A null text counts as empty and has no spans; masking leaves it null. Repeated rows get equal spans.
An empty table gives an empty table. Masking passes other columns through; where n_chars is a column,
it follows the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from hazgrid.llm import common as C

KINDS = ("email", "ip", "card", "phone", "account", "secret", "url")
BASE = KINDS[:4]
CUES = {
    "account": ("account", "acct", "iban", "konto", "cuenta", "compte", "passport", "customer id", "ssn", "tax id"),
    "secret": ("token", "api_key", "apikey", "api key", "secret", "password", "passwd", "access_key"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|nr\.?|id))?[\x20:=#]{1,3}((?:[A-Z]{0,4}-?)?[0-9](?:[\x20-]?[0-9]){5,})", re.I)
SECRET = re.compile(r"\x20?[:=]\x20?[\"']?([A-Za-z0-9+/_.-]{16,})")
URL = re.compile(r"(?:[^\s/@\"'<>?#]+@)?[^\s\"'<>]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, cues in CUES.items():
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    for mark in ("@", "+", "://"):
        a.add_word(mark, (mark, len(mark)))
    for digit in "0123456789":
        a.add_word(digit, ("digit", 1))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def iban_ok(x: str) -> bool:
    x = x.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def only_digits(x: str) -> str:
    return "".join(c for c in x if c in DIGITS)


def begins_word(text: str, at: int) -> bool:
    """Whether no letter or digit is before it, or a hump of a compound name begins there (accessToken)."""
    return at == 0 or not text[at - 1].isalnum() or (text[at - 1].islower() and text[at].isupper())


class Finder:
    def __init__(self):
        self.anchors = automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans, by kind as in KINDS, then by start."""
        at: dict[str, list[int]] = {"@": [], "+": [], "://": [], "run": [], "account": [], "secret": []}
        last = -2
        # Cues are in lower case; other letters than A-Z stay, so that offsets do.
        for end, (what, size) in self.anchors.iter(text.lower() if text.isascii() else text.translate(LOWER)):
            if what == "digit":
                if end != last + 1:  # the first digit of a run
                    at["run"].append(end)
                last = end
            elif what not in CUES:
                at[what].append(end + 1 - size)
            elif begins_word(text, end + 1 - size):
                at[what].append(end + 1)
        found: list[tuple[str, int, int]] = []
        if at["@"]:
            found += self.emails(text, at["@"])
        if at["run"]:
            found += self.matches("ip", IP, text, at["run"], lambda m: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.split(".")))
            found += self.matches("card", CARD, text, at["run"], lambda m: 13 <= len(d := only_digits(m)) <= 19 and luhn(d))
        if at["+"]:
            found += self.matches("phone", PHONE, text, at["+"], lambda m: 9 <= len(only_digits(m)) <= 15)
        if at["account"]:
            found += self.after_cue("account", ACCOUNT, text, at["account"])
        if at["secret"]:
            found += self.after_cue("secret", SECRET, text, at["secret"])
        if at["://"]:
            found += self.urls(text, at["://"])
        return found

    def emails(self, text: str, anchors: list[int]) -> list[tuple[str, int, int]]:
        out, end = [], 0
        for p in anchors:
            start = p
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < p and (m := DOMAIN.match(text, p + 1)):
                end = m.end()
                out.append(("email", start, end))
        return out

    def matches(self, kind, pattern, text, anchors, valid) -> list[tuple[str, int, int]]:
        out, end = [], 0
        for p in anchors:
            if p >= end and (m := pattern.match(text, p)):
                end = m.end()
                if valid(m.group()):
                    out.append((kind, p, end))
        return out

    def after_cue(self, kind, pattern, text, anchors) -> list[tuple[str, int, int]]:
        """What follows a cue: an IBAN that checks, or the cue's own pattern."""
        out, end = [], 0
        for p in anchors:
            if p < end:
                continue
            if kind == "account":
                q = p
                while q < min(len(text), p + 3) and text[q] in " :=#":
                    q += 1
                if (m := IBAN.match(text, q)) and iban_ok(m.group()):
                    end = m.end()
                    out.append((kind, q, end))
                    continue
            if m := pattern.match(text, p):
                end = m.end(1)
                out.append((kind, m.start(1), end))
        return out

    def urls(self, text: str, anchors: list[int]) -> list[tuple[str, int, int]]:
        out, end = [], 0
        for p in anchors:
            start = p
            while start > end and text[start - 1] in SCHEME:
                start -= 1
            if start < p and (m := URL.match(text, p + 3)):
                host = re.split(r"[/?#]", m.group(), maxsplit=1)[0]
                end = m.end()
                if "@" in host or IP.match(host):
                    out.append(("url", start, end))
        return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a mark like <EMAIL> for each span; overlapping spans become one, named for the first."""
    out, end = [], 0
    runs: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if runs and s < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], e)
        else:
            runs.append([kind, s, e])
    for kind, s, e in runs:
        out += [text[end:s], f"<{kind.upper()}>"]
        end = e
    return "".join([*out, text[end:]])


_FINDER: list[Finder] = []


def finder() -> Finder:
    if not _FINDER:
        _FINDER.append(Finder())
    return _FINDER[0]


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, how many spans of each base kind, their digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder()
        for part in C.cut(batches):
            every = [f.spans(t) for t in C.texts(part).to_pylist()]
            base = [[x for x in spans if x[0] in BASE] for spans in every]
            yield C.made(
                FOUND, doc_id=part.column("doc_id").cast(pa.int64()), base_sha256=[hashlib.sha256(joined(x).encode()).hexdigest() for x in base], spans=[joined(x) for x in every],
                **{f"n_{k}": [sum(x[0] == k for x in spans) for spans in base] for k in BASE},
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask_pii(docs: DataFrame) -> DataFrame:
    """The documents with all spans masked; other columns as they are, n_chars after the new text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder()
        for part in C.cut(batches):
            new = [t if t is None else masked(t, f.spans(t)) for t in part.column("text").to_pylist()]
            columns = list(part.columns)
            names = part.schema.names
            columns[names.index("text")] = pa.array(new, part.schema.field("text").type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in new]).cast(part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
