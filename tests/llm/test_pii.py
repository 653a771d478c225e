from __future__ import annotations

import hashlib
import random
import re

from hazgrid.llm import pii

BRUTE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub(r"[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
}


def luhn(d):
    return sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in BRUTE.items() for m in re.finditer(p, text) if ok(m.group())]


def texts():
    r = random.Random(1)
    out = ["", None, "é 🙂 a.b@c.de, x@y 1.2.3.4 4111 1111 1111 1111 +1 (555) 123-4567", "a@b.c.@d.e", "a@b@c.d", "x@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0004", "+1+22222222222 +1 ( 2", "1..2.3.4.5", "@" * 50, "9" * 5000, "1." * 3000, "+1" + " " * 3000, "a" * 5000 + "@" + "b." * 3000 + "c"]
    for alphabet in ("ab1.@-+ ", "0123456789.", "0123456789 -", "+0123456789 ().-", "a@.é1"):
        out += ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(800)]
    return out


def test_base_spans_equal_the_patterns():
    f = pii.Finder()
    for t in texts():
        assert [s for s in f.spans(t or "") if s[0] in pii.BASE] == brute(t or ""), t
    assert sum(len(brute(t or "")) for t in texts()) > 300


def test_cues_and_schemes():
    f = pii.Finder()
    found = lambda t: [(k, t[a:b]) for k, a, b in f.spans(t) if k not in pii.BASE]
    assert not pii.iban_ok("DE89 3702 0044 0532 0130 00") and found("see DE89 3704 0044 0532 0130 00") == []
    assert found("pay to IBAN: DE89 3704 0044 0532 0130 00 now") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("account number 12-345678 is his") == [("account", "12-345678")] and found("on that account 12 of them") == []
    assert found('token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B".') == [("secret", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B")]
    assert found("see https://example.com/a?b or ftp://me:pw@host/x, http://10.0.0.1/x") == [("url", "ftp://me:pw@host/x,"), ("url", "http://10.0.0.1/x")]


def test_query_and_mask(spark):
    rows = [(i, t, "en", None if t is None else len(t)) for i, t in enumerate(texts()[:400])] + [(None, "a@b.cd", None, 6), (3, "same@x.yz", "en", 9), (3, "same@x.yz", "en", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long").repartition(3)
    got = sorted(((x["doc_id"] or -1), x["n_email"], x["n_ip"], x["n_card"], x["n_phone"], x["base_sha256"]) for x in pii.find_pii(docs).collect())
    want = []
    for i, t, _, _ in rows:
        base = brute(t or "")
        want.append((i or -1, *(sum(s[0] == k for s in base) for k in BRUTE), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    assert got == sorted(want)
    masked = pii.mask_pii(docs)
    assert masked.schema == docs.schema
    for x in masked.collect():
        assert (x["text"] is None) == (x["n_chars"] is None) and (x["text"] is None or len(x["text"]) == x["n_chars"])
        assert x["text"] is None or not re.search(BRUTE["email"][0], x["text"])
    assert pii.find_pii(docs.limit(0)).count() == 0
    assert pii.masked("to a@b.cd, 1.2.3.4!", pii.Finder().spans("to a@b.cd, 1.2.3.4!")) == "to <EMAIL>, <IP>!"
