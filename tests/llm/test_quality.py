from __future__ import annotations

import re
from collections import Counter

import pytest

from hazgrid.llm import quality

sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("tokenizers")
PROSE = "It was late in the year when the two of them set out along the river, and nobody in the village thought that they would be back before the snow. They carried little: bread, a lamp, some rope and the old map that her uncle had drawn. By noon the road had narrowed to a path, and the path to a line of stones between the reeds."
TEXTS = {
    1: PROSE, 2: PROSE + "\n" + PROSE, 3: "", 4: None, 5: " \n\t", 6: "short text", 7: "The " * 400, 8: "a b c a b c " * 20, 9: "x\n x \ny\nx\n\n\nx\n" * 10, 10: "#$%& <|> *" * 30,
    11: " ".join(f"{c}%%%" for c in PROSE.split()), 12: "word " * 20000, 13: "私は昨日友達と一緒に公園へ行きました。" * 60, 14: " ".join("ξκλμν οπρστ υφχψω αβγδε"[i % 19 : i % 19 + 5] for i in range(300)), 15: PROSE,
}


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    gone = {j for i in range(len(w) - 2) if at[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(gone)


def test_metrics_equal_brute_force(spark):
    rows = [(i, t, {13: "ja", 14: None}.get(i, "en"), "clash") for i, t in TEXTS.items()]
    docs = spark.createDataFrame([*rows, (None, PROSE, "en", "x")], "doc_id long, text string, lang string, kept string").repartition(3)
    got = {x["doc_id"]: x for x in quality.quality_metrics(docs).collect()}
    library = tokenizers.Tokenizer.from_file(quality.QualityRules().byte_tokenizer)
    model = sentencepiece.SentencePieceProcessor(model_file=quality.QualityRules().tokenizer)
    for i, t in TEXTS.items():
        x, (n, chars, symbols, dup, repeat) = got[i], brute(t)
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (n, chars, symbols, dup, repeat), i
        assert x["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and not (x["base_failed"] and x["kept"])
        assert x["chars_per_byte_token"] == pytest.approx(chars / max(1, len(library.encode(t or "", add_special_tokens=False).ids)))
        assert x["n_tokens"] == len(model.encode(t or "")) and x["chars_per_token"] == pytest.approx(chars / max(1, x["n_tokens"]))
    assert got[1]["kept"] and got[15]["kept"] and got[None]["kept"] and not got[7]["kept"] and not got[12]["kept"]
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and sorted(x["doc_id"] or 0 for x in good.collect()) == sorted(i or 0 for i, x in got.items() if x["kept"])
    assert quality.quality_metrics(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0
    assert quality.quality_metrics(docs.drop("lang")).count() == len(rows) + 1


def test_scripts():
    assert [quality.script_of(t) for t in ("abc é", "日本", "αβγ", "", "abc 日本語文")] == ["latin", "cjk", "other", "latin", "cjk"]
