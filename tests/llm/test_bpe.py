from __future__ import annotations

import hashlib
import json
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from hazgrid.llm import bpe, token_files

tokenizers = pytest.importorskip("tokenizers")
HARD = [
    "", " ", "  ", "\n\n a\t\r\n b  ", "it's we'll I'VE don't ''s 's", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "=" * 3000, "\x00\x1c\x1d\x1e\x1f\x85\xa0 x", "日本語のテキスト。漢字", "🙂🙃 é ﬁ ​ ", "a<|endoftext|>b", "<|endoftext|><|endoftext|> ",
    "<|endoftext", " lead", "trail ", "a \nb", "a\n b", "a\n\n b", "a  b", "a   b", " 's 're", "x\u3000 y", "x \u3000y", "\n a", "a<|endoftext|> b  c", "123 4567 89a0", "x" * 5000 + " " + "ab" * 3000, "".join(chr(c) for c in range(0x20, 0x3000)),
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.BYTE_BPE)


def texts():
    r = random.Random(3)
    return HARD + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 0x250), r.randrange(0x20, 0xD7FF), 32, 10])) for _ in range(r.randrange(200))) for _ in range(300)]


@pytest.mark.parametrize("with_library", [False, True])
def test_ids_equal_the_librarys(library, with_library):
    e, t = bpe.Encoder(library=with_library), texts()
    ids, ends = e.encode(t)
    for x, a, b in zip(t, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(x, add_special_tokens=False).ids, x[:80]
    assert e.decode(ids, ends) == [library.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_other_files_are_refused(tmp_path):
    spec = json.loads(Path(bpe.BYTE_BPE).read_text(encoding="utf-8"))
    cut = spec["pre_tokenizer"]
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": cut | {"add_prefix_space": True}}, {"pre_tokenizer": cut | {"use_regex": False}}, {"pre_tokenizer": None}, {"model": spec["model"] | {"end_of_word_suffix": "</w>"}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError, match="plain byte-level"):
            bpe.Vocabulary(str(other))


def test_a_full_cache_forgets():
    e, t = bpe.Encoder(most_chunks=6, most_chars=90), texts()
    want = bpe.Encoder()
    for k in range(0, len(t), 7):
        got, want_now = e.encode(t[k : k + 7]), want.encode(t[k : k + 7])
        assert got[0].tolist() == want_now[0].tolist() and got[1].tolist() == want_now[1].tolist()
    want = want.encode(["one two three four", "five one"])
    for _ in range(2):
        got = e.encode(["one two three four", "five one"])
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def rows(spark):
    t = [*texts()[:60], None, "same", "same"]
    r = [(i if i % 7 else 900 + i, x, "clash") for i, x in enumerate(t)]
    return r, spark.createDataFrame(r, "doc_id long, text string, ids string").repartition(5)


def test_round_trip_query(spark, library):
    r, docs = rows(spark)
    got = {x["doc_id"]: x for x in bpe.round_trip(docs).collect()}
    assert len(got) == len(r)
    for i, t, _ in r:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    again = bpe.encode_documents(docs).collect()
    assert {x["doc_id"]: x["ids"] for x in again} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in r}
    assert bpe.round_trip(docs.limit(0)).count() == 0


@pytest.mark.parametrize("layout", [token_files.Layout(), token_files.Layout(length=8, batch=3)])
def test_files_give_every_run(spark, library, tmp_path, layout):
    r, docs = rows(spark)
    docs = docs.union(spark.createDataFrame([(None, "no id", "x")], docs.schema))
    shards = token_files.write_shards(docs, str(tmp_path / "t"), layout)
    got = token_files.read_shards(spark, str(tmp_path / "t"), shards).collect()
    at = 0
    for x, (i, t, _) in zip(sorted(got, key=lambda x: (x["doc_id"] is not None, x["doc_id"])), [(None, "no id", ""), *sorted(r, key=lambda x: x[0])], strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    fs, root = token_files.C.filesystem(str(tmp_path / "t"))
    shard = token_files.Shard(fs, f"{root}/shard-{shards[0][0]:05d}.arrow")
    ids, mask = shard.sequence(0)
    assert ids.base is not None and len(ids) == layout.length == len(mask) and ids.tolist() == shard.run(0, layout.length).tolist() if shards[0][2] >= layout.length else True
    assert token_files.write_shards(docs.limit(0), str(tmp_path / "none"), layout) == [] and token_files.read_shards(spark, str(tmp_path / "none"), []).count() == 0
