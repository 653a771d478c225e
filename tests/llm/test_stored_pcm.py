"""The resampled PCM that op9 stores."""

from __future__ import annotations

import hashlib

import numpy as np

from hazgrid.llm import media, queries


def test_query_stores_pcm_and_reads_it(spark, tmp_path, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["", None, "a", "x" * 70, "é" * 5000, "".join(map(chr, range(1, 200)))])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    names, written = [], queries.C.written
    monkeypatch.setattr(queries.C, "written", lambda df, name, **o: names.append((name, out := written(df, name, **o))) or out)
    got = queries.op9_telephony_media(spark, str(tmp_path)).collect()
    files = {x["doc_id"]: x for x in dict(names)["pcm"].collect()}
    assert len(got) == len(rows) == len(files)
    for x in got:
        f = files[x["doc_id"]]
        codec, rate, data = media.parse_wav(bytes(f["pcm"]))
        assert (codec, rate, len(data)) == (media.PCM, media.STORED_RATE, 4 * x["payload_bytes"])
        assert x["feature"].endswith(f"pcm16k={media.zlib.crc32(data):08x}")
        assert (x["media_bytes"], x["media_sha256"]) == (len(f["pcm"]), hashlib.sha256(bytes(f["pcm"])).hexdigest())
    # The payload and the features are those of the mu-law files.
    same = lambda rows: sorted((x["doc_id"], x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"], x["feature"]) for x in rows)
    assert same(got) == same(media.read_media(media.store_texts(queries.documents(spark, str(tmp_path)))).collect())


def test_every_byte_of_utf8_comes_back():
    data = bytes(range(255))
    samples = media.doubled(media.MU[np.frombuffer(data, np.uint8)])
    assert media.MU_BACK[samples[::2].astype(np.int64) + (1 << 15)].tobytes() == data
