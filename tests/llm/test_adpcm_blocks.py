"""ADPCM files of other block sizes and rates."""

from __future__ import annotations

import struct

import numpy as np

from hazgrid.llm import media
from tests.llm.test_media import ima_brute


def ima_file(data, align, bits=4, rate=8000):
    f = bytearray(media.wav(media.IMA, data, rate))
    struct.pack_into("<HH", f, 32, align, bits)
    return bytes(f)


def test_blocks_of_the_files_size():
    data = np.random.default_rng(3).integers(0, 256, 1000).astype(np.uint8).tobytes()
    cases = [(data, 256), (data[:640], 64), (data[:130], 64), (data[:768], 256), (data[:30], 64), (data, 36), (b"", 64)]
    got = media.decode_all([ima_file(d, a) for d, a in cases])
    for (d, a), x in zip(cases, got, strict=True):
        blocks = [d[k : k + a] for k in range(0, len(d), a)]
        assert x.tolist() == [v for b in blocks if len(b) >= 4 for v in ima_brute(b)], (len(d), a)
    assert media.decode_all([ima_file(data, 4), ima_file(data, 0), ima_file(data, 64, bits=3)]) == [None] * 3


def test_other_rates_have_no_stored_pcm(spark):
    rows = [(1, media.wav(media.MULAW, b"ab")), (2, media.wav(media.MULAW, b"ab", 16000)), (3, ima_file(bytes(300), 256)), (4, ima_file(bytes(64), 64, rate=16000))]
    got = {x["id"]: x["pcm"] for x in media.store_pcm(spark.createDataFrame(rows, "id long, media binary"), "media").collect()}
    assert [i for i in got if got[i] is None] == [2, 4] and len(media.parse_wav(bytes(got[3]))[2]) == 4 * (505 + 81)
