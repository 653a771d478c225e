from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np

from hazgrid.llm import media


def test_tables_have_known_values():
    # Ends, centre and a middle of either law, as G.711 gives them.
    assert [int(media.MU[i]) for i in (0x00, 0x7F, 0x80, 0xFF, 0x10)] == [-32124, 0, 32124, 0, -15996]
    assert [int(media.A[i]) for i in (0x55, 0xD5, 0x2A, 0xAA, 0x80)] == [-8, 8, -32256, 32256, 5504]
    assert len(set(media.A.tolist())) == 256 and len(set(media.MU.tolist())) == 255


def ima_brute(block):
    now, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for b in block[4:]:
        for code in (b & 15, b >> 4):
            step = int(media.STEPS[index])
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                move += part if code & bit else 0
            now = max(-32768, min(32767, now - move if code & 8 else now + move))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(now)
    return out


def test_ima_blocks_decode_side_by_side():
    r = np.random.default_rng(2)
    blocks = r.integers(0, 256, (50, media.BLOCK)).astype(np.uint8)
    assert media.decode_ima(blocks).tolist() == [ima_brute(b.tobytes()) for b in blocks]


def test_files_round_trip_and_bad_ones_are_none():
    for codec, data in ((media.PCM, b"abcd"), (media.MULAW, b"abc"), (media.ALAW, b"\0\xff"), (media.IMA, bytes(64))):
        assert media.parse_wav(media.wav(codec, data)) == (codec, media.RATE, data)
    good = media.wav(media.MULAW, b"x" * 10)
    for bad in (None, b"", b"RIFF", good[:20], good[:50], b"X" + good[1:]):
        assert media.parse_wav(bad) is None
    assert media.decode_all([None, good])[0] is None


def test_query(spark):
    r = random.Random(4)
    rows = [(i, t) for i, t in enumerate(["", None, "a", "x" * 64, "y" * 65, "é" * 100000, "same", "same", *("".join(chr(r.randrange(1, 0x800)) for _ in range(r.randrange(300))) for _ in range(40))])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, media string").repartition(3)
    got = {x["doc_id"]: x for x in media.read_media(media.C.written(media.store_texts(docs), "media")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        x = got[i]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        file = media.wav(media.MULAW, payload)
        assert (x["media_bytes"], x["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        ima = np.concatenate([ima_brute(payload[k : k + 64]) for k in range(0, min(len(payload), 6400), 64)])
        if len(payload) <= 6400:
            assert f"ima={np.abs(ima).max()}/{(ima**2).sum() // len(ima)}/" in x["feature"]
    assert tuple(got[6])[1:] == tuple(got[7])[1:] and tuple(got[0])[1:] == tuple(got[1])[1:]
    stored = media.store_pcm(media.store_texts(docs), "media").collect()
    codec, rate, data = media.parse_wav(next(bytes(x["pcm"]) for x in stored if x["doc_id"] == 2))
    assert (codec, rate, len(data)) == (media.PCM, media.STORED_RATE, 4 * 64) and np.frombuffer(data, "<i2")[0] == media.MU[ord("a")]
    assert media.store_texts(docs.limit(0)).count() == 0 and media.read_media(media.store_texts(docs.limit(0))).count() == 0
