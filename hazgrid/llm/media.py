"""Telephony audio in a media column.

Stored forms are RIFF/WAVE files of mono 8 kHz audio: 16-bit PCM, mu-law and A-law (8-bit samples), or
IMA ADPCM (blocks of 64 bytes where `wav` writes them, else of the size that the file gives). mu-law and A-law expand by lookup tables of 256 samples. ADPCM blocks
carry their own start values, so they decode side by side: one numpy step for each nibble, over all blocks of all
files of a batch. `store_pcm` keeps what telephony files decode to as resampled PCM files.

A payload is a text's UTF-8 bytes with zero bytes up to a positive multiple of 64, kept as mu-law
samples, one byte each, so it reads back bit by bit: from a mu-law file, or from its resampled PCM, of which every other sample is one of the file's. Null texts count as empty (64 zero bytes). Equal texts
have equal files and features. A file that can't be parsed gives null samples, one of another rate than 8 kHz null PCM; an empty table an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazgrid.llm import common as C

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
BLOCK = 64  # bytes of an ADPCM block: 4 of header, 60 with two samples each
PER_BLOCK = 2 * (BLOCK - 4) + 1
RATE, STORED_RATE = 8000, 16000
#: For tables of media, whose rows are large: batches to Python by bytes and Parquet read by rows, as two or three copies of each are held at once; row groups that a writer holds.
SMALL_READS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.enableVectorizedReader": "false"}
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
# Fixed values of the IMA ADPCM format.
STEP_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    """G.711: complemented sign, segment and step; bias 132."""
    x = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((x & 15) << 3) + 132 << ((x >> 4) & 7)) - 132
    return np.where(x & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711: even bits inverted; the first segment is linear."""
    x = np.arange(256, dtype=np.int32) ^ 0x55
    step, segment = (x & 15) << 4, (x >> 4) & 7
    size = np.where(segment == 0, step + 8, (step + 264) << np.maximum(segment - 1, 0))
    return np.where(x & 128, size, -size).astype(np.int16)


MU, A = mulaw_table(), alaw_table()
#: The mu-law sample of each 16-bit value that one stands for, by value + 2^15. Both zeros expand to 0; it gives 0x7F, as 0xFF is in no UTF-8 text.
MU_BACK = np.zeros(1 << 16, np.uint8)
MU_BACK[MU[:255].astype(np.int64) + (1 << 15)] = np.arange(255)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks of one size: (n, 64) bytes to (n, 121) samples, all blocks at each step."""
    low, high = blocks[:, 0].astype(np.int32), blocks[:, 1].astype(np.int32)
    now = ((low | high << 8) ^ 0x8000) - 0x8000
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    per_block = 2 * (blocks.shape[1] - 4) + 1
    out = np.empty((per_block, len(blocks)), np.int16)
    out[0] = now
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(per_block - 1):
        code = (body[k >> 1] >> (4 * (k & 1))) & 15
        step = STEPS[index]
        move = step >> 3
        move += np.where(code & 4, step, 0)
        move += np.where(code & 2, step >> 1, 0)
        move += np.where(code & 1, step >> 2, 0)
        now = np.clip(np.where(code & 8, now - move, now + move), -32768, 32767)
        index = np.clip(index + STEP_MOVES[code & 7], 0, 88)
        out[k + 1] = now
    return out.T


def doubled(x: np.ndarray) -> np.ndarray:
    """8 to 16 kHz: each sample, and the mean (rounded down) of it and the next; the last is held."""
    out = np.empty(2 * len(x), np.int16)
    out[::2] = x
    if len(x):
        out[1:-1:2] = (x[:-1].astype(np.int32) + x[1:]) >> 1
        out[-1] = x[-1]
    return out


def wav(codec: int, data: bytes, rate: int = RATE) -> bytes:
    bits, align, extra = {PCM: (16, 2, b""), ALAW: (8, 1, b"\0\0"), MULAW: (8, 1, b"\0\0"), IMA: (4, BLOCK, struct.pack("<HH", 2, PER_BLOCK))}[codec]
    per_s = rate * BLOCK // PER_BLOCK if codec == IMA else rate * align
    fmt = struct.pack("<HHIIHH", codec, 1, rate, per_s, align, bits) + extra
    count = {PCM: len(data) // 2, IMA: len(data) // BLOCK * PER_BLOCK}.get(codec, len(data))
    fact = b"" if codec == PCM else struct.pack("<4sII", b"fact", 4, count)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(file: bytes | None) -> tuple[int, int, bytes] | None:
    """Codec, rate and data of a mono file; None if it isn't one."""
    if not file or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        return None
    at, codec, rate = 12, None, 0
    while at + 8 <= len(file):
        name, size = struct.unpack_from("<4sI", file, at)
        if at + 8 + size > len(file):
            return None
        if name == b"fmt " and size >= 16:
            codec, channels, rate = struct.unpack_from("<HHI", file, at + 8)
            if channels != 1 or codec not in (PCM, ALAW, MULAW, IMA):
                return None
        elif name == b"data" and codec is not None:
            return codec, rate, file[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return None


def block_of(file: bytes) -> int | None:
    """The bytes of an ADPCM block of a file that `parse_wav` takes; None if its format isn't 4 bits in blocks with a header."""
    at = 12
    while file[at : at + 4] != b"fmt ":
        size = struct.unpack_from("<I", file, at + 4)[0]
        at += 8 + size + (size & 1)
    align, bits = struct.unpack_from("<HH", file, at + 20)
    return align if bits == 4 and align > 4 else None


def decode_all(files: list[bytes | None]) -> list[np.ndarray | None]:
    """16-bit samples of each file; ADPCM blocks of all files together."""
    parsed = [parse_wav(f) for f in files]
    out: list[np.ndarray | None] = [None] * len(files)
    # Blocks by their size: whole ones, and what a file's last one holds.
    cut: dict[int, list[tuple[int, bytes]]] = {}
    for i, p in enumerate(parsed):
        if p and p[0] == IMA and (size := block_of(files[i])):
            out[i] = np.zeros(0, np.int16)
            whole = len(p[2]) // size * size
            for n, d in ((size, p[2][:whole]), (len(p[2]) - whole, p[2][whole:])):
                if d and n >= 4:
                    cut.setdefault(n, []).append((i, d))
    pieces: dict[int, list[tuple[int, np.ndarray]]] = {}
    for n, held in cut.items():
        samples = decode_ima(np.frombuffer(b"".join(d for _, d in held), np.uint8).reshape(-1, n))
        row = 0
        for i, d in held:
            # A file's shorter block is its last one, so the longer goes first.
            pieces.setdefault(i, []).append((-n, samples[row : (row := row + len(d) // n)].reshape(-1)))
    for i, held in pieces.items():
        held.sort(key=lambda x: x[0])
        out[i] = held[0][1] if len(held) == 1 else np.concatenate([x for _, x in held])
    for i, p in enumerate(parsed):
        if p and p[0] != IMA:
            out[i] = np.frombuffer(p[2][: len(p[2]) // 2 * 2], "<i2") if p[0] == PCM else (MU if p[0] == MULAW else A)[np.frombuffer(p[2], np.uint8)]
    return out


def pcm_of(files: list[bytes | None]) -> list[bytes | None]:
    """16 kHz PCM files of telephony files."""
    # Only telephony's rate is doubled to the stored one; other files give None.
    decoded = [x if x is not None and parse_wav(f)[1] == RATE else None for f, x in zip(files, decode_all(files), strict=True)]
    return [None if x is None else wav(PCM, doubled(x).astype("<i2").tobytes(), STORED_RATE) for x in decoded]


def store_pcm(df: DataFrame, column: str, out: str = "pcm") -> DataFrame:
    """df with its telephony files also as 16 kHz PCM files in the column `out` (which replaces one of that name)."""
    schema = df.select("*").withColumn(out, df[column]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.cut(batches, column):
            kept = {n: part.column(n) for n in part.schema.names} | {out: pa.array(pcm_of(part.column(column).to_pylist()), pa.binary())}
            yield pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))

    return df.mapInArrow(run, schema)


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))


def store_texts(docs: DataFrame, pcm: bool = False) -> DataFrame:
    """doc_id, the text's length in bytes, and its payload as a mu-law file in the column media, or in its place the column pcm that `store_pcm` would make of it: one
    pass, so a task has one Python worker and the mu-law files never leave it."""
    column = "pcm" if pcm else "media"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.cut(batches):
            raw = C.texts(part).cast(pa.binary()).to_pylist()
            files = [wav(MULAW, payload_of(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(pcm_of(files) if pcm else files, pa.binary())], names=["doc_id", "n_bytes", column])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_bytes long, {column} binary")


READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def figures(x: np.ndarray) -> str:
    """Peak, energy a sample and sign changes, in whole numbers."""
    y = x.astype(np.int64)
    return f"{int(np.abs(y).max())}/{int((y * y).sum() // len(y))}/{int(((y[1:] < 0) != (y[:-1] < 0)).sum())}"


def read_media(media: DataFrame) -> DataFrame:
    """Digests of the stored files, of the payloads read back, and features: of the decoded mu-law samples, of
    the payload read as A-law and as ADPCM blocks, and the checksum of the resampled PCM. The stored files are those of a column pcm, where
    there is one (as `store_pcm` makes it from what `store_texts` gives), else the mu-law files of the column media."""
    column = "pcm" if "pcm" in media.columns else "media"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.cut(batches, column, 4 << 20 if column == "pcm" else 1 << 20):
            files = part.column(column).to_pylist()
            samples = decode_all(files)
            if column == "pcm":
                pcm, as_mu = [x.tobytes() for x in samples], [x[::2] for x in samples]
                data = [MU_BACK[x.astype(np.int64) + (1 << 15)].tobytes() for x in as_mu]
            else:
                as_mu, data = samples, [parse_wav(f)[2] for f in files]
                pcm = [doubled(x).astype("<i2").tobytes() for x in as_mu]
            as_a = decode_all([wav(ALAW, d) for d in data])
            as_ima = decode_all([wav(IMA, d) for d in data])
            feature = [f"rate={RATE};mu={figures(m)};a={figures(a)};ima={figures(i)};pcm16k={zlib.crc32(p):08x}" for m, a, i, p in zip(as_mu, as_a, as_ima, pcm, strict=True)]
            yield C.made(
                READ, doc_id=part.column("doc_id"), n_bytes=part.column("n_bytes"), payload_bytes=[len(d) for d in data], payload_sha256=[hashlib.sha256(d).hexdigest() for d in data], tail_crc32=[zlib.crc32(d[-64:]) for d in data],
                media_bytes=[len(f) for f in files], media_sha256=[hashlib.sha256(f).hexdigest() for f in files], feature=feature,
            )

    return media.select("doc_id", "n_bytes", column).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
