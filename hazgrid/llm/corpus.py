"""A corpus in blocks with fixed row numbers, and the exchange of hashed keys between its blocks.

Operators that look for repeats read the texts several times. `corpus_of` writes them once to the shared folder. Equal texts are
found by their digests: one of them stands for all, and knows whether there are more. Those that stand for others are cut into blocks: runs of
rows of a file with a bounded number of bytes (or one longer text), whatever the number of rows. A text is (block, row) ever after, and a task holds a block at a time.

In an exchange every block sends its distinct keys, sorted, once each and with how often it has them, in parts by the keys' leading
bits. A key that a third of all texts hold is therefore one entry of each block, not one of each text. Who counts a part answers each block with one
byte for each key that it sent, in order: how many times all blocks have it, 255 at most. Blocks compute their keys again and read the answers by place.

Parts follow the bytes of keys, not the number of blocks, and tasks take several blocks, so tasks on either side grow as the input over a
fixed number of bytes. Each part is cut into slices of the keys again, which are unpacked one after another: a task holds a part packed, and one slice in arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazgrid.llm import common as C

U = np.uint64


@dataclass(frozen=True)
class Sizes:
    """Bytes: of texts in a block and of blocks that a task takes, of packed keys in a part and in a slice of it."""

    block: int = 16 << 20
    task: int = 128 << 20
    part: int = 64 << 20
    slice: int = 8 << 20


@dataclass(frozen=True)
class Corpus:
    folder: str
    rows: DataFrame  # doc_id, digest: each document
    texts: DataFrame  # block, file, row, digest, many, tid (a number, fixed once written): each text that stands for its equals
    n_blocks: int
    n_bytes: int
    sizes: Sizes

    def parts(self, share: float) -> int:
        """Parts for so many bytes of keys for a byte of text."""
        return max(2 * C.partitions(self.rows.sparkSession), -(-int(self.n_bytes * share) // self.sizes.part))

    def slices(self, share: float) -> int:
        return max(1, -(-int(self.n_bytes * share) // (self.sizes.slice * self.parts(share))))


def corpus_of(docs: DataFrame, name: str = "texts", sizes: Sizes = Sizes()) -> Corpus:
    spark = docs.sparkSession
    folder = C.fresh_path(spark, name)
    text = F.coalesce(docs["text"], F.lit(""))
    # Row groups as large as a block, so that a block reads little besides itself.
    options = {"compression": "zstd", "maxRecordsPerFile": 1 << 16, "parquet.block.size": sizes.block, "parquet.page.size.row.check.min": 8}
    docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).write.options(**options).parquet(folder)
    kept = spark.read.schema("doc_id long, text string").parquet(folder)
    rows = C.written(kept.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")), f"{name}-rows")
    texts = rows.groupBy("digest").agg(F.min(F.struct("file", "row")).alias("at"), (F.count("*") > 1).alias("many"), F.first("n_bytes").alias("n_bytes")).select("at.file", "at.row", "digest", "many", "n_bytes")
    n_bytes = rows.agg(F.sum("n_bytes")).first()[0] or 0
    # Small inputs are cut finer, for as many tasks as the session wants.
    most = min(sizes.block, max(1 << 20, n_bytes // (2 * C.partitions(spark))))
    before = F.sum("n_bytes").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))  # a file has 2^16 rows at most
    block = F.concat_ws("#", "file", F.floor(F.coalesce(before, F.lit(0)) / most).cast("string"))
    texts = C.written(texts.withColumn("block", block).withColumn("tid", F.monotonically_increasing_id()), f"{name}-distinct")
    return Corpus(folder, rows.select("doc_id", "digest"), texts, texts.agg(F.count_distinct("block")).first()[0], n_bytes, sizes)


@dataclass
class Part:
    """Some texts of a block."""

    begin: int  # the block's texts before
    rows: np.ndarray
    many: np.ndarray
    digests: pa.Array
    tids: np.ndarray
    text: pa.StringArray


class Block:
    """Texts of a file that stand for their equals."""

    def __init__(self, folder: str, table: pa.Table):
        table = table.sort_by("row")
        self.name, self.file = table["block"][0].as_py(), table["file"][0].as_py()
        self.rows, self.many = table["row"].to_numpy(), table["many"].to_numpy(zero_copy_only=False)
        self.digests, self.tids, self.folder = table["digest"].combine_chunks(), table["tid"].to_numpy(), folder

    def parts(self, most: int = 1 << 20) -> Iterator[Part]:
        fs, root = C.filesystem(self.folder)
        with fs.open_input_file(f"{root}/{self.file}") as f:
            file, base, done = pq.ParquetFile(f), 0, 0
            for group in range(file.num_row_groups):
                n = file.metadata.row_group(group).num_rows
                if base + n <= self.rows[0]:
                    base += n
                    continue
                for batch in file.iter_batches(batch_size=512, row_groups=[group], columns=["text"]):
                    end = int(np.searchsorted(self.rows, base + batch.num_rows))
                    mine = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(self.rows[done:end] - base))], names=["text"])
                    at = done
                    for piece in C.cut(iter([mine]), most=most):
                        n = piece.num_rows
                        yield Part(at, self.rows[at : at + n], self.many[at : at + n], self.digests.slice(at, n), self.tids[at : at + n], C.texts(piece))
                        at += n
                    base, done = base + batch.num_rows, end
                    if done == len(self.rows):
                        return


def each_block(corpus: Corpus, run: Callable[[Block], Iterator[pa.Table] | pa.Table], schema: str, answers: DataFrame | None = None) -> DataFrame:
    """run(block), or run(block, its answers), for every block."""
    # Numbers of partitions are set, since AQE would join them by their few bytes; what a block costs is its texts.
    n = min(4 * corpus.n_blocks, max(4 * C.partitions(corpus.rows.sparkSession), -(-corpus.n_bytes // corpus.sizes.task))) or 1
    folder, blocks = corpus.folder, corpus.texts.select("block", "file", "row", "digest", "many", "tid").repartition(n, "block").groupBy("block")
    if answers is None:
        return blocks.applyInArrow(lambda t: run(Block(folder, t)), schema)
    empty = C.arrow_schema(schema).empty_table()
    return blocks.cogroup(answers.repartition(n, "block").groupBy("block")).applyInArrow(lambda t, a: run(Block(folder, t), a) if t.num_rows else empty, schema)


def packed(keys: np.ndarray, check: np.ndarray | None, counts: np.ndarray) -> bytes:
    """Sorted keys as differences of as few bytes as the largest needs."""
    steps = np.diff(keys, prepend=U(0))
    first, steps[0] = int(steps[0]), 0
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    head = np.array([len(keys), first, width, check is not None], U).tobytes()
    return head + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + (b"" if check is None else check.astype("<u4").tobytes()) + counts.astype(np.uint8).tobytes()


def unpacked(blob) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    n, first, width, has = (int(x) for x in np.frombuffer(blob, U, 4))
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, 32).reshape(n, width)
    steps = raw.view("<u8").reshape(-1).copy()
    steps[0] = first
    check = np.frombuffer(blob, "<u4", n, 32 + n * width) if has else None
    return np.cumsum(steps, dtype=U), check, np.frombuffer(blob, np.uint8, n, 32 + n * width + 4 * n * has)


def distinct(keys: np.ndarray, check: np.ndarray | None, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Sorted distinct (key, check), the summed counts (255 at most), and each input's place among them."""
    order = np.argsort(keys, kind="stable") if check is None else np.lexsort((check, keys))
    k, c = keys[order], None if check is None else check[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    if c is not None and len(k):
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    total = np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return k[first], None if c is None else c[first], np.minimum(total, 255), place


def bounds(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each part begins in sorted keys of so many bits, and the end."""
    top = (keys >> U(bits - 32)) if bits > 32 else keys << U(32 - bits)
    part = (top * U(parts)) >> U(32)
    return np.searchsorted(part, np.arange(parts + 1).astype(U))


ANSWERS = "block string, part long, answer binary"


def exchanged(corpus: Corpus, keys_of: Callable[..., tuple[np.ndarray, np.ndarray | None, np.ndarray]], bits: int = 64, answers: DataFrame | None = None, share: float = 1.0) -> DataFrame:
    """block, part, answer: for what keys_of(block), or keys_of(block, its earlier answers), gives, sorted and distinct as from `distinct`.
    share: about how many bytes of packed keys there are for a byte of text."""
    parts, slices = corpus.parts(share), corpus.slices(share)

    def send(block: Block, *earlier: pa.Table) -> pa.Table:
        keys, check, counts = keys_of(block, *earlier)
        at = bounds(keys, parts * slices, bits)
        full = [p for p in range(parts) if at[(p + 1) * slices] > at[p * slices]]
        blobs = []
        for p in full:
            edges = at[p * slices : (p + 1) * slices + 1].tolist()
            cut = [packed(keys[a:b], None if check is None else check[a:b], counts[a:b]) if b > a else b"" for a, b in zip(edges[:-1], edges[1:], strict=True)]
            blobs.append(np.array([len(x) for x in cut], U).tobytes() + b"".join(cut))
        return pa.table({"part": pa.array(full, pa.int64()), "block": pa.array([block.name] * len(full), pa.string()), "blob": pa.array(blobs, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        blobs = [memoryview(x.as_buffer()) for x in table["blob"]]
        sizes = np.array([np.frombuffer(b, U, slices) for b in blobs]).astype(np.int64).reshape(-1, slices)
        ends = 8 * slices + np.cumsum(sizes, axis=1)
        replies: list[list[bytes]] = [[] for _ in blobs]
        for k in range(slices):
            mine = np.flatnonzero(sizes[:, k]).tolist()
            sent = [unpacked(blobs[i][ends[i, k] - sizes[i, k] : ends[i, k]]) for i in mine]
            if not sent:
                continue
            check = None if sent[0][1] is None else np.concatenate([s[1] for s in sent])
            _, _, total, place = distinct(np.concatenate([s[0] for s in sent]), check, np.concatenate([s[2] for s in sent]))
            reply = total[place].astype(np.uint8)
            for i, x in zip(mine, np.split(reply, np.cumsum([len(s[0]) for s in sent])[:-1]), strict=True):
                replies[i].append(x.tobytes())
        return pa.table({"block": table["block"], "part": table["part"], "answer": pa.array([zlib.compress(b"".join(x), 1) for x in replies], pa.binary())})

    return each_block(corpus, send, "part long, block string, blob binary", answers).repartition(parts, "part").groupBy("part").applyInArrow(count, ANSWERS)


def answered(answers: pa.Table) -> np.ndarray:
    """The counts for a block's keys, in the order of the keys."""
    order = np.argsort(answers["part"].to_numpy())
    blobs = answers["answer"].to_pylist()
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(zlib.decompress(blobs[i]), np.uint8) for i in order)])


def by_document(corpus: Corpus, results: DataFrame) -> DataFrame:
    """Results by digest for every document; small rows, and AQE splits the digest of a large group of copies."""
    return corpus.rows.join(results, "digest").drop("digest")
