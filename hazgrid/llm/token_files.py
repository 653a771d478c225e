"""Token ids in Arrow files of fixed-size lists.

A shard is two Arrow files (the stream format, framed by a footer that finds every batch): `shard-00007.arrow` has the
shard's ids as sequences of equal length with a mask of real ids, in batches of a fixed number of sequences, so that
sequence k is row k % batch of batch k // batch; `shard-00007.index.arrow` has doc_id, start and n_tokens.
Nothing is compressed, so a mapped file gives sequences and masks without a copy. Ids are 16-bit where the vocabulary fits.

Documents are dealt to shards by ranges of doc_id and sorted within (null first, ties by the text's hash), so shards and rows are in
ascending order. A task writes under a name of its own and renames, so a lost executor's task is simply run again.
Null texts count as empty and have the end id only. An empty table has no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazgrid.llm import bpe
from hazgrid.llm import common as C


@dataclass(frozen=True)
class Layout:
    length: int = 2048
    batch: int = 256
    end_id: int = 2
    tokenizer: str = bpe.BYTE_BPE


def schema_of(size: int, layout: Layout) -> pa.Schema:
    kind = pa.uint16() if size <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(pa.field("item", kind, False), layout.length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), layout.length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Takes runs of ids and writes full batches; the last sequence is filled up with zeros that the mask hides."""

    def __init__(self, sink, size: int, layout: Layout):
        self.schema, self.layout = schema_of(size, layout), layout
        self.file, self.held, self.n_held, self.n = pa.ipc.new_file(sink, self.schema), [], 0, 0

    def put(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        full = self.layout.length * self.layout.batch
        if self.n_held >= full:
            have = np.concatenate(self.held)
            for k in range(0, len(have) - full + 1, full):
                self.write(have[k : k + full], full)
            rest = have[len(have) // full * full :]
            self.held, self.n_held = [rest], len(rest)

    def write(self, ids: np.ndarray, real: int) -> None:
        kind = self.schema.field("ids").type.value_type
        mask = np.arange(len(ids)) < real
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids.astype(kind.to_pandas_dtype())), type=self.schema.field("ids").type), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.schema.field("mask").type)], schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            have, length = np.concatenate(self.held), self.layout.length
            padded = np.zeros(-(-len(have) // length) * length, have.dtype)
            padded[: len(have)] = have
            self.write(padded, len(have))
        self.file.close()


class Shard:
    """Random access to a shard: sequences and masks without a copy, and the ids of a run."""

    def __init__(self, fs, path: str):
        self.file = pa.ipc.open_file(C.opened(fs, path))
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.at, self.batch = -1, None

    def part(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.batch = k, self.file.get_batch(k)
        return self.batch

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        batch, row = self.part(k // self.per_batch), k % self.per_batch
        return batch.column(0).values.to_numpy()[row * self.length : (row + 1) * self.length], batch.column(1).values.slice(row * self.length, self.length)

    def run(self, start: int, n: int) -> np.ndarray:
        full, out = self.per_batch * self.length, []
        while n > 0:
            k, at = divmod(start, full)
            ids = self.part(k).column(0).values.to_numpy()[at : at + n]
            if not len(ids):
                raise ValueError("the shard is shorter than its index says")
            out.append(ids)
            start, n = start + len(ids), n - len(ids)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def write_shards(docs: DataFrame, folder: str, layout: Layout = Layout()) -> list[tuple[int, int, int]]:
    """Writes the shards; (shard, documents, ids) of each that has documents, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, e, writer, docs_in = TaskContext.get().partitionId(), bpe.encoder(layout.tokenizer, library=True), None, 0
        fs, root = C.filesystem(folder)
        own = f"{root}/.{uuid.uuid4().hex}"
        for part in C.cut(batches, most=4 << 20):
            if writer is None:
                sink, index_sink = fs.open_output_stream(f"{own}.arrow"), fs.open_output_stream(f"{own}.index.arrow")
                writer, index = ShardWriter(sink, e.vocabulary.size, layout), pa.ipc.new_file(index_sink, INDEX)
            ids, ends = e.encode(C.texts(part).to_pylist())
            with_end = np.insert(ids, ends[1:], layout.end_id)
            n = np.diff(ends) + 1
            index.write_batch(C.made(INDEX, doc_id=part.column("doc_id").cast(pa.int64()), start=writer.n + np.cumsum(n) - n, n_tokens=n))
            writer.put(with_end)
            docs_in += part.num_rows
        if writer is not None:
            for x in (writer, index, sink, index_sink):
                x.close()
            fs.move(f"{own}.arrow", f"{root}/shard-{shard:05d}.arrow")
            fs.move(f"{own}.index.arrow", f"{root}/shard-{shard:05d}.index.arrow")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [docs_in], "ids": [writer.n if writer else 0]})

    spark = docs.sparkSession
    C.make_folder(spark, folder)
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(C.partitions_of(docs), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    # A row for each shard: its number and two counts.
    return sorted(tuple(r) for r in dealt.mapInArrow(run, "shard long, docs long, ids long").collect() if r["docs"])


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """One row a document, from the files: where its ids start among all, how many it has, and their checksum."""
    before, total = [], 0
    for _, _, n in shards:
        before.append(total)
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = C.filesystem(folder)
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            shard = Shard(fs, f"{root}/shard-{shards[k][0]:05d}.arrow")
            index = pa.ipc.open_file(C.opened(fs, f"{root}/shard-{shards[k][0]:05d}.index.arrow"))
            for i in range(index.num_record_batches):
                part = index.get_batch(i)
                runs = [shard.run(s, n) for s, n in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist(), strict=True)]
                yield C.made(READ, doc_id=part.column("doc_id"), start=part.column("start").to_numpy() + before[k], n_tokens=[len(x) for x in runs], ids_crc32=[zlib.crc32(x.astype("<u4").tobytes()) for x in runs])

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
