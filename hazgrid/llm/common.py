"""What the operators share: tables, the shared folder, and cutting Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TOKENIZER_DIR = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session without one gets its own if it is local (as in tests); on a cluster that is an error."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="hazgrid-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(there)
    return there


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: its lineage is cut and no executor is needed for it. The options are the writer's."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Batches of n rows at most for what is written within: rows with whole sets are large, and both sides of the pipe hold a batch."""
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(n)}):
        yield


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings for what is written within; what is only planned within and run later has them not."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder in the shared folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_of(df: DataFrame, most: int = 128 << 20) -> int:
    """The session's shuffle partitions, or as many more as keep each at about `most` bytes of what the plan reads, by its own estimate."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Plans of unknown size report huge ones.
    return max(partitions(df.sparkSession), -(-size // most) if size < 1 << 56 else 0)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.StringArray:
    """The column as non-null 32-bit strings (null: empty)."""
    x = batch.column(column)
    if not pa.types.is_string(x.type):
        x = x.cast(pa.string())
    return x.fill_null("") if x.null_count else x


def offsets_of(x: pa.Array) -> np.ndarray:
    return np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)


def data_of(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of x one after another, and where each begins."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = offsets_of(x)
    buf = x.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[at[0] : at[-1]] if buf is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def cut(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of the string or binary column, or with one row that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sized = batch.column(column)
        if pa.types.is_large_string(sized.type) or pa.types.is_large_binary(sized.type):
            sized = sized.cast(pa.string() if pa.types.is_large_string(sized.type) else pa.binary())
        size = offsets_of(sized)
        size = size - size[0] + np.arange(len(size))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(size, size[row] + most, side="right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def made(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)



def filesystem(uri: str):
    """pyarrow's file system for a folder, and the path in it. Hadoop writes file:/x for file:///x."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def opened(fs, path: str):
    """A file for reading; a local one is mapped."""
    from pyarrow import fs as kinds

    return pa.memory_map(path) if isinstance(fs, kinds.LocalFileSystem) else fs.open_input_file(path)


def make_folder(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
