"""What op9's table of PCM brings into memory at once: batches and row groups by bytes, one Python pass to store it."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq

from hazgrid.llm import media, queries

MB = 1 << 20


def test_batches_and_row_groups_are_small(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    rows = [(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=100_000))) for i in range(160)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    names, plans, written = {}, {}, queries.C.written

    def seen(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        names[name] = written(df, name, **options)
        return names[name]

    def sizes(stored):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

        return stored.mapInArrow(run, "n long, size long")

    monkeypatch.setattr(queries.C, "written", seen)
    monkeypatch.setattr(queries.media, "read_media", sizes)
    before = {k: spark.conf.get(k) for k in media.SMALL_READS}
    got = queries.op9_telephony_media(spark, str(tmp_path)).collect()
    assert before == {k: spark.conf.get(k) for k in media.SMALL_READS}
    assert sum(x["n"] for x in got) == len(rows) and max(x["size"] for x in got) < 8 * MB
    assert plans["pcm"].count("MapInArrow") == 1
    files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in names["pcm"].inputFiles()]
    groups = [f.row_group(k) for f in files for k in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == len(rows) and max(g.total_byte_size for g in groups) < 32 * MB


def test_one_pass_stores_what_two_do(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "é" * 70), (4, "x" * 64)], "doc_id long, text string")
    two = media.store_pcm(media.store_texts(docs), "media").drop("media").collect()
    one = media.store_texts(docs, pcm=True).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and one[0].asDict().keys() == two[0].asDict().keys()
