"""The registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazgrid.llm import common as C
from hazgrid.llm.oracle import ORACLES
from hazgrid.llm import bpe, jaccard, media, mixing, pii, quality, substrings, suffixes, token_files, urls


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents")


def op1_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op3_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.fresh_path(spark, "tokens")
    return token_files.read_shards(spark, folder, token_files.write_shards(documents(spark, sf_dir), folder))


def op4_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(documents(spark, sf_dir)).selectExpr("doc_id", "size", "source_size", "target", "size * copies as taken", "copies")


def op5_bpe_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op6_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir), with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")


def op7_combination_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), jaccard.Join(words=4, percent=85)).select("doc_id", "n_shingles", "component_id")


def op8_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_metrics(documents(spark, sf_dir))


def op9_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The features are written here too: a read that ran later would have the session's batches.
    with C.settings(spark, media.SMALL_READS):
        stored = C.written(media.store_texts(documents(spark, sf_dir), pcm=True), "pcm", compression="zstd", **media.SMALL_GROUPS)
        return C.written(media.read_media(stored), "features", compression="zstd")


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.outcomes_of(pages, C.table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")


__all__ = ["ORACLES", "QUERIES"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_count_min_substrings, op2_pii_anchors, op3_arrow_token_files, op4_cube_mixing, op5_bpe_merge_rounds, op6_suffix_levels, op7_combination_jaccard, op8_quality_fertility, op9_telephony_media, op10_host_reputation,
    )
}
