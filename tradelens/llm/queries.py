"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm import compaction, hilbert, kmeans_tree, langid, licences, merkle, packing, quality, repair, repeats, simhash, templates, tiling
from tradelens.llm.common import read, scratch


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op2_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(read(spark, sf_dir, "pages"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand in a tree of directories by source, language and hundreds of their number; every tenth is called a licence file."""
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    path = F.concat_ws("/", level("source"), level("lang"), F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.when(F.col("doc_id") % 10 == 0, "LICENSE-").otherwise(""), F.col("doc_id").cast("string")))
    return licences.scan(read(spark, sf_dir, "documents"), path)


def op4_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).drop("distance")


def op6_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents arrive as shards of their own; read back from the compacted version."""
    store = compaction.ShardStore(spark, scratch(spark, "shard-store"))
    store.append_by(read(spark, sf_dir, "documents"), F.col("source"))
    version = store.compact()
    return store.read(version).select("doc_id", "lang", "source", "n_chars", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op7_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(read(spark, sf_dir, "documents")))


def op9_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.encode_documents(read(spark, sf_dir, "documents"))


def op10_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"), merkle.tampering()).drop("path")


def op13_hilbert_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.cluster(read(spark, sf_dir, "embeddings"))


def queries() -> dict:
    own = [op1_best_fit_packing, op2_template_deduction, op3_licence_scan, op4_byte_cnn_language, op5_robust_outliers, op6_size_tiered_compaction, op7_simhash_classes, op8_repeated_phrases, op9_repair_tokens, op10_greedy_tiling, op11_kmeans_tree_search, op12_merkle_manifest, op13_hilbert_clusters]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op6_size_tiered_compaction": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents", "op12_merkle_manifest": merkle.oracle_sql(), "op13_hilbert_clusters": hilbert.oracle_sql()}
