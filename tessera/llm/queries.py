"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, html, langid, lm, mixing, oracle, sharding, simhash, tokencount, topk
from .common import id_remainder, table


def byte_bpe_path() -> str:
    """The byte-level BPE file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op2_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64, every=20)


def op3_log_bloom_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), modulus=10, held_out=0, alpha=0.1)


def op4_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_sections(table(spark, sf_dir, "documents"), byte_bpe_path(), rule="most", sections=tokencount.sentence_ends)


def op5_collision_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_max_subsequence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(1.0, 2.0, 3.0), max_repeat=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=3)
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op9_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), byte_bpe_path())


def op10_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, modulus=4, held_out=2)
    labelled = langid.identify(docs.select("doc_id", "text"), model, spans=True)
    return labelled.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hash_tree_shards,
        op2_pivot_top_k,
        op3_log_bloom_scores,
        op4_offset_token_counts,
        op5_collision_classes,
        op6_max_subsequence_text,
        op7_pareto_mix,
        op8_simhash_classes,
        op9_transducer_bpe,
        op10_viterbi_language,
    )
}

#: The others hash, tokenize or learn by means that SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_hash_tree_shards": oracle.shards_sql(8),
    "op2_pivot_top_k": oracle.top_k_sql(20, 64, 20),
    "op5_collision_classes": oracle.classes_sql(0.98),
    "op7_pareto_mix": oracle.mix_sql((1.0, 2.0, 3.0), 3),
}
