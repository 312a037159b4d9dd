"""From raw documents to token ids: language identification, near-duplicate removal, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, langid, mixing, simhash
from tessera.llm.common import remove, table, work_folder
from tessera.llm.queries import byte_bpe_path
from tessera.session import reach_workers


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter, or without a text, are rejected.

    An empty text has no letter. Repeated rows are judged alike and stay repeated; a null doc_id, lang or source rejects nothing. Very long texts are
    read whole. Other columns pass through, whatever their names. An empty table gives an empty one.
    """
    reach_workers(spark)
    model = langid.fit(docs, modulus=4, held_out=2)
    labelled = langid.identify(docs, model, names=("__lang", "__score", "__spans"))
    return labelled.filter("__lang <> 'und'").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, and among rows that share it that of the smallest text digest.

    Groups are of texts, so rows of one doc_id but different texts are judged apart. A null doc_id comes last; a null or empty text is a group with
    all others of no words. Of rows equal in doc_id and text one stays. Other columns pass through. An empty table gives an empty one.
    """
    reach_workers(spark)
    return simhash.keep_first(docs, distance=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: a row for each copy.

    A null source is a source of its own, last in order. A text that is null or has no words has size 0 and goes with its source's whole copies.
    Repeated rows are drawn one by one. Other columns pass through. An empty table gives an empty one.
    """
    reach_workers(spark)
    return mixing.apply_mix(docs, weights=(1.0, 2.0, 3.0), max_repeat=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row's ids and decoded text.

    A null text encodes as the empty one: no ids, and the digests of no bytes. Repeated rows give repeated results, a null doc_id stays null, other
    columns are not read. An empty table gives an empty one.
    """
    reach_workers(spark)
    return bpe.encode_documents(docs, byte_bpe_path())


STAGES = [
    ("language identification", identify_language),
    ("simhash near-duplicates", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("bpe encoding", encode),
]

#: Fingerprints, mixing draws and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = work_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        remove(spark, f"{folder}/{k - 1}")  # what the stage has read is no longer needed
    return docs
