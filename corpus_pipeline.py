"""Corpus cleaning: five stages over ``documents``, each of which may be written as Parquet and read again.

Toxic documents go; of near duplicates one stays; benchmark passages are cut out of the texts; secrets
give way to a mark; what is left is encoded (and decoded again). All but the last stage return the
columns of ``documents``; n_chars follows the text.

Null, empty and wordless texts have nothing toxic, no near duplicates, no passages, no secrets and no
ids, so they pass through; repeated rows share their fate (a repeated row of a kept id stays); an
empty table gives an empty one; columns that aren't those of ``documents`` come along until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediamill.llm import bpe, decontam, minhash, secrets, toxicity
from mediamill.llm.common import checkpointed


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3, by a network trained on the labelled rows whose id's checksum doesn't hold them out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of texts linked by a similarity of 0.8 or more."""
    return minhash.keep_one(docs, percent=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark windows."""
    return _counted(decontam.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret."""
    return _counted(secrets.redact(docs, path_col="source" if "source" in docs.columns else None))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids and the text that they decode to."""
    return bpe.encode(docs, lists=True).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("benchmark_decontamination", cut_benchmark), ("secret_scan", redact_secrets), ("bpe_round_trip", encode)]

#: SQL can express neither the network nor the merges; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else checkpointed(docs), sf_dir)
    return docs
