"""A corpus pipeline: language, near duplicates, benchmark passages, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as Parquet and reads
again as the next stage's documents. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierworks.llm import bpe, decontaminate, langid, secret_scan, simhash
from tierworks.llm.queries import BYTE_BPE, table
from tierworks.session import new_work_path


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from the labels of three in four documents."""
    return langid.keep_identified(docs, langid.fit(docs.where(~langid.held_out(docs["doc_id"]))))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one with the smallest id."""
    return simhash.keep_one(docs, words_per_shingle=3, max_bits=2)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced and their lengths brought up to date."""
    path = new_work_path(spark, "findings")
    secret_scan.scan(docs).write.parquet(path)
    clean = secret_scan.redact(docs, secret_scan.fit(spark.read.parquet(path)))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text, for every document."""
    return bpe.encode_digests(docs, BYTE_BPE)


STAGES = [
    ("language ID", identified),
    ("SimHash near-dedup", distinct),
    ("benchmark decontamination", uncontaminated),
    ("secret scans", without_secrets),
    ("BPE encoding and decoding", tokens),
]

# Trained models and hashes that SQL lacks decide in it; the tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_work_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
