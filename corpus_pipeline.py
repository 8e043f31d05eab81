"""A training-data pipeline of five stages: run() applies them in order, each to what the one before it wrote.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes as
Parquet and rereads as the next one's docs. All but the last return the columns of documents, those of any other name
besides as they were. An empty table stays empty in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, exact_dedup, langid, mixing, near_dedup
from lodestone.llm.common import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (null, or without a letter) go. Repeated rows count as often as they are there; without labelled rows no language is known, and all go."""
    return langid.known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; null counts as empty, and a null doc_id loses to any other. Of rows that share doc_id and text one stays."""
    return exact_dedup.dedup_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id. Texts without words have no copies; rows without a doc_id stay."""
    return near_dedup.near_dedup_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: rows of a source that is taken more than once repeat. Null is a source of its own; rows without words are taken as often as their hash says."""
    return mixing.mix_rows(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the digests of the ids and of what they decode to; a null text is empty. Repeated rows are rows of their own."""
    return bpe.round_trip(docs).select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode_tokens),
]

#: The models, the signatures and the merges have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared checkpoint folder and read again; they are removed when the next stage's are there. The last
    folder stays, for the result that is computed from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared_dir(docs)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
