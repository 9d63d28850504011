"""A training corpus from documents: quality, line and document deduplication, decontamination, token ids.

Every stage but the last returns all columns of its input, whatever their names. Rows with a null id are handled like
others, repeated rows alike; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from confluo.llm.common import materialize, read

#: The vocabulary of the last stage: a rank file that every executor finds at this path.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: Rows of a batch that goes to Python: of whole documents, ten thousand fill tens of MB in the JVM and as much in each worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches of the session's Arrow functions hold no more than BATCH_ROWS rows from now on; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, doesn't reject.

    Null and empty texts are scored by their statistics; without labels all rows score 0.5 and stay."""
    small_batches(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with one line kept of every group of similar lines; n_chars follows the text.

    Rows with null or empty texts stay as they are; rows that lose every line stay, with an empty text."""
    small_batches(spark)
    done = line_dedup.dedup_lines(docs)
    return done.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates.

    Rows with null or empty texts are near nothing, but of equal rows one stays."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; all of them if the benchmark is empty."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) and whether decoding them gives the text again; null texts are empty."""
    small_batches(spark)
    return bpe.encode_documents(docs, RANKS).drop("decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", deduplicate_lines),
    ("minhash_near_dedup", deduplicate_documents),
    ("benchmark_decontamination", drop_benchmark),
    ("byte_level_bpe", encode),
]

#: Neither the classifier nor the similarity joins can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
