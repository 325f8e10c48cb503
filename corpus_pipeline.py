"""A training-data pipeline of five stages over `documents`.

Each stage works on all that the one before kept. All but the last return the columns of
`documents`; the last returns one row per document with its piece ids' digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import common, langid, mixing, near_copies, piece_bpe, suffix_dedup


def _small_batches(spark: SparkSession) -> None:
    """Let fewer texts at a time go from Spark to Python: both sides hold a batch of each running task in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (operator 6): null, empty and letterless texts; equal rows are judged alike."""
    _small_batches(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component of near copies: 5-word shingles, similarity of 0.8 and more; rows of one id are judged each by its own text, of equal rows and of groups without ids one row stays."""
    _small_batches(spark)
    return near_copies.keep_one_per_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 50 bytes and more that an earlier document has (operator 9); a null id is later than all, rows of one id are not earlier than each other."""
    _small_batches(spark)
    return suffix_dedup.trimmed(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources meet their target weights; each document is used at least once (operator 10); a null source is a source of its own, an empty table stays empty."""
    _small_batches(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document to piece ids and decodes it again (operator 7); a null text counts as empty."""
    _small_batches(spark)
    return piece_bpe.query(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: SQL expresses none of the stages' fingerprints, automata and tables; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    base = f"{common.ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
