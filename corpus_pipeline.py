"""From raw documents to token ids, in five stages; each is written as Parquet and read again by the next.

  quality          the boosted trees reject documents of low quality (trained on the labels of sf_dir)
  near_duplicates  one document of each component of the 5-word Jaccard join at 0.75 stays
  secrets          every span that the scan finds is replaced by [SECRET]; n_chars follows
  mixing           documents are taken 0, 1 or 2 times, so that sources come near their target weights
  encoding         SentencePiece ids of every taken document, with digests of ids and decoded text

All but the last return the columns of documents. Documents with null or empty texts go through all stages like others;
an empty table gives an empty result. SQL can't express trained models or the library's tokenizer, so ORACLE_SQL is None;
the tests compare run() with a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloft.llm import jaccard_join, mixing, piece_table, quality_model, secrets
from lumenloft.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_table.digests(docs, with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", without_secrets), ("mixing", mix_sources), ("encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
