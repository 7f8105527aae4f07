"""From raw documents to token ids: the text operators as stages, each written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltledger.llm import bpe, mixing, ngram_join, quality, queries, secrets
from voltledger.sources.staging import Staging


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    queries.ready(spark)
    return ngram_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids, with the hash of what these decode to."""
    queries.ready(spark)
    return bpe.encoded(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", drop_bad),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

# A trained classifier and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = queries.table(spark, sf_dir, "documents")
    staging = Staging(spark, "pipeline")
    for _, stage in STAGES:
        docs = staging.write(stage(spark, docs, sf_dir))
    return docs
