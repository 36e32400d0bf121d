"""A corpus from raw documents to token digests: quality rules, near-duplicates, personal data,
mixing, encoding.  Each stage's rows are written as Parquet and read again for the next.

Null, empty and blank texts have no words, so the quality stage drops them; very long texts are read
whole by every stage.  Of repeated rows and exact copies one stays, that with the smallest doc_id; null
doc_ids come after all others.  The mix may then take a row twice.  Extra columns pass all stages but the
last, whatever their names.  An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import bpe_codec, mixing, pii, quality_bands, queries, simhash_sets
from pointloom.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the compression bands reject go; the bands are fitted to the labelled
    good ones, where there are labels."""
    return quality_bands.passing(docs, **quality_bands.fitted(docs, queries.labels_of(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingle sets 0.8 alike or more stays."""
    return simhash_sets.first_of_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe_codec.round_trip(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("simhash near-dedup", near_duplicates), ("pii", personal_data), ("mixing", mix), ("bpe round trip", encode)]

#: SimHash and BPE can't be expressed in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
