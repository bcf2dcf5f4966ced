"""A corpus in five stages: quality rules, near duplicates, benchmark passages, secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns
the columns of documents; the last one returns what the mix takes of each. run() writes every stage as
Parquet in the shared scratch folder and reads it again. A table that lost all its rows passes through.
"""

from pyspark.sql import DataFrame, SparkSession

from vitalcells.llm import decontamination, mixing, ngram_jaccard, quality_rules, secret_scan
from vitalcells.llm.scratch import Scratch

#: The classifier and the shuffled order have no SQL; tests hold the run against a plain version.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id. Documents without
    words are in no group and stay."""
    return ngram_jaccard.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return secret_scan.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontaminated), ("secret scans", secrets),
          ("mixing sources to target weights", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
