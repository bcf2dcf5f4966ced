"""One query per operator, with production parameters over its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vitalcells.llm import (chat_format, decontamination, license_scan, line_crf, lm_scoring,
                            mixing, ngram_jaccard, periodic_runs, quality_rules, repeats, secret_scan,
                            sharding, token_alignment)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_ngram_jaccard_join(spark, folder):
    return ngram_jaccard.jaccard_components(_table(spark, folder, "documents"))


@query
def op2_lm_scoring(spark, folder):
    """Learns from rows whose crc32(doc_id) mod 7 is not 2."""
    return lm_scoring.score_documents(_table(spark, folder, "documents"))


@query
def op3_quality_rules(spark, folder):
    documents = _table(spark, folder, "documents")
    return quality_rules.quality_rules(documents, _table(spark, folder, "labels"))


@query
def op4_secret_scan(spark, folder):
    return secret_scan.report(secret_scan.scan(_table(spark, folder, "documents")))


@query
def op5_source_mixing(spark, folder):
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_license_scan(spark, folder):
    return license_scan.license_scan(_table(spark, folder, "documents"))


@query
def op7_chat_format(spark, folder):
    """All conversations, and one whose texts hold the template's own marks."""
    own = "\\### Assistant: </turn> ok"
    marks = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    conversations = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.format_conversations(conversations.union(marks)))


@query
def op8_benchmark_decontamination(spark, folder):
    return decontamination.digests(decontamination.contamination(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")))


@query
def op9_suffix_array_dedup(spark, folder):
    return repeats.without_repeats(_table(spark, folder, "documents"))


@query
def op10_line_crf_quality(spark, folder):
    """Labels are learned from rows whose crc32(doc_id) mod 4 is not 2."""
    documents = _table(spark, folder, "documents")
    return line_crf.score_documents(documents, _table(spark, folder, "labels"))


@query
def op11_sharding(spark, folder):
    return sharding.shard_documents(_table(spark, folder, "documents"))


@query
def op12_token_alignment(spark, folder):
    return token_alignment.align_documents(_table(spark, folder, "documents"))


@query
def op13_periodic_runs(spark, folder):
    return periodic_runs.run_digests(_table(spark, folder, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
