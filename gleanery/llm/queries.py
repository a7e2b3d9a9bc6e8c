"""Registered queries of the numbered operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import decontam, divergence, lm, mixing, pii, quality, resampling, sharding, simhash, suffix, tokens, toxicity, warc
from gleanery.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_benchmark_decontamination(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return decontam.digest(decontam.find_contamination(docs, table(spark, root, "benchmark")))


@query
def op3_simhash_golay(spark: SparkSession, root: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, root, "documents")))


@query
def op2_disclosure_sanitising(spark: SparkSession, root: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, root, "documents").select("doc_id", "text")))


@query
def op5_nearest_labelled_toxicity(spark: SparkSession, root: str) -> DataFrame:
    return toxicity.digest(toxicity.score_toxicity(table(spark, root, "documents").select("doc_id", "text"), table(spark, root, "labels")))


@query
def op1_pfair_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_sources(table(spark, root, "documents")).drop("text")


@query
def op10_warc_normaliser(spark: SparkSession, root: str) -> DataFrame:
    return warc.digest(warc.round_trip(table(spark, root, "pages")))


@query
def op7_repeated_strings(spark: SparkSession, root: str) -> DataFrame:
    return suffix.digest(suffix.remove_repeats(table(spark, root, "documents")))


@query
def op9_kneser_ney(spark: SparkSession, root: str) -> DataFrame:
    return lm.digest(table(spark, root, "documents"))


@query
def op8_line_crf_quality(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return quality.digest(quality.judge(docs, quality.learn(docs, table(spark, root, "labels"))))


@query
def op4_unigram_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return tokens.count_tokens(table(spark, root, "documents").select("doc_id", "text"), tokens.Vocabulary.load()).drop("text")


@query
def op11_rendezvous_sharding(spark: SparkSession, root: str) -> DataFrame:
    return sharding.digest(sharding.assign_shards(table(spark, root, "documents"), carry=["doc_id"]))


@query
def op12_source_divergence(spark: SparkSession, root: str) -> DataFrame:
    return divergence.audit_divergence(table(spark, root, "documents"))


SQL["op12_source_divergence"] = divergence.SQL


@query
def op13_importance_resampling(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return resampling.digest(resampling.draw(resampling.weigh(docs, table(spark, root, "benchmark")).drop("text")))
