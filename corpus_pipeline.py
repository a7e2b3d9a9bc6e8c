"""Corpus cleaning run: five stages over documents, each written as Parquet and read back for the next.

Order: toxic documents go; one document of each near-duplicate group stays; documents that hold a benchmark passage go; personal data and
disclosing terms are taken out of the texts; the rest is mixed to target weights. Null texts are empty texts throughout and are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import decontam, mixing, pii, simhash, toxicity
from gleanery.llm.common import fresh_dir
from gleanery.session import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; texts without a word are no copies of each other and all stay.

    Only ids and fingerprints are grouped; texts meet the ids that go in one anti-join. A row that repeats an id and its text is the same
    document and goes too. Rows without an id can't be named and stay.
    """
    groups = simhash.near_duplicates(docs.filter(F.col("text").rlike(r"[^ \t-\r]")))
    gone = groups.filter("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), prefix="decontam_", offsets=False)
    return found.filter("decontam_n_hit = 0").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(pii.find_spans(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")).select(*[c for c in docs.columns if c != "pii_spans"])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mixture; reading by (mix_slot, mix_place) gives the training order."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix),
]

ORACLE_SQL = None  # learned scores, similarity groups and learned disclosures are not SQL; tests hold the run against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
