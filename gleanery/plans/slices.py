"""The flagship question: per source and run, after keeping the latest row per id and refusing links outside the allowed
domains, how healthy is the source, and did its count fall?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.urls import host_under_any, url_host
from gleanery.operators.quality import is_count_drop, whole_median
from gleanery.operators.snapshots import recent_counts


def run_quality(rows: DataFrame, source: str, run: str, key: str, stamp: str, seq: str, valid: Column, share: float = 0.5) -> DataFrame:
    """Quality per (source, run): raw, unique, duplicates, completeness, baseline of the last three runs and drop flag.

    One aggregate per (source, run, id), combined before its shuffle, counts the copies and keeps the newest one's validity (ties: the
    smallest arrival number ``seq``); a second one adds up (source, run).
    """

    newest = F.max_by(F.struct(valid.alias("ok")), F.struct(F.col(stamp), -F.col(seq)))
    per_id = rows.groupBy(source, run, key).agg(F.count("*").alias("copies"), newest.alias("newest"))
    joined = per_id.groupBy(source, run).agg(F.sum("copies").alias("raw_rows"), F.count("*").alias("unique_rows"), F.count_if("newest.ok").alias("valid_rows"))
    judged = recent_counts(joined, [source], run, "unique_rows").withColumn("baseline", whole_median(F.col("recent")))
    return judged.select(
        source, run, "raw_rows", "unique_rows", (F.col("raw_rows") - F.col("unique_rows")).alias("duplicate_rows"),
        F.round(F.col("valid_rows") / F.col("unique_rows"), 6).alias("completeness"), "baseline",
        is_count_drop(F.col("unique_rows"), F.col("baseline"), share).alias("quarantined"))


def allowed_link_counts(pages: DataFrame, domains: Sequence[str], url: str = "url") -> DataFrame:
    """Pages per host and whether the host lies under an allowed domain."""

    hosts = pages.groupBy(url_host(url).alias("host")).agg(F.count("*").alias("pages"))
    return hosts.withColumn("allowed", host_under_any("host", F.array(*[F.lit(x) for x in domains])))
