"""The catalog run: raw postings and state in, gated and versioned tables out.

Stages: enrich, normalise and gate, judge each source on all its rows, merge with the state, retain, publish. Quality is
measured before the audience gate, so filtering never looks like a broken source; nothing is written before the gates.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import defaults as d
from gleanery.functions import ids, rules, text, urls
from gleanery.functions.audience import assess, is_publishable
from gleanery.functions.locations import normalize_locations
from gleanery.operators import dedup, gates, quality, reports, snapshots
from gleanery.scale import lookup_join, materialize
from gleanery.sources import sinks

LOG_COLUMNS = ("source_id", "complete", "not_modified", "health", "reason", "raw_count", "fetched_at")


@dataclass
class CatalogRun:
    """Tables of one run, read from the stages the run has written to the checkpoint folder."""

    jobs: DataFrame
    rejects: DataFrame
    quality: DataFrame
    sources: DataFrame
    decisions: DataFrame
    reasons: DataFrame
    review: DataFrame
    campaigns: DataFrame
    campaign_jobs: DataFrame
    manifest: DataFrame
    counts_state: DataFrame
    version: str

    def write(self, root: str) -> None:
        """All products under one version folder; the previous version stays as it is."""

        base = f"{root}/{self.version}"
        sinks.write_details(self.jobs, f"{base}/details", self.version)
        sinks.write_list(self.jobs, f"{base}/list", self.version)
        sinks.write_products({"campaigns": self.campaigns, "campaign_jobs": self.campaign_jobs, "sources": self.sources,
                              "quality": self.quality, "manifest": self.manifest, "review": self.review}, root, self.version)
        sinks.write_state({"jobs_state": self.jobs, "source_counts": self.counts_state}, root, self.version)


def with_source_columns(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Reviewed address and domain list of each row's source; a row without one is judged against its own page."""

    side = sources.select("source_id", F.col("source_url").alias("_reviewed_url"), gates.allowed_domains(
        F.col("apply_domain"), F.col("apply_domains"), F.col("ats_host")).alias("_domains"), F.col("source_level").alias("_level"))
    rows = lookup_join(raw, side, "source_id", "left")
    return rows.withColumns({
        "_reviewed_url": F.coalesce("_reviewed_url", "source_url"),
        "_domains": F.coalesce("_domains", F.array(urls.url_host("source_url"))),
        "source_level": F.coalesce("_level", "source_level"),
    }).drop("_level")


def normalise(raw: DataFrame, sources: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(normalised postings, rejects with reason). Scope gate first, then the link gate, then all field rules."""

    rows = with_source_columns(raw, sources)
    empty = F.array().cast("array<string>")
    head = F.concat_ws(" ", "title", "batch", "cohort")
    full = F.concat_ws(" ", "title", "description", F.coalesce("requirements", empty), "batch", "cohort")
    scope = rules.in_scope(F.col("is_campus"), head, full)
    link = gates.url_gate(F.col("source_url"), F.col("apply_url"), F.col("_reviewed_url"), F.col("_domains"))
    rows = rows.withColumn("reject_reason", F.when(~scope, F.concat(F.lit("social_or_unverified_job:"), F.col("title"))).otherwise(link))
    rejects = rows.filter("reject_reason is not null").select("source_id", "company_id", "title", "apply_url", "reject_reason")
    good = rows.filter("reject_reason is null").withColumns({
        "id": ids.stable_job_id(), "content_hash": ids.content_hash(), "_city": text.normalize_city("city"),
        "locations": normalize_locations("city", "locations"), "role_category": rules.role_category(text.clean_text("role_category", 80)),
        "description": text.clean_text("description"), "requirements": text.clean_list("requirements"),
        "major_tags": text.clean_list("major_tags"), "skills": text.clean_list("skills"),
        "first_seen_at": now, "last_verified_at": now, "status": F.lit("ACTIVE"),
        "first_missing_successes": F.lit(0), "changed_at": F.lit(None).cast("timestamp"),
    })
    return good.withColumn("city", F.col("_city")).drop("_city", "_reviewed_url", "_domains", "reject_reason"), rejects


def gate(rows: DataFrame) -> DataFrame:
    return assess(rows).withColumns({"audience_decision": F.col("audience.decision"), "audience_reason_codes": F.col("audience.reason_codes")})


def build_catalog(
    raw: DataFrame,
    sources: DataFrame,
    log: DataFrame,
    now: datetime,
    previous: DataFrame | None = None,
    counts_state: DataFrame | None = None,
    companies: DataFrame | None = None,
    minimum_verified: int = 0,
) -> CatalogRun:
    """One run. ``log`` has one row per source: source_id, complete, not_modified, health, reason, raw_count, fetched_at.
    ``counts_state`` carries previous_count and count_history per source. Raises before any write when a gate refuses.

    The work is dealt to as many tasks as ``raw`` (and ``previous``) has partitions; see ``scale.dealt_by_rows``."""

    spark, at = raw.sparkSession, F.lit(now).cast("timestamp")
    if companies is not None:
        raw = reports.fill_unknown(raw, companies, "company_id", {"company_industry": "industry", "company_type": "type", "company_scale": "scale"})
    normal, rejects = normalise(raw, sources, at)
    # read by the quality report, the counts and the merge; written once, so every reader sees the same rows
    # the two Python steps (text cleaning, major terms) are planned apart: Spark 4.1 fails to extract the second one from
    # some short inputs when both sit in one plan
    gated = materialize(gate(materialize(normal)))
    names = [c for c in gated.columns if c != "audience"]
    if previous is None:
        old = spark.createDataFrame([], gated.select(*names).schema)
    else:
        # state of an older policy is judged again before it is used
        regated = gate(previous.drop("audience_decision", "audience_reason_codes")).filter(is_publishable())
        old = materialize(regated.withColumn("role_category", rules.role_category("role_category")).select(*names))
    tasks = gated.rdd.getNumPartitions() + (0 if previous is None else old.rdd.getNumPartitions())
    log = snapshots.reuse_unmodified(log, old)
    arrival = ["content_hash", "apply_url"]
    observed = dedup.latest_per_key(gated, ["source_id", "id"], "last_verified_at", arrival, tasks)
    observed = snapshots.current_or_previous(observed.select(*names), old, log)
    current = observed.filter(F.col("audience_decision") == "TARGET_GENERALIST")

    problem = quality.row_problem(["title", "company_name", "city"], urls.is_official_url("apply_url"))
    counts = quality.source_counts(observed, ["source_id"], "id", problem, F.col("cohort").isin("", d.UNKNOWN))
    if counts_state is None:
        counts_state = spark.createDataFrame([], "source_id string, previous_count bigint, count_history array<bigint>")
    judged_log = log.join(counts_state, "source_id", "left").withColumnRenamed("complete", "fetch_ok")
    report = materialize(quality.source_quality(counts, judged_log, "source_id", at))
    flags = log.select("source_id", "complete").join(report.select("source_id", "quarantined"), "source_id", "left")
    merged = snapshots.advance_lifecycle(old, current, flags, at)
    jobs = materialize(snapshots.retain(dedup.latest_per_key(merged, ["id"], "last_verified_at", ["source_id"], tasks), at))

    held_counts = counts.select("source_id", F.col("item_count").alias("observed_count"))
    moved = judged_log.join(held_counts, "source_id", "left").withColumn("observed_count", F.coalesce("observed_count", F.lit(0)).cast("bigint"))
    next_state = moved.select(
        "source_id", F.when(F.col("fetch_ok"), F.col("observed_count")).otherwise(F.col("previous_count")).alias("previous_count"),
        snapshots.push_history(F.col("count_history"), F.col("observed_count"), F.col("fetch_ok"), F.col("not_modified")).alias("count_history"))
    settled = log.join(report.drop("raw_count", "reason"), "source_id", "left")
    health = F.when(F.col("quarantined"), "quarantined").when(~F.col("complete") & (F.col("health") == "healthy"), "stale").otherwise(F.col("health"))
    settled = settled.withColumn("health", health).withColumn("reason", F.when(F.col("quarantined"), "count_drop_over_50_percent").otherwise(F.col("reason")))
    shown = materialize(reports.public_sources(sources, settled))
    gates.require_verified_sources(shown, minimum_verified)
    return CatalogRun(
        jobs=jobs, rejects=rejects, quality=report, sources=shown, decisions=quality.decision_counts(gated, "source_id", "audience_decision"),
        reasons=quality.reason_counts(gated, "source_id", "audience_reason_codes"),
        review=gated.filter(F.col("audience_decision") == "NEEDS_REVIEW").select("id", "source_id", "company_name", "title", "audience_reason_codes"),
        campaigns=reports.campaigns(jobs, at), campaign_jobs=reports.campaign_jobs(jobs, ["last_verified_at", "id"]),
        manifest=reports.manifest(jobs, shown, at).withColumn("policy_version", F.lit(d.POLICY_VERSION)), counts_state=next_state,
        version=now.strftime("%Y.%m.%d.%H%M"))
