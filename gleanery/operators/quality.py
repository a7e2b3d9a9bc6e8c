"""Source quality, count drops, health and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import defaults as d
from gleanery.functions.dates import freshness_days
from gleanery.operators.dedup import spread_sample
from gleanery.operators.snapshots import last_items
from gleanery.scale import lookup_join


def whole_median(values: Column) -> Column:
    """Median of a short array, cut to a whole number; NULL when empty."""

    ordered, n = F.array_sort(values), F.size(values)
    at = lambda i: F.try_element_at(ordered, i.cast("int"))
    return F.when(n % 2 == 1, at((n + 1) / 2)).when(n > 0, F.floor((at(n / 2) + at(n / 2 + 1)) / 2)).cast("bigint")


def drop_baseline(history: Column, previous: Column | None = None, look_back: int = 3) -> Column:
    """Expected count: median of the last runs. With ``previous``, that count joins in if it is not among them (A2)."""

    history = F.coalesce(history, F.array().cast("array<bigint>"))
    values = F.filter(last_items(history, look_back), lambda x: x >= 0)
    if previous is not None:
        joins = (previous >= 0) & ~F.array_contains(values, previous.cast("bigint"))
        values = F.when(F.coalesce(joins, F.lit(False)), F.concat(values, F.array(previous.cast("bigint")))).otherwise(values)
        return F.coalesce(whole_median(values), previous.cast("bigint"))
    return whole_median(values)


def is_count_drop(count: Column, baseline: Column, share: float = 0.5) -> Column:
    """Strictly fewer than ``share`` of the baseline; no baseline, or zero, is never a drop."""

    return F.coalesce((baseline > 0) & (count < baseline * share), F.lit(False))


def row_problem(required: Sequence[str], link_ok: Column | None = None) -> Column:
    """Why a row is rejected, or NULL."""

    missing = ~F.lit(True)
    for c in required:
        missing = missing | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    chain = F.when(missing, "missing_required_field")
    return chain if link_ok is None else chain.when(~F.coalesce(link_ok, F.lit(False)), "invalid_apply_url")


def quality_rejects(rows: DataFrame, source: str, key: str, problem: Column) -> DataFrame:
    """Rejected rows with their reason: a table, because one source may reject any number of rows."""

    return rows.withColumn("reason", problem).filter("reason is not null").select(source, key, "reason")


def source_counts(rows: DataFrame, source: Sequence[str], key: str, problem: Column, unknown: Column) -> DataFrame:
    """Counts per source. Rows are added up before the shuffle and ids are made distinct per (source, id) first, so a
    source with a third of all rows is no hot task."""

    bad = problem.isNotNull()
    return rows.groupBy(*source).agg(
        F.count("*").alias("item_count"),
        F.countDistinct(key).alias("unique_count"),
        F.count_if(~bad).alias("accepted"),
        F.count_if(bad).alias("rejected"),
        F.count_if(problem == "missing_required_field").alias("missing_required"),
        F.count_if(problem == "invalid_apply_url").alias("invalid_links"),
        F.count_if(unknown).alias("unknown_items"),
    )


def source_quality(counts: DataFrame, log: DataFrame, source: str, now: Column, share: float = 0.5) -> DataFrame:
    """Quality report per source (A1).

    ``log`` has one row per source: fetch_ok, raw_count, previous_count, count_history, fetched_at. Sources that were
    fetched but sent nothing are part of the report. A failed fetch is never judged.
    """

    joined = log.join(counts, source, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    joined = joined.select(
        source, "fetch_ok", "previous_count", "count_history", "fetched_at",
        F.greatest(zero("item_count"), zero("raw_count")).alias("raw_count"),
        *[zero(c).alias(c) for c in ("item_count", "unique_count", "accepted", "rejected", "unknown_items")],
    )
    ratio = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
    joined = joined.withColumn("duplicate_count", F.greatest(F.lit(0).cast("bigint"), F.col("raw_count") - F.col("unique_count")))
    recent = F.filter(last_items(F.coalesce("count_history", F.array().cast("array<bigint>")), 3), lambda x: x >= 0)
    known = F.size(F.array_union(recent, F.array_compact(F.array(F.when(F.col("previous_count") >= 0, F.col("previous_count").cast("bigint"))))))
    baseline = F.when(F.col("fetch_ok"), drop_baseline(F.col("count_history"), F.col("previous_count")))
    joined = joined.withColumn("baseline_count", baseline)
    joined = joined.withColumn(
        "baseline_source",
        F.when(F.col("fetch_ok") & ((F.size(recent) > 1) | (known > 1)), "median_recent_runs").when(F.col("baseline_count").isNotNull(), "previous_run"),
    )
    joined = joined.withColumn("quarantined", F.col("fetch_ok") & is_count_drop(F.col("item_count"), F.col("baseline_count"), share))
    reason = F.when(~F.col("fetch_ok"), F.lit("fetch_failed_preserve_previous_catalog")).when(
        F.col("quarantined"),
        F.concat(F.lit(f"count_drop_over_{int(share * 100)}_percent:"), F.col("baseline_count"), F.lit("->"), F.col("item_count")))
    judged = lambda c: F.when(F.col("fetch_ok"), F.col(c)).otherwise(F.lit(0).cast("bigint"))
    return joined.select(
        source, "raw_count", "unique_count", "duplicate_count",
        ratio(F.col("duplicate_count"), F.col("raw_count")).alias("duplicate_ratio"),
        ratio(F.col("accepted"), F.col("unique_count")).alias("field_completeness"),
        ratio(F.col("unknown_items"), F.col("unique_count")).alias("unknown_ratio"),
        judged("accepted").alias("accepted"), judged("rejected").alias("rejected"), "baseline_count", "baseline_source", "quarantined",
        reason.alias("reason"), F.when(F.col("fetch_ok"), freshness_days("fetched_at", now)).alias("freshness_days"),
    )


def health_rows(sources: DataFrame, now: Column, drop_share: float = 0.5) -> DataFrame:
    """Health row per source: baseline from history alone, drop flag, freshness (A3)."""

    count = F.greatest(F.lit(0).cast("bigint"), F.coalesce(F.col("fetched_job_count").try_cast("bigint"), F.col("job_count").try_cast("bigint"), F.lit(0).cast("bigint")))
    base = drop_baseline(F.col("count_history"))
    judged = ~F.coalesce(F.col("health"), F.lit("unknown")).isin("blocked", "error", "not_ready")
    return (
        sources.withColumn("fetched_job_count", count).withColumn("baseline_count", base)
        .withColumn("anomalous_drop", is_count_drop(F.col("fetched_job_count"), F.col("baseline_count"), drop_share) & judged)
        .withColumn("freshness_days", F.coalesce(F.col("freshness_days"), freshness_days("fetched_at", now)))
    )


def health_summary(rows: DataFrame) -> DataFrame:
    state = F.col("health")
    return rows.agg(
        F.count("*").alias("source_count"),
        F.count_if(state.isin(*d.HEALTHY_STATES)).alias("healthy"),
        F.count_if(F.col("not_modified")).alias("not_modified"),
        F.count_if(F.col("anomalous_drop")).alias("anomalous_drop"),
        F.count_if(state.isin("stale", "error", "blocked")).alias("stale"),
        F.count_if(state == "quarantined").alias("quarantined"),
    )


def decision_counts(rows: DataFrame, source: str, decision: str) -> DataFrame:
    """Counts by (source, decision), by decision and overall in one pass (A4)."""

    return rows.groupingSets([[source, decision], [decision], []], source, decision).agg(
        F.count("*").alias("rows"), F.grouping_id().alias("level"))


def reason_counts(rows: DataFrame, source: str, reasons: str) -> DataFrame:
    """Counts of reason codes by source and overall."""

    long = rows.select(source, F.explode(reasons).alias("reason"))
    return long.groupingSets([[source, "reason"], ["reason"]], source, "reason").agg(
        F.count("*").alias("rows"), F.grouping_id().alias("level"))


def audit_sources(rows: DataFrame, source: str, key: str, order: Sequence[Column], cohort: str = "cohort", batch: str = "batch",
                  unknown: str = d.UNKNOWN) -> tuple[DataFrame, DataFrame]:
    """(counts per source, first / middle / last sample rows)."""

    samples = spread_sample(rows, [source], order)
    counts = rows.groupBy(source).agg(
        F.count("*").alias("job_count"),
        F.count_if(F.col(cohort) == unknown).alias("unknown_cohort_count"),
        F.count_if(F.col(batch) == unknown).alias("unknown_batch_count"),
    )
    counts = counts.withColumn("sample_count", F.least(F.lit(3).cast("bigint"), F.col("job_count")))
    return counts.withColumn("meets_three_sample_target", F.col("sample_count") >= 3), samples


def domain_audit(rows: DataFrame, sources: DataFrame, source: str, host: Column) -> DataFrame:
    """Flag rows whose host is not under a domain of their source (J21). ``sources`` has one row per source with ``domains``."""

    from gleanery.functions.urls import host_under_any

    joined = lookup_join(rows, sources.select(source, "domains"), source, "left")
    return joined.withColumn("domain_valid", F.coalesce(host_under_any(host, "domains"), F.lit(False))).drop("domains")


def clamp_ratio(value: Column, default: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def filled_share(columns: Sequence[Column]) -> Column:
    """Share of filled fields over all rows of an aggregate."""

    filled = [F.sum(F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")).isin("", "[]", "{}"), 0).otherwise(1)) for c in columns]
    total = filled[0]
    for f in filled[1:]:
        total = total + f
    return F.coalesce(total / (F.count("*") * len(columns)), F.lit(0.0))


def evidence_counts(sources: DataFrame) -> DataFrame:
    """Registry counts by verification state."""

    status = F.col("status")
    return sources.agg(
        F.count("*").alias("source_count"), F.count_if(status == "VERIFIED").alias("verified"),
        F.count_if(status == "AUTO_VERIFIED").alias("auto_verified"), F.count_if(F.col("conclusion") == "PROVISIONAL").alias("provisional"),
        F.count_if(status == "QUARANTINED").alias("quarantined"), F.count_if(status == "BLOCKED").alias("blocked"),
    )
