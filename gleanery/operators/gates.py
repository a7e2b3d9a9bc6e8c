"""Gates that return a decision and a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import defaults as d
from gleanery.functions import rules, urls
from gleanery.functions.audience import assess, is_publishable
from gleanery.functions.text import SPACE
from gleanery.scale import lookup_join


class GateFailed(RuntimeError):
    """A publication gate refused; nothing was written."""


def allowed_domains(apply_domain: Column, apply_domains: Column, ats_host: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_compact(F.concat(F.array(apply_domain), F.coalesce(apply_domains, empty), F.array(ats_host)))


def source_gate() -> Column:
    """May this source run? ``ready`` or the first reason against it (F13). Reads the source-config columns by name."""

    c = F.col
    adapter, status = F.lower(c("adapter")), c("status")
    mode = (
        F.when((c("access_mode") == "UNKNOWN") & adapter.isin(*d.JSON_ADAPTERS), "JSON")
        .when((c("access_mode") == "UNKNOWN") & adapter.isin(*d.FEED_ADAPTERS), "XML").otherwise(c("access_mode"))
    )
    endpoint = F.nullif(c("endpoint"), F.lit(""))
    feishu_host = F.lower(F.coalesce(F.nullif(c("ats_host"), F.lit("")), urls.url_host("source_url")))
    host = (
        F.when(adapter == "feishu", feishu_host).when(endpoint.isNotNull(), urls.url_host(endpoint))
        .when(mode == "DOM", urls.url_host("source_url"))
    )
    domains = allowed_domains(c("apply_domain"), c("apply_domains"), c("ats_host"))
    dom_ok = adapter.isin(*d.DOM_ADAPTERS) & F.coalesce(c("dom_ready"), F.lit(False))
    auto, ev = status == "AUTO_VERIFIED", c("evidence")
    no = lambda flag: ~F.coalesce(flag, F.lit(False))
    checks = [
        (no(c("enabled")), "disabled"),
        (~status.isin(*d.VERIFIED_STATUSES), F.concat(F.lit("status_"), F.lower(status))),
        ((status == "VERIFIED") & (c("verified_at").isNull() | c("robots_reviewed_at").isNull() | c("terms_reviewed_at").isNull()), "source_review_dates_incomplete"),
        ((mode == "DOM") & ~dom_ok, "adapter_requires_reviewed_dom_selectors"),
        ((mode == "HTML") & ~adapter.isin(*d.HTML_ADAPTERS), "html_requires_reviewed_adapter"),
        (mode.isin("RSS", "XML") & ~adapter.isin(*d.FEED_ADAPTERS), "feed_requires_reviewed_adapter"),
        ((mode == "JSONLD") & ~adapter.isin(*d.JSONLD_ADAPTERS), "jsonld_requires_reviewed_adapter"),
        ((mode == "SITEMAP") & ~adapter.isin(*d.SITEMAP_ADAPTERS), "sitemap_discovery_only"),
        ((mode != "DOM") & ~mode.isin(*d.RUNNABLE_MODES), "adapter_requires_reviewed_json_endpoint"),
        (urls.url_scheme("source_url") != "https", "source_url_requires_https"),
        ((adapter == "feishu") & ~feishu_host.endswith(".jobs.feishu.cn") & (feishu_host != "jobs.bytedance.com"), "invalid_feishu_host"),
        (host.isNull(), "endpoint_not_configured"),
        (endpoint.isNotNull() & (urls.url_scheme(endpoint) != "https"), "endpoint_requires_https"),
        (~urls.host_under_any(host, domains), "endpoint_domain_not_allowed"),
        (auto & ev.isNull(), "auto_evidence_report_missing"),
        (auto & (ev["conclusion"] != "AUTO_VERIFIED"), F.concat(F.lit("auto_evidence_"), F.lower(ev["conclusion"]))),
        (auto & adapter.isin(*d.NEVER_AUTOMATIC_ADAPTERS), "auto_adapter_not_allowlisted"),
        *[(auto & no(ev[flag]), reason) for flag, reason in d.EVIDENCE_FLAGS],
        (auto & (ev["sampled_jobs"] < 3), "auto_sample_count_insufficient"),
        (auto & (ev["required_field_completeness"] < 1.0), "auto_required_fields_incomplete"),
        (auto & (ev["invalid_row_ratio"] > 0.05), "auto_invalid_row_ratio_too_high"),
        (auto & (ev["duplicate_ratio"] > 0.05), "auto_duplicate_ratio_too_high"),
        (auto & ev["anomalous_drop"], "auto_anomalous_job_count_drop"),
        (auto & (ev["consecutive_healthy_runs"] < 2), "auto_health_runs_insufficient"),
    ]
    return rules.first_reason(checks)


def with_source_gate(sources: DataFrame) -> DataFrame:
    return sources.withColumn("gate_reason", source_gate()).withColumn("runnable", F.col("gate_reason") == "ready")


def evidence_reasons(adapter: str = "adapter", source_url: str = "source_url", endpoint: str = "endpoint", evidence: str = "evidence") -> Column:
    """All reasons against automatic verification, sorted and distinct."""

    name, ev = F.lower(F.col(adapter)), F.col(evidence)
    link = F.nullif(F.col(endpoint), F.lit(""))
    reasons = rules.reason_list(
        (~name.isin(*d.EVIDENCE_ADAPTERS), "adapter_not_allowlisted"),
        (name.isin(*d.NEVER_AUTOMATIC_ADAPTERS), "manual_or_blocked_connector"),
        (urls.url_scheme(source_url) != "https", "source_url_requires_https"),
        (link.isNotNull() & (urls.url_scheme(link) != "https"), "endpoint_requires_https"),
        *[(~F.coalesce(ev[flag], F.lit(False)), reason) for flag, reason in d.EVIDENCE_FLAGS],
        (ev["sampled_jobs"] < 3, "sample_count_insufficient"),
        (ev["required_field_completeness"] < 1.0, "required_fields_incomplete"),
        (ev["invalid_row_ratio"] > 0.05, "invalid_row_ratio_too_high"),
        (ev["duplicate_ratio"] > 0.05, "duplicate_ratio_too_high"),
        (ev["anomalous_drop"], "anomalous_job_count_drop"),
        (ev["consecutive_healthy_runs"] < 2, "healthy_runs_insufficient"),
    )
    return F.array_sort(F.array_distinct(reasons))


def evidence_conclusion(reasons: str | Column) -> Column:
    reasons = F.col(reasons) if isinstance(reasons, str) else reasons
    blocking = F.array(*[F.lit(r) for r in ("manual_or_blocked_connector", "source_url_requires_https", "endpoint_requires_https")])
    return F.when(F.size(reasons) == 0, "AUTO_VERIFIED").when(F.arrays_overlap(reasons, blocking), "BLOCKED").otherwise("PROVISIONAL")


def url_gate(job_source_url: Column, apply_url: Column, reviewed_url: Column, domains: Column) -> Column:
    """NULL when both links of a posting stay on reviewed https domains, else the reason (F16)."""

    page, link = urls.url_host(job_source_url), urls.url_host(apply_url)
    return (
        F.when((urls.url_scheme(job_source_url) != "https") | (page == "") | (urls.url_host(reviewed_url) == ""), F.concat(F.lit("unverified_source_url:"), job_source_url))
        .when(~(urls.host_under_any(page, F.array(urls.url_host(reviewed_url))) | urls.host_under_any(page, domains)), F.concat(F.lit("unverified_source_domain:"), page))
        .when(F.coalesce(urls.url_scheme(apply_url) != "https", F.lit(True)) | ~urls.host_under_any(link, domains), F.concat(F.lit("unverified_apply_domain:"), F.coalesce(link, F.lit(""))))
    )


def exact_or_mixed(value: Column, exact: str = d.STATE_OWNED) -> Column:
    """``exact``, ``mixed`` (holds the value among others: to review) or ``other``."""

    text = F.regexp_replace(F.coalesce(value, F.lit("")), SPACE, "")
    return F.when(text == exact, "exact").when(text.contains(exact), "mixed").otherwise("other")


def usable_leads(leads: DataFrame, cohort: str = d.COHORT) -> DataFrame:
    """Community leads that may fill a missing address."""

    title = rf"(?i){cohort}\s*(?:届|级|校招|校园招聘)|秋招|秋季校园招聘"
    verified = F.coalesce(F.col("official_url_verified"), F.lit(False))
    waiting = F.coalesce(F.col("verification_status"), F.lit("NEEDS_REVIEW")) == "NEEDS_REVIEW"
    return leads.filter(
        (F.coalesce(F.col("company_id").cast("string"), F.lit("")) != "") & F.coalesce(F.col("official_url").startswith("https://"), F.lit(False))
        & F.col("title").rlike(title) & (verified | waiting))


def access_class(status: str | Column) -> Column:
    """Class of a fetch status: blocked, missing, server error, other error, ok."""

    status = F.col(status) if isinstance(status, str) else status
    return (
        F.when(status.isin(*d.BLOCKED_HTTP), "access_blocked").when(status == 404, "not_found")
        .when(status >= 500, "transient_server_error").when(status >= 400, "unexpected_status")
        .when((status >= 200) & (status < 400), "ok").otherwise("unreachable")
    )


def is_retryable(status: str | Column) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return F.coalesce((status >= 500) & ~status.isin(*d.BLOCKED_HTTP), F.lit(False))


def catalog_check(jobs: DataFrame, required: Sequence[str] = tuple(d.REQUIRED_JOB_FIELDS), links: Sequence[str] = ("apply_url", "source_url"),
                  active: Column | None = None) -> DataFrame:
    """One row: active rows, complete rows, completeness, rows with a link that is not https."""

    active = F.col("status") == "ACTIVE" if active is None else active
    full = F.lit(True)
    for c in required:
        full = full & (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    bad = F.lit(False)
    for c in links:
        bad = bad | F.coalesce(urls.url_scheme(c) != "https", F.lit(True))
    out = jobs.filter(active).agg(F.count("*").alias("active_jobs"), F.count_if(full).alias("complete_jobs"), F.count_if(bad).alias("non_https_links"))
    return out.withColumn("completeness", F.when(F.col("active_jobs") > 0, F.col("complete_jobs") / F.col("active_jobs")))


def require_catalog(jobs: DataFrame, minimum: float = 0.95) -> None:
    row = catalog_check(jobs).first()
    if not row["active_jobs"]:
        raise GateFailed("release_gate_no_active_jobs")
    if row["completeness"] < minimum:
        raise GateFailed(f"release_gate_required_fields:{row['completeness']:.3f}<{minimum:.3f}")
    if row["non_https_links"]:
        raise GateFailed(f"release_gate_non_https_links:{row['non_https_links']}")


def audience_violations(listed: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """List rows without detail, and detail rows the audience gate refuses (J17). Closed rows are checked too."""

    missing = listed.select(key).join(details.select(key), key, "left_anti").withColumn("violation", F.lit("missing_detail_job"))
    checked = assess(details.join(listed.select(key), key, "left_semi")).filter(~is_publishable())
    refused = checked.select(key, F.concat(F.lit("audience_policy:"), F.col("audience.decision"), F.lit(":"), F.array_join("audience.reason_codes", ",")).alias("violation"))
    return missing.unionByName(refused)


def directory_violations(rows: DataFrame, key: str = "company_id") -> DataFrame:
    """Directory rows that may not be published, with the reason."""

    seen = rows.groupBy(key).agg(F.count("*").alias("_n"))
    joined = lookup_join(rows, seen, key, "left")
    bad_link = lambda c: F.coalesce((urls.url_scheme(c) != "https") | (urls.url_host(c) == ""), F.lit(True))
    status, kind = F.col("directory_status"), F.col("entry_type")
    reason = (
        F.when((F.trim(F.coalesce(F.col(key), F.lit(""))) == "") | (F.col("_n") > 1) | status.isNull(), "invalid_company_directory_record")
        .when(~status.isin(*d.DIRECTORY_STATUSES), "invalid_directory_status").when(~kind.isin(*d.ENTRY_TYPES) | kind.isNull(), "invalid_entry_type")
        .when(~status.isin("ACTIVE_CONFIRMED", "ACTIVE_LEAD"), "inactive_company_directory")
        .when(bad_link("career_url") | bad_link("evidence_url"), "non_https_company_directory")
        .when((status == "ACTIVE_LEAD") & (kind != "ENTRY_LEAD"), "lead_entry_type_mismatch")
        .when((status == "ACTIVE_CONFIRMED") & (kind == "ENTRY_LEAD"), "confirmed_entry_type_mismatch")
    )
    return joined.withColumn("violation", reason).filter("violation is not null").select(key, "violation")


def manifest_violations(manifest: DataFrame, reports: DataFrame, minimum_sources: int) -> DataFrame:
    """Violations of a one-row manifest and its verification reports."""

    seen = reports.agg(
        F.count("*").alias("reports"), F.count_if(F.coalesce(F.col("conclusion") != "AUTO_VERIFIED", F.lit(True))).alias("open"),
        F.countDistinct("source_id").alias("ids")).first()  # one row of counts
    total, still_open, ids = F.lit(seen["reports"]), F.lit(seen["open"]), F.lit(seen["ids"])
    v, a, p, n = F.col("verified_source_count"), F.col("auto_verified_source_count"), F.col("publishable_source_count"), F.col("source_count")
    reasons = rules.reason_list(
        (F.col("is_demo"), "demo_catalog"), (p < minimum_sources, "verified_sources"),
        ((a < 0) | (v < 0) | (p != v + a), "invalid_publishable_source_counts"), (n < p, "invalid_source_counts"),
        ((a > 0) & (total < a), "auto_verification_reports_missing"), ((a > 0) & (still_open > 0), "auto_verification_incomplete"),
        ((a > 0) & (ids != total), "auto_verification_source_ids"),
    )
    return manifest.select(F.explode(reasons).alias("violation"))


def require_none(violations: DataFrame, prefix: str = "release_gate_") -> None:
    """Raise on the first violation: an action, run before any write."""

    first = violations.select("violation").limit(1).collect()
    if first:
        raise GateFailed(prefix + first[0]["violation"])


def require_verified_sources(sources: DataFrame, minimum: int) -> int:
    """Stop a run with too few verified, healthy sources before anything is written."""

    live = sources.filter(F.col("status").isin(*d.VERIFIED_STATUSES) & F.col("health").isin(*d.HEALTHY_STATES)).count()
    if minimum and live < minimum:
        raise GateFailed(f"verified_source_gate_failed:{live}<{minimum}")
    return live


def dense_rank_check(rows: DataFrame, rank: str, expected: int, name_keys: Column, required: Sequence[str] = ()) -> DataFrame:
    """One row saying whether ranks are exactly 1..expected, names unique and required fields filled."""

    blank = F.lit(False)
    for c in required:
        blank = blank | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    named = rows.withColumn("_key", name_keys)
    out = named.agg(
        F.count("*").alias("row_count"), F.countDistinct(rank).alias("ranks"), F.min(rank).alias("low"), F.max(rank).alias("high"),
        F.countDistinct("_key").alias("names"), F.count_if(blank).alias("blank_rows"))
    sequence = (F.col("ranks") == expected) & (F.col("low") == 1) & (F.col("high") == expected)
    reasons = rules.reason_list(
        (F.col("row_count") != expected, F.concat(F.lit("row_count_"), F.col("row_count"), F.lit(f"_expected_{expected}"))),
        (~F.coalesce(sequence, F.lit(False)), "rank_sequence_incomplete_or_duplicate"), (F.col("blank_rows") > 0, "empty_required_field"),
        (F.col("names") != F.col("row_count"), "duplicate_name"))
    return out.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


def newer_if_valid(new: DataFrame, previous: DataFrame, check: DataFrame) -> DataFrame:
    """The new table when its check row says valid, else the previous one."""

    return new if check.select("valid").first()[0] else previous
