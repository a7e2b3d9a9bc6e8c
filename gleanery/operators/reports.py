"""Rollups, directory, coverage, backlog and manifest reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import defaults as d
from gleanery.functions import urls
from gleanery.functions.dates import business_date, catalog_version
from gleanery.operators.gates import usable_leads
from gleanery.operators.provisional import page_counts
from gleanery.scale import keep_first, lookup_join, rank_rows


def fill_unknown(df: DataFrame, facts: DataFrame, key: str, columns: dict[str, str], unknown: str = d.UNKNOWN) -> DataFrame:
    """Take a fact from the company table where the row says unknown (J1). ``columns``: row column -> fact column."""

    side = facts.select(key, *[F.col(f).alias(f"_f_{c}") for c, f in columns.items()])
    joined = lookup_join(df, side, key, "left")
    for c in columns:
        fact = F.nullif(F.col(f"_f_{c}"), F.lit(""))
        joined = joined.withColumn(c, F.when(F.col(c) == unknown, F.coalesce(fact, F.col(c))).otherwise(F.col(c))).drop(f"_f_{c}")
    return joined


def with_source(df: DataFrame, sources: DataFrame, key: str, fallback: dict[str, Column]) -> DataFrame:
    """Source configuration of each row, derived from the row itself when it has none."""

    side = sources.select(key, *[F.col(c).alias(f"_s_{c}") for c in fallback])
    joined = lookup_join(df, side, key, "left")
    for c, value in fallback.items():
        joined = joined.withColumn(c, F.coalesce(F.col(f"_s_{c}"), value)).drop(f"_s_{c}")
    return joined


def rollup_sources(sources: DataFrame, company: str = "company_id") -> DataFrame:
    """Sources per company: counts, states and reasons (J5). The states and reasons are small closed sets."""

    ready = F.col("runnable")
    return sources.groupBy(company).agg(
        F.count("*").alias("source_count"), F.count_if(ready).alias("runnable_source_count"),
        F.count_if(F.col("status").isin(*d.VERIFIED_STATUSES)).alias("reviewed_source_count"),
        F.array_sort(F.collect_set("status")).alias("source_statuses"),
        F.array_sort(F.collect_set(F.when(~ready, F.col("gate_reason")))).alias("not_ready_reasons"),
        F.max(F.when(F.col("status").isin(*d.VERIFIED_STATUSES), F.col("verified_at"))).alias("last_verified_at"),
    )


def current_job_counts(jobs: DataFrame, cohort: str = d.COHORT, company: str = "company_id") -> DataFrame:
    """Active postings of the current cohort per company."""

    return jobs.filter((F.col("status") == "ACTIVE") & (F.col("cohort") == cohort)).groupBy(company).agg(F.count("*").alias("current_jobs"))


def next_action(runnable: Column, sources: Column) -> Column:
    return F.when(runnable > 0, "COLLECT").when(sources > 0, "REVIEW_SOURCE").otherwise("DISCOVER_OFFICIAL_SOURCE")


def is_large(employees: str = "employee_count", scale: str = "scale") -> Column:
    return F.coalesce((F.col(employees) >= 500) | F.col(scale).isin(*d.LARGE_SCALES), F.lit(False))


def priority_band(listed: Column, large: Column) -> Column:
    """0 listed and large, 1 large, 2 listed, 3 other (O3)."""

    return F.when(listed & large, 0).when(large, 1).when(listed, 2).otherwise(3)


def priority_reason(listed: Column, large: Column) -> Column:
    return (
        F.when(listed & large, "上市且员工数不少于500").when(large, "员工数不少于500")
        .when(listed, "已上市但员工规模尚未核验或不足500").otherwise("上市与员工规模尚待核验")
    )


def priority_order(name: str = "name", employees: str = "employee_count") -> list[Column]:
    """Focus list first, then evidence band, size and name (O3)."""

    return [
        F.col("focus_priority").isNull().cast("int").asc(), F.coalesce("focus_priority", F.lit(99)).asc(), F.col("priority_band").asc(),
        F.coalesce(employees, F.lit(0)).desc(), F.col(name).asc(),
    ]


def company_backlog(companies: DataFrame, sources: DataFrame, focus: DataFrame, company: str = "company_id") -> DataFrame:
    """Ranked companies with their sources and next action: rows of the coverage and backlog reports."""

    listed, large = F.col("listing_status") == "LISTED", is_large()
    rows = lookup_join(companies, focus.select(company, F.col("priority").alias("focus_priority"), F.col("segment").alias("focus_segment")), company, "left")
    rows = rows.join(rollup_sources(sources, company), company, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.withColumns({
        "priority_band": priority_band(listed, large), "priority_reason": priority_reason(listed, large), "large_company_evidence": large,
        "source_count": zero("source_count"), "runnable_source_count": zero("runnable_source_count"),
        "is_focus_company": F.col("focus_priority").isNotNull(),
    })
    rows = rows.withColumn("next_action", next_action(F.col("runnable_source_count"), F.col("source_count")))
    rows = rows.withColumn("do_not_publish_as_connected", F.col("runnable_source_count") == 0)
    return rank_rows(rows, [*priority_order(), F.col(company).asc()], rank="rank")


def backlog_summary(rows: DataFrame) -> DataFrame:
    """Counts over the backlog."""

    n = F.count_if
    return rows.agg(
        F.count("*").alias("company_count"), n(F.col("next_action") == "DISCOVER_OFFICIAL_SOURCE").alias("without_official_source"),
        n(F.col("runnable_source_count") > 0).alias("with_runnable_sources"), n(F.col("source_count") > 0).alias("with_sources"),
        n("large_company_evidence").alias("confirmed_large"), n(F.col("is_focus_company")).alias("focus_companies"),
        n(F.col("is_focus_company") & (F.col("source_count") > 0)).alias("focus_with_sources"),
        n(F.col("is_focus_company") & (F.col("runnable_source_count") > 0)).alias("focus_with_runnable_sources"),
        n((F.col("listing_status") == "LISTED") & F.col("large_company_evidence")).alias("listed_large"),
    )


def segment_counts(rows: DataFrame, segment: str = "focus_segment", fallback: str = "未分类") -> DataFrame:
    """Rows and distinct companies per segment."""

    name = F.coalesce(F.nullif(F.trim(F.col(segment)), F.lit("")), F.lit(fallback))
    return rows.groupBy(name.alias("segment")).agg(F.count("*").alias("rows"), F.countDistinct("company_id").alias("companies"))


def campaigns(jobs: DataFrame, now: Column, seq: Sequence[str] = ("last_verified_at", "id")) -> DataFrame:
    """One row per campaign: first posting supplies the header, newest check and status are added (A5)."""

    rows = jobs.filter((F.coalesce("campaign_id", F.lit("")) != "") & (F.coalesce("campaign_name", F.lit("")) != ""))
    header = keep_first(rows, ["campaign_id"], [F.col(c).asc() for c in seq]).select(
        "campaign_id", "company_id", "company_name", F.col("campaign_name").alias("name"), "cohort", "batch",
        F.col("campaign_open_date").alias("open_date"), F.coalesce("campaign_deadline", "deadline").alias("deadline"),
        F.coalesce("campaign_official_url", "source_url").alias("official_url"), "source_id")
    totals = rows.groupBy("campaign_id").agg(F.max("last_verified_at").alias("verified_at"), F.countDistinct("id").alias("job_count"))
    late = F.coalesce(F.col("deadline") < business_date(now), F.lit(False))
    return header.join(totals, "campaign_id").withColumn("status", F.when(late, "CLOSED").otherwise("OPEN"))


def campaign_jobs(jobs: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Membership table (campaign, job, first place). A campaign may hold any number of jobs, so they stay rows."""

    rows = jobs.filter((F.coalesce("campaign_id", F.lit("")) != "") & (F.coalesce("campaign_name", F.lit("")) != ""))
    return rows.groupBy("campaign_id", "id").agg(F.min(F.struct(*seq)).alias("first_at"))


def catalog_order(publish: str = "publish_date", company: str = "company_name", title: str = "title") -> list[Column]:
    """Newest first, then company and title downwards; a missing date counts as lowest (O1, O2)."""

    return [F.col(publish).desc_nulls_last(), F.col(company).desc(), F.col(title).desc()]


def list_projection(jobs: DataFrame, dropped: Sequence[str] = tuple(d.SUMMARY_DROPPED)) -> DataFrame:
    """Narrow list row: detail columns dropped, empty texts and arrays as NULL."""

    out = []
    for field in jobs.drop(*dropped).schema.fields:
        c, kind = F.col(field.name), field.dataType.typeName()
        if kind == "string":
            c = F.nullif(c, F.lit(""))
        elif kind == "array":
            c = F.when(F.size(c) > 0, c)
        out.append(c.alias(field.name))
    return jobs.select(*out)


def public_sources(sources: DataFrame, log: DataFrame, source: str = "source_id") -> DataFrame:
    """Publishable source row: internals stripped, evidence flattened, fetch result joined."""

    e = F.col("evidence")
    kept = sources.select(
        source, "company_id", "company_name", "source_url", "source_level", "status", "adapter", "access_mode", "verified_at",
        "robots_reviewed_at", "terms_reviewed_at", e["conclusion"].alias("auto_conclusion"), e["sampled_jobs"].alias("auto_sampled_jobs"),
        e["required_field_completeness"].alias("auto_field_completeness"), e["invalid_row_ratio"].alias("auto_invalid_row_ratio"),
        e["duplicate_ratio"].alias("auto_duplicate_ratio"), e["anomalous_drop"].alias("auto_anomalous_drop"))
    return kept.join(log, source, "left").withColumn("health", F.coalesce("health", F.lit("not_ready")))


SOURCE_COUNTS = ("raw_jobs", "normalised_jobs", "eligible_jobs", "review_jobs", "excluded_jobs")


def sources_after_run(sources: DataFrame, log: DataFrame, gated: DataFrame, source: str = "source_id") -> DataFrame:
    """Public source rows with what the run made of each (P26): fetched rows, those with sound links, and the audience decisions on them.

    ``gated`` holds the run's rows with ``link_problem`` and ``decision``. A source without rows counts zero; one that the run could not
    fetch counts nothing (NULL), so that "no jobs" and "not read" differ. Counts are partial sums before they meet.
    """

    counts = page_counts(gated, [source])
    out = lookup_join(public_sources(sources, log, source), counts, source)
    read = F.col("health") != "not_ready"
    return out.withColumns({c: F.when(read | F.col(c).isNotNull(), F.coalesce(c, F.lit(0))) for c in SOURCE_COUNTS}).withColumn(
        "eligible_share", F.when(F.col("normalised_jobs") > 0, F.round(F.col("eligible_jobs") / F.col("normalised_jobs"), 4)))


def company_directory(companies: DataFrame, sources: DataFrame, jobs: DataFrame, now: Column, cohort: str = d.COHORT,
                      leads: DataFrame | None = None, observations: DataFrame | None = None, focus: DataFrame | None = None,
                      origin: str = "registry/companies.json") -> DataFrame:
    """Public company entries (J5 to J9). With an observation table, only companies it shows as active appear.

    Inputs: companies(company_id, seq, name, career_url, ...), sources(company_id, seq, status, source_url, adapter,
    access_mode, verified_at), jobs(company_id, status, cohort), one observation per company.
    """

    key = "company_id"
    reviewed = F.col("status").isin(*d.VERIFIED_STATUSES)
    ordered = sources.withColumn("_reviewed", reviewed)
    best = keep_first(ordered, [key], [F.col("_reviewed").cast("int").desc(), F.col("seq").asc()]).select(
        key, F.col("source_url").alias("_best_url"), F.lower("adapter").alias("_adapter"), F.upper("access_mode").alias("_mode"), "_reviewed")
    firsts = keep_first(sources, [key], [F.col("seq").asc()]).select(key, F.col("source_url").alias("_first_url"))
    dated = sources.filter(reviewed).groupBy(key).agg(F.max("verified_at").alias("last_verified_at"))
    rows = rank_rows(companies, [F.col("seq").asc()], rank="directory_rank")
    for side in (best, firsts, dated, current_job_counts(jobs, cohort, key)):
        rows = rows.join(side, key, "left")
    if leads is not None:
        usable = keep_first(usable_leads(leads, cohort), [key], [F.coalesce("official_url_verified", F.lit(False)).cast("int").desc(), F.col("seq").asc()])
        usable = usable.select(key, F.col("official_url").alias("_lead_url"), F.col("source_url").alias("_lead_page"))
        rows = rows.join(usable, key, "left").withColumn("career_url", F.coalesce(F.nullif("career_url", F.lit("")), "_lead_url"))
    else:
        rows = rows.withColumn("_lead_url", F.lit(None).cast("string")).withColumn("_lead_page", F.lit(None).cast("string"))
    names = ["directory_status", "entry_type", "career_url", "evidence_url", "signals", "first_confirmed_at", "last_checked_at"]
    if observations is not None:
        seen = observations.filter(F.col("directory_status").isin("ACTIVE_CONFIRMED", "ACTIVE_LEAD"))
        rows = rows.join(seen.select(key, *[F.col(c).alias(f"_o_{c}") for c in names]), key, "inner")
    else:
        for c in names:
            kind = "array<string>" if c == "signals" else "timestamp" if c.endswith("_at") else "string"
            rows = rows.withColumn(f"_o_{c}", F.lit(None).cast(kind))
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = rows.withColumn("career_url", F.coalesce(text("_o_career_url"), text("career_url"), text("_first_url"))).filter("career_url is not null")
    has_review, jobs_now = F.coalesce("_reviewed", F.lit(False)), F.coalesce("current_jobs", F.lit(0))
    confirmed = has_review | (jobs_now > 0) | F.coalesce(F.col("_o_directory_status") == "ACTIVE_CONFIRMED", F.lit(False))
    by_source = (
        F.when(F.col("_best_url").isNull(), "ENTRY_LEAD")
        .when((F.col("_mode") == "JSON") | F.col("_adapter").isin("feishu", "beisen", "workday", "greenhouse", "lever", "successfactors", "moka"), "OFFICIAL_ATS")
        .when(F.lower("career_url").rlike("/campus|xiaozhao|school"), "OFFICIAL_CAMPAIGN_PAGE").otherwise("OFFICIAL_CAREER_SITE")
    )
    kind = F.when(F.col("_o_entry_type").isin(*d.ENTRY_TYPES), F.col("_o_entry_type")).otherwise(by_source)
    review_url = F.when(has_review, F.col("_best_url"))
    lead_page = F.when(review_url.isNull() & F.col("_lead_url").isNotNull(), F.coalesce(text("_lead_page"), "_lead_url"))
    marks = F.when(F.coalesce(F.size("_o_signals"), F.lit(0)) > 0, F.col("_o_signals")).otherwise(F.array(F.lit(f"{cohort} 届校招入口已登记")))
    note = (
        F.when(jobs_now > 0, F.concat(F.lit("已同步 "), jobs_now, F.lit(" 条合格岗位")))
        .when(F.coalesce(F.size("_o_signals"), F.lit(0)) > 0, F.lit(None).cast("string"))
        .when(confirmed, "官方校园招聘来源已核验").otherwise("入口线索待完成企业官网反向确认")
    )
    lead_used = F.col("_lead_url").isNotNull() & review_url.isNull()
    out = rows.select(
        *companies.columns, "directory_rank", F.lit(cohort).alias("cohort"), jobs_now.alias("current_jobs"),
        F.when(confirmed, "ACTIVE_CONFIRMED").otherwise("ACTIVE_LEAD").alias("directory_status"),
        F.when(confirmed, kind).otherwise("ENTRY_LEAD").alias("entry_type"),
        F.coalesce(text_of(review_url), text("_o_evidence_url"), lead_page, "career_url").alias("evidence_url"),
        F.array_compact(F.concat(marks, F.array(note))).alias("detected_signals"),
        F.concat(F.lit(origin), F.when(lead_used, "+community-leads.json").otherwise("")).alias("directory_source"),
        F.coalesce("_o_first_confirmed_at", F.when(has_review | (jobs_now > 0), now)).alias("first_confirmed_at"),
        F.coalesce("_o_last_checked_at", now).alias("last_checked_at"), "last_verified_at")
    if focus is not None:
        out = lookup_join(out, focus.select(key, F.col("segment").alias("focus_segment")), key, "left")
    return out


def text_of(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def directory_order() -> list[Column]:
    """Confirmed first, then name."""

    return [(F.col("directory_status") != "ACTIVE_CONFIRMED").cast("int").asc(), F.col("name").asc()]


def directory_summary(directory: DataFrame) -> DataFrame:
    """Directory counts."""

    lead = F.col("entry_type") == "ENTRY_LEAD"
    return directory.agg(
        F.count("*").alias("active_companies"), F.count_if(~lead).alias("official_entries"), F.count_if(lead).alias("entry_leads"),
        F.count_if(F.col("current_jobs") > 0).alias("companies_with_jobs"), F.sum("current_jobs").alias("eligible_jobs"),
        F.max("last_checked_at").alias("last_discovery_at"), F.max("last_verified_at").alias("last_verified_at"))


def manifest(jobs: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """One manifest row (A6, A7): one aggregate per input, put side by side."""

    today, active = business_date(now), F.col("status") == "ACTIVE"
    unknown = (F.coalesce(F.size("locations"), F.lit(0)) == 0) | F.exists("locations", lambda x: x["scope"] == "UNKNOWN")
    job_row = jobs.agg(
        F.count("*").alias("total_jobs"), F.count_if(active).alias("active_jobs"),
        F.count_if((F.col("publish_date") == today) & (F.col("publish_date_source") == "OFFICIAL")).alias("today_published"),
        F.count_if(business_date("first_seen_at") == today).alias("today_first_seen"), F.count_if(unknown).alias("unknown_location_count"),
        F.countDistinct(F.when(active & (F.col("cohort") == d.COHORT), F.col("company_id"))).alias("companies_with_jobs")).first()
    status, health = F.col("status"), F.col("health")
    fit = health.isin(*d.HEALTHY_STATES)
    row = sources.agg(
        F.count("*").alias("source_count"), F.count_if((status == "VERIFIED") & fit).alias("verified_source_count"),
        F.count_if((status == "AUTO_VERIFIED") & fit).alias("auto_verified_source_count"),
        *[F.count_if(health == h).alias(h) for h in ("healthy", "quarantined", "not_modified", "blocked", "error")],
        F.count_if((status == "STALE") | (health == "stale")).alias("stale"))
    publishable = F.col("verified_source_count") + F.col("auto_verified_source_count")
    row = row.withColumn("publishable_source_count", publishable).withColumn(
        "accessible_source_coverage_rate", F.when(F.col("source_count") > 0, F.round(publishable / F.col("source_count"), 4)))
    row = row.withColumns({k: F.lit(v) for k, v in job_row.asDict().items()})  # one row of counts
    return row.withColumn("catalog_version", catalog_version(now)).withColumn("business_date", today)


def coverage_rates(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4))


def domain_batch(candidates: DataFrame, order: Sequence[Column], domain: Column, start: int, size: int, max_domains: int = 100,
                 candidate: str = "candidate_id") -> DataFrame:
    """Next batch of candidates over at most ``max_domains`` domains (O10). Unknown domains pass and use no budget."""

    ranked = rank_rows(candidates.withColumn("_domain", domain), order, rank="_at").filter(F.col("_at") > start)
    known = ranked.filter("_domain <> 'unknown'")
    heads = known.groupBy("_domain").agg(F.min("_at").alias("_first")).orderBy("_first").limit(max_domains)  # bounded
    passed = ranked.filter("_domain = 'unknown'").unionByName(known.join(F.broadcast(heads.select("_domain")), "_domain", "left_semi").select(ranked.columns))
    return passed.orderBy("_at").limit(max(1, size)).drop("_domain", "_at")


def distinct_names_report(rows: DataFrame, name: str, url: str, rank: str) -> DataFrame:
    """Input report: distinct names, rows with a link, highest rank."""

    return rows.agg(
        F.countDistinct(F.nullif(F.col(name), F.lit(""))).alias("company_count"),
        F.count_if(F.coalesce(F.col(url), F.lit("")) != "").alias("entry_url_count"), F.max(rank).alias("index_size"), F.count("*").alias("record_count"))


def probe_summary(rows: DataFrame) -> DataFrame:
    """Counts of a discovery run."""

    return rows.agg(
        F.count("*").alias("checked"), F.count_if("reachable").alias("reachable"), F.count_if(F.col("detected_ats").isNotNull()).alias("ats_detected"),
        F.count_if(F.col("structured_job_count") > 0).alias("structured_pages"), F.count_if("blocked").alias("blocked"))


def provisional_summary(pages: DataFrame) -> DataFrame:
    """Totals of per-page collection counts."""

    return pages.agg(
        F.count("*").alias("page_count"), F.countDistinct("company_id").alias("company_count"), F.sum("raw_jobs").alias("raw_jobs"),
        F.sum("normalised_jobs").alias("normalised_jobs"), F.sum("eligible_jobs").alias("eligible_jobs"), F.sum("review_jobs").alias("review_jobs"))


def source_domains(sources: DataFrame) -> Column:
    return urls.traffic_domain(F.coalesce(F.nullif(F.col("ats_host"), F.lit("")), urls.url_host(F.coalesce("endpoint", "source_url"))))
