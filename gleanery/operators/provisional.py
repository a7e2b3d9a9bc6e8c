"""Provisional collection: landing pages of a discovery report, their sources, gated and counted jobs, and the labelled web catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.functions.audience import assess
from gleanery.functions.locations import repair_web_locations
from gleanery.scale import keep_first

# --- fixed values: labels and adapter evidence -------------------------------------------------------------
LABEL = "公开入口临时采集 · 待核验"
SOURCE_LABEL = "公开入口临时采集"
UNNAMED = "公开入口"
CITY_TO_CONFIRM = "地点待确认"
NOT_A_CITY = "学历|专业|经验|熟悉|负责|能够|具备|要求"
VENDORS_WITH_HOST = ["BEISEN", "MOKA", "FEISHU", "GREENHOUSE", "LEVER", "ASHBY"]
STRUCTURED = ["JSONLD", "JOBPOSTING"]
ENTRY = "struct<landing_url:string,detected_ats:string,structured_job_count:int,current_cohort_signal:string,feed_links:array<string>>"


def entry_summary(rows: DataFrame) -> DataFrame:
    """Short form of probed entries (P27): address, kind, vendor, class and why it needs a look."""

    return rows.select(
        "candidate_id", urls.page_url("landing_url").alias("landing_url"), urls.entry_type_for_url(F.col("landing_url")).alias("entry_type"),
        F.coalesce("detected_ats", F.lit("NONE")).alias("detected_ats"), "classification", F.array_join("review_reasons", ",").alias("review_reasons"))


def landing_pages(report: DataFrame, seq: str, include_review: bool = True) -> DataFrame:
    """One row per (candidate, landing page) of a report.

    ``report``: candidate_id, homepage, classification, entries (array of ENTRY), links (array<string>) and anything else. Addresses are
    resolved against the homepage; sitemaps are left out. Of one page's mentions the first report row counts, in it an entry before a
    plain link, and the last entry.
    """

    rows = report.filter(F.coalesce("candidate_id", F.lit("")) != "")
    if not include_review:
        rows = rows.filter("classification = 'CONNECTOR_CANDIDATE'")
    entries = F.transform(F.coalesce("entries", F.array().cast(f"array<{ENTRY}>")), lambda e, i: F.struct(e["landing_url"].alias("url"), F.lit(1).alias("rank"), i.alias("at"), e.alias("entry")))
    links = F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda u, i: F.struct(u.alias("url"), F.lit(0).alias("rank"), i.alias("at"), F.lit(None).cast(ENTRY).alias("entry")))
    mentions = rows.withColumn("_m", F.explode(F.concat(entries, links)))
    kept = [c for c in report.columns if c not in ("entries", "links")]
    mentions = mentions.select(*kept, F.col("_m.rank").alias("_rank"), F.col("_m.at").alias("_at"), F.col("_m.entry").alias("entry"), urls.absolute_url("_m.url", F.coalesce("homepage", F.lit(""))).alias("_url"))
    mentions = mentions.withColumn("landing_url", urls.page_url("_url")).filter(F.col("landing_url").isNotNull())
    mentions = mentions.filter(~urls.is_sitemap_url("landing_url")).drop("_url")
    order = [F.col(seq).asc(), F.col("_rank").desc(), F.col("_at").desc()]
    return keep_first(mentions, ["candidate_id", "landing_url"], order).drop("_rank", "_at")


def provisional_sources(pages: DataFrame) -> DataFrame:
    """Source settings of landing pages, with the adapter the evidence allows (P34). Every one waits for review."""

    digits = F.regexp_replace(F.coalesce("stock_code", F.lit("")), "[^0-9]", "")
    code = F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0"))
    company = F.concat(F.lit("soe-provisional-"), F.when(digits != "", code).otherwise(F.col("candidate_id")))
    host, home = urls.url_host("landing_url"), urls.url_host(F.coalesce("homepage", F.lit("")))
    vendor = F.upper(F.coalesce(F.col("entry.detected_ats"), F.lit("")))
    structured = vendor.isin(*STRUCTURED) | (F.coalesce(F.col("entry.structured_job_count"), F.lit(0)) > 0)
    feed = urls.is_feed_url("landing_url") | F.exists(F.coalesce(F.col("entry.feed_links"), F.array().cast("array<string>")), lambda u: F.coalesce(urls.is_feed_url(u), F.lit(False)))
    pick = lambda a, b, c: F.when(structured, a).when(feed, b).otherwise(c)
    return pages.select(
        F.concat(company, F.lit("-"), F.substring(F.sha2("landing_url", 256), 1, 12)).alias("source_id"), company.alias("company_id"),
        F.col("landing_url").alias("source_url"), host.alias("apply_domain"), F.array_distinct(F.filter(F.array(host, home), lambda h: h != "")).alias("apply_domains"),
        F.when(vendor.isin(*VENDORS_WITH_HOST), host).alias("ats_host"), pick("jsonld", "rss", "provisional_html").alias("adapter"), pick("JSONLD", "XML", "HTML").alias("access_mode"),
        F.nullif(vendor, F.lit("")).alias("detected_ats"), F.nullif("entry.current_cohort_signal", F.lit("")).alias("current_cohort_signal"),
        F.lit("B").alias("source_level"), F.lit("TARGET").alias("status"), F.lit(True).alias("requires_manual_review"))


def gated_jobs(jobs: DataFrame, link_problem: Column) -> DataFrame:
    """Parsed rows with ``link_problem`` and the audience decision (P36); rows with a bad link are judged too, but count as refused."""

    return assess(jobs.withColumn("link_problem", link_problem)).withColumn("decision", F.when(F.col("link_problem").isNull(), F.col("audience.decision")))


def page_counts(gated: DataFrame, page: Sequence[str]) -> DataFrame:
    """Raw, normalised, eligible, review and excluded rows per page (P36). Partial sums meet in the shuffle, so a large page is no hot task."""

    ok = F.col("link_problem").isNull()
    count = lambda decision: F.count_if(F.col("decision") == decision)
    return gated.groupBy(*page).agg(
        F.count("*").alias("raw_jobs"), F.count_if(ok).alias("normalised_jobs"), count("TARGET_GENERALIST").alias("eligible_jobs"),
        count("NEEDS_REVIEW").alias("review_jobs"), count("OUT_OF_SCOPE").alias("excluded_jobs"))


def web_catalog(gated: DataFrame, order: Sequence[str], include_review: bool = False) -> DataFrame:
    """Labelled browser rows (P35): eligible jobs, on request also those to review, first mention per id, places repaired."""

    wanted = ["TARGET_GENERALIST", *(["NEEDS_REVIEW"] if include_review else [])]
    rows = gated.filter(F.col("decision").isin(*wanted) & (F.coalesce("id", F.lit("")) != ""))
    first = keep_first(rows, ["id"], [F.col(c).asc() for c in order])
    city = F.trim(F.coalesce("city", F.lit("")))
    odd = (city == "") | (city == "未知") | (F.length(city) > 80) | city.rlike(NOT_A_CITY)
    company = F.coalesce(F.nullif("company_name", F.lit("")), F.lit(UNNAMED))
    return first.withColumns({
        "provisional": F.lit(True), "publication_label": F.lit(LABEL), "source_status": F.lit("TARGET"), "source_name": F.concat(company, F.lit(" · "), F.lit(SOURCE_LABEL)),
        "locations": repair_web_locations("locations"), "city": F.when(odd, CITY_TO_CONFIRM).otherwise(F.col("city"))})


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Job, company, eligible and review counts of a web catalog."""

    return catalog.agg(
        F.count("*").alias("job_count"), F.countDistinct(F.nullif("company_id", F.lit(""))).alias("company_count"),
        F.count_if(F.col("decision") == "TARGET_GENERALIST").alias("eligible_count"), F.count_if(F.col("decision") == "NEEDS_REVIEW").alias("review_count"))
