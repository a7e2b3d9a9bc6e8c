"""Provisional collection flow: landing pages, sources, gated jobs and the web catalog, over parts and suppliers as reports."""

from pyspark.sql import functions as F

from gleanery.functions import locations
from gleanery.operators import provisional
from gleanery.operators.gates import url_gate
from gleanery.workload import query


def report(t):
    """Suppliers as candidates: an entry twice (the later one counts), the same page as a link, a relative link, a sitemap and a bad link."""

    k = F.col("s_suppkey")
    entry = lambda vendor, n, feeds: F.struct(F.lit("/jobs#top").alias("landing_url"), vendor.alias("detected_ats"), n.cast("int").alias("structured_job_count"), F.lit("").alias("current_cohort_signal"), feeds.alias("feed_links"))
    none = F.array().cast("array<string>")
    vendor = F.when(k % 3 == 0, "moka").when(k % 3 == 1, "JSONLD").otherwise("")
    feeds = F.when(k % 4 == 0, F.array(F.lit("https://x.example.com/feed.rss"))).otherwise(none)
    return t.supplier.select(
        k.alias("seq"), F.concat(F.lit("c"), k % 50).alias("candidate_id"), F.when(k % 2 == 0, k.cast("string")).alias("stock_code"), F.concat(F.lit("https://h"), k % 50, F.lit(".example.com/")).alias("homepage"),
        F.when(k % 5 == 0, "NEEDS_MANUAL_REVIEW").otherwise("CONNECTOR_CANDIDATE").alias("classification"),
        F.array(entry(F.lit("LEVER"), F.lit(0), none), entry(vendor, F.lit(0), feeds)).cast(f"array<{provisional.ENTRY}>").alias("entries"),
        F.array(F.lit("/jobs"), F.concat(F.lit("list/"), k % 7), F.lit("/sitemap.xml"), F.lit("javascript:void(0)")).alias("links"))


PAGES = """with r as (select s_suppkey as k, 'c' || s_suppkey % 50 as candidate_id, 'https://h' || s_suppkey % 50 || '.example.com/' as home from supplier),
    m as (select k, candidate_id, home || 'jobs' as landing_url, true as entry from r union all select k, candidate_id, home || 'list/' || k % 7, false from r),
    p as (select candidate_id, landing_url, entry, min(k) as seq from m group by 1, 2, 3)"""


@query("P33_landing_pages", PAGES + " select candidate_id, landing_url, seq, entry as has_entry from p")
def p33(t):
    return provisional.landing_pages(report(t), "seq").select("candidate_id", "landing_url", "seq", F.col("entry").isNotNull().alias("has_entry"))


@query("P33_connectors_only", PAGES.replace("from supplier", "from supplier where s_suppkey % 5 <> 0") + " select candidate_id, landing_url, seq from p")
def p33_only(t):
    return provisional.landing_pages(report(t), "seq", include_review=False).select("candidate_id", "landing_url", "seq")


@query("P34_provisional_sources", PAGES + """,
    s as (select *, 'soe-provisional-' || case when seq % 2 = 0 then lpad(seq::varchar, 6, '0') else candidate_id end as company_id, entry and seq % 3 = 1 as structured, entry and seq % 4 = 0 as feed from p)
    select company_id || '-' || substr(sha256(landing_url), 1, 12) as source_id, company_id, case when structured then 'jsonld' when feed then 'rss' else 'provisional_html' end as adapter,
      case when entry and seq % 3 = 0 then regexp_extract(landing_url, '//([^/]*)', 1) else '-' end as ats_host, case when not entry or seq % 3 = 2 then '-' when seq % 3 = 0 then 'MOKA' else 'JSONLD' end as detected_ats, 1 as domains from s""")
def p34(t):
    out = provisional.provisional_sources(provisional.landing_pages(report(t), "seq"))
    return out.select("source_id", "company_id", "adapter", F.coalesce("ats_host", F.lit("-")).alias("ats_host"), F.coalesce("detected_ats", F.lit("-")).alias("detected_ats"), F.size("apply_domains").alias("domains"))


def parsed_jobs(t):
    """Parts as rows parsed from pages of brands; each id stands on two pages."""

    empty = F.array().cast("array<string>")
    city = F.when(F.col("p_size") % 4 == 0, "未知").when(F.col("p_size") % 4 == 1, "本科学历").otherwise("武汉市")
    rows = t.part.select(
        F.col("p_brand").alias("page"), F.concat(F.lit("j"), F.floor(F.col("p_partkey") / 2)).alias("id"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("company_id"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("company_name"), city.alias("city"),
        F.when(F.col("p_type") == "PROMO", "后端研发").when(F.col("p_size") > 40, "储备干部").otherwise("品牌推广岗").alias("title"), F.lit("其他").alias("role_category"), empty.alias("requirements"), F.lit("").alias("description"), empty.alias("major_tags"),
        locations.normalize_locations(city).alias("locations"), F.concat(F.when(F.col("p_size") == 7, "http").otherwise("https"), F.lit("://jobs.example.com/"), "p_partkey").alias("apply_url"))
    page = F.lit("https://jobs.example.com/list")
    return provisional.gated_jobs(rows, url_gate(page, F.col("apply_url"), page, F.array(F.lit("jobs.example.com"))))


JOBS = """with j as (select *, 'j' || (p_partkey // 2) as id, p_size <> 7 as ok, case when p_type = 'PROMO' then 'OUT' when p_size > 40 then 'REVIEW' else 'TARGET' end as decision from part)"""


@query("P36_page_counts", JOBS + """ select p_brand as page, count(*) as raw_jobs, count(*) filter (where ok) as normalised_jobs, count(*) filter (where ok and decision = 'TARGET') as eligible_jobs,
    count(*) filter (where ok and decision = 'REVIEW') as review_jobs, count(*) filter (where ok and decision = 'OUT') as excluded_jobs from j group by 1""")
def p36(t):
    return provisional.page_counts(parsed_jobs(t), ["page"])


CATALOG = JOBS + ", w as (select *, row_number() over (partition by id order by p_partkey) rn from j where ok and decision in ('TARGET', 'REVIEW'))"


@query("P35_web_catalog", CATALOG + """ select id, p_partkey as seq, case when p_size % 4 in (0, 1) then '地点待确认' else '武汉市' end as city, case when p_size > 5 then p_brand else '公开入口' end || ' · 公开入口临时采集' as source_name, '公开入口临时采集 · 待核验' as publication_label from w where rn = 1""")
def p35(t):
    return provisional.web_catalog(parsed_jobs(t), ["seq"], include_review=True).select("id", "seq", "city", "source_name", "publication_label")


@query("P35_catalog_summary", CATALOG + " select count(*) as job_count, count(distinct p_type) as company_count, count(*) filter (where decision = 'TARGET') as eligible_count, count(*) filter (where decision = 'REVIEW') as review_count from w where rn = 1")
def p35_summary(t):
    return provisional.catalog_summary(provisional.web_catalog(parsed_jobs(t), ["seq"], include_review=True))


@query("P27_entry_summary", "select 'c' || s_suppkey as candidate_id, 'https://h.example.com/campus/' || s_suppkey as landing_url, case when s_suppkey % 3 = 0 then 'MOKA' else 'NONE' end as detected_ats, case when s_suppkey % 2 = 0 then 'a,b' else '' end as review_reasons from supplier")
def p27(t):
    k = F.col("s_suppkey")
    rows = t.supplier.select(
        F.concat(F.lit("c"), k).alias("candidate_id"), F.concat(F.lit("https://h.example.com/campus/"), k, F.lit("#x")).alias("landing_url"), F.when(k % 3 == 0, "MOKA").alias("detected_ats"),
        F.lit("CONNECTOR_CANDIDATE").alias("classification"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("review_reasons"))
    return provisional.entry_summary(rows).select("candidate_id", "landing_url", "detected_ats", "review_reasons")
