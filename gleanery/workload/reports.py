"""Rollups, backlog, campaigns and manifest."""

from datetime import datetime

from pyspark.sql import functions as F

from gleanery.functions.locations import location
from gleanery.operators import quality, reports
from gleanery.plans.catalog import build_catalog
from gleanery.scale import dealt_by_rows
from gleanery.workload import query
from gleanery.workload.gates import gate_sources
from gleanery.workload.joins import supplier_sources

def now():
    return F.lit("2001-07-20 12:00:00").cast("timestamp")


def companies(t):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("company_id"), F.col("c_name").alias("name"), F.when(k % 3 == 0, "LISTED").otherwise("UNKNOWN").alias("listing_status"), F.when(k % 4 != 0, F.col("c_acctbal").cast("int")).alias("employee_count"), F.when(k % 7 == 0, "10000+").otherwise("未知").alias("scale"))


def backlog(t):
    sources = supplier_sources(t).withColumn("company_id", F.col("seq") * 3)
    focus = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("company_id"), (F.col("c_custkey") % 3).cast("int").alias("priority"), F.concat(F.lit("S"), F.col("c_nationkey") % 4).alias("segment"))
    return reports.company_backlog(companies(t), sources, focus)


BACKLOG = """c as (select c_custkey, c_name, c_custkey % 3 = 0 as listed, case when c_custkey % 4 <> 0 then trunc(c_acctbal)::int end as emp, c_custkey % 7 = 0 as big, c_mktsegment = 'BUILDING' as foc, c_nationkey from customer),
    s as (select s_suppkey * 3 as id, count(*) as n, count(*) filter (where s_acctbal > 4000) as r from supplier group by 1),
    b as (select c.*, coalesce(emp >= 500, false) or big as large, coalesce(n, 0) as n, coalesce(r, 0) as r from c left join s on id = c_custkey),
    x as (select *, case when listed and large then 0 when large then 1 when listed then 2 else 3 end as band from b)"""


@query("A9_A10_company_backlog", f"""with {BACKLOG}
    select row_number() over (order by not foc, case when foc then c_custkey % 3 else 99 end, band, coalesce(emp, 0) desc, c_name, c_custkey) as rank, c_custkey as company_id, band as priority_band, n as source_count, r as runnable_source_count,
      case when r > 0 then 'COLLECT' when n > 0 then 'REVIEW_SOURCE' else 'DISCOVER_OFFICIAL_SOURCE' end as next_action, r = 0 as do_not_publish_as_connected from x""")
def a9(t):
    return backlog(t).select("rank", "company_id", "priority_band", "source_count", "runnable_source_count", "next_action", "do_not_publish_as_connected")


@query("A9_A24_backlog_summary", f"""with {BACKLOG}
    select count(*) as company_count, count(*) filter (where n = 0) as without_official_source, count(*) filter (where r > 0) as with_runnable_sources, count(*) filter (where n > 0) as with_sources, count(*) filter (where large) as confirmed_large,
      count(*) filter (where foc) as focus_companies, count(*) filter (where foc and n > 0) as focus_with_sources, count(*) filter (where foc and r > 0) as focus_with_runnable_sources, count(*) filter (where listed and large) as listed_large from x""")
def a9_summary(t):
    return reports.backlog_summary(backlog(t))


@query("A8_segment_counts", """
    select coalesce(nullif(trim(case when c_acctbal > 2000 then c_mktsegment else ' ' end), ''), '未分类') as segment, count(*) as rows, count(distinct o_custkey) as companies from orders join customer on c_custkey = o_custkey where o_orderstatus = 'O' group by 1""")
def a8(t):
    seg = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 2000, F.col("c_mktsegment")).otherwise(" ").alias("focus_segment"))
    rows = t.orders.filter("o_orderstatus = 'O'").join(seg, "o_custkey").withColumnRenamed("o_custkey", "company_id")
    return reports.segment_counts(rows)


def order_jobs(t):
    """Orders as postings, campaigns as market segment and year."""

    cust = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey", "c_name")
    o = t.orders.join(cust, "o_custkey")
    year = F.year("o_orderdate").cast("string")
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("c_name").alias("company_name"), F.concat_ws("-", "c_mktsegment", year).alias("campaign_id"), F.col("c_mktsegment").alias("campaign_name"), year.alias("cohort"),
        F.col("o_orderpriority").alias("batch"), day.alias("campaign_open_date"), F.date_add(day, 30).alias("campaign_deadline"), day.alias("deadline"), F.lit("https://x.example.com/").alias("campaign_official_url"), F.lit("https://x.example.com/").alias("source_url"),
        F.col("c_nationkey").alias("source_id"), F.col("o_orderdate").alias("last_verified_at"), F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("ACTIVE").alias("status"), day.alias("publish_date"),
        F.when(F.col("o_orderpriority") == "5-LOW", "UNKNOWN").otherwise("OFFICIAL").alias("publish_date_source"), F.col("o_orderdate").alias("first_seen_at"),
        F.array(location(scope=F.when(F.col("c_nationkey") == 3, "UNKNOWN").otherwise("OVERSEAS"), display_name="x", raw="x")).alias("locations"))


@query("A5_O2_campaigns", """
    with j as (select c_mktsegment || '-' || year(o_orderdate) as cid, * from orders join customer on c_custkey = o_custkey),
    h as (select * from (select *, row_number() over (partition by cid order by o_orderdate, o_orderkey) rn from j) where rn = 1),
    a as (select cid, count(distinct o_orderkey) as job_count, strftime(max(o_orderdate), '%Y-%m-%d') as verified from j group by 1)
    select h.cid as campaign_id, c_name as company_name, o_orderpriority as batch, strftime(o_orderdate, '%Y-%m-%d') as open_date, job_count, verified, case when o_orderdate + interval 30 days < date '2001-07-20' then 'CLOSED' else 'OPEN' end as status from h join a using (cid)""")
def a5(t):
    out = reports.campaigns(order_jobs(t), now())
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select("campaign_id", "company_name", "batch", day("open_date").alias("open_date"), "job_count", day("verified_at").alias("verified"), "status")


@query("A6_A7_manifest", """
    with j as (select *, (o_orderdate + interval 8 hours)::date as d from orders join customer on c_custkey = o_custkey), s as (select s_suppkey as k from supplier)
    select count(*) as total_jobs, count(*) filter (where o_orderstatus <> 'F') as active_jobs, count(*) filter (where o_orderdate::date = date '2001-07-20' and o_orderpriority <> '5-LOW') as today_published, count(*) filter (where d = date '2001-07-20') as today_first_seen,
      count(*) filter (where c_nationkey = 3) as unknown_location_count, (select count(*) from s) as source_count, (select count(*) from s where k % 3 = 0 and k % 4 in (0, 1)) as verified_source_count, (select count(*) from s where k % 3 = 1 and k % 4 in (0, 1)) as auto_verified_source_count,
      (select count(*) from s where k % 4 = 0) as healthy, (select count(*) from s where k % 4 = 2) as quarantined, (select round(count(*) filter (where k % 3 in (0, 1) and k % 4 in (0, 1)) / count(*), 4) from s) as rate, '2001.07.20.1200' as catalog_version from j""")
def a6(t):
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("s_suppkey") % len(names) + 1).cast("int"))
    sources = t.supplier.select(pick(["VERIFIED", "AUTO_VERIFIED", "TARGET"]).alias("status"), pick(["healthy", "not_modified", "quarantined", "error"]).alias("health"))
    out = reports.manifest(order_jobs(t), sources, now())
    return out.select("total_jobs", "active_jobs", "today_published", "today_first_seen", "unknown_location_count", "source_count", "verified_source_count", "auto_verified_source_count", "healthy", "quarantined",
                      F.col("accessible_source_coverage_rate").alias("rate"), "catalog_version")


@query("A14_provisional_summary", """
    with p as (select o_custkey, count(*) as raw, count(*) filter (where o_totalprice > 50000) as norm, count(*) filter (where o_totalprice > 250000) as ok from orders group by 1)
    select count(*) as page_count, count(distinct o_custkey % 100) as company_count, cast(sum(raw) as bigint) as raw_jobs, cast(sum(norm) as bigint) as normalised_jobs, cast(sum(ok) as bigint) as eligible_jobs, cast(sum(norm - ok) as bigint) as review_jobs from p""")
def a14(t):
    rows = t.orders.groupBy("o_custkey").agg(F.count("*").alias("raw_jobs"), F.count_if(F.col("o_totalprice") > 50000).alias("normalised_jobs"), F.count_if(F.col("o_totalprice") > 250000).alias("eligible_jobs"))
    return reports.provisional_summary(rows.withColumns({"company_id": F.col("o_custkey") % 100, "review_jobs": F.col("normalised_jobs") - F.col("eligible_jobs")}))


@query("A22_entry_state_counts", "select o_orderstatus as directory_status, count(*) as rows from orders group by 1")
def a22(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("directory_status")).agg(F.count("*").alias("rows"))


@query("A25_probe_summary", "select count(*) as checked, count(*) filter (where page_id % 2 = 0) as reachable, count(*) filter (where page_id % 3 = 0) as ats_detected, count(*) filter (where page_id % 5 > 0) as structured_pages, count(*) filter (where page_id % 7 = 0) as blocked from pages")
def a25(t):
    k = F.col("page_id")
    return reports.probe_summary(t.pages.select((k % 2 == 0).alias("reachable"), F.when(k % 3 == 0, "MOKA").alias("detected_ats"), (k % 5).alias("structured_job_count"), (k % 7 == 0).alias("blocked")))


@query("A26_input_report", "select count(distinct p_name) as company_count, count(*) filter (where p_size > 10) as entry_url_count, max(p_size) as index_size, count(*) as record_count from part")
def a26(t):
    return reports.distinct_names_report(t.part.withColumn("url", F.when(F.col("p_size") > 10, "https://x.example.com/")), "p_name", "url", "p_size")


@query("P25_P26_public_sources", """
    select s_suppkey as source_id, case when s_suppkey % 4 = 0 then 'PROVISIONAL' else 'AUTO_VERIFIED' end as auto_conclusion, s_suppkey % 6 as auto_sampled_jobs, case when s_suppkey % 2 = 0 then 'healthy' else 'not_ready' end as health, case when s_suppkey % 2 = 0 then s_suppkey * 2 else -1 end as job_count from supplier""")
def p25(t):
    sources = gate_sources(t).withColumns({"company_id": F.col("source_id"), "company_name": F.lit("x"), "source_level": F.lit("A")})
    log = t.supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("source_id"), F.lit("healthy").alias("health"), (F.col("s_suppkey") * 2).alias("job_count"))
    out = reports.public_sources(sources, log)
    return out.select("source_id", "auto_conclusion", "auto_sampled_jobs", "health", F.coalesce("job_count", F.lit(-1).cast("bigint")).alias("job_count"))


@query("A24_coverage_rate", "select n_nationkey, round(count(s_suppkey) filter (where s_acctbal > 4000) / count(s_suppkey), 4) as rate from nation join supplier on s_nationkey = n_nationkey group by 1")
def a24(t):
    rows = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_if(F.col("s_acctbal") > 4000).alias("part"), F.count("*").alias("whole"))
    return rows.select("n_nationkey", reports.coverage_rates(F.col("part"), F.col("whole")).alias("rate"))


@query("X15_source_domains", r"""
    with h as (select page_id, string_split(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '.') as labels from pages)
    select page_id as source_id, case when page_id % 5 = 0 then 'n' || page_id || '.com' else list_extract(labels, -2) || '.' || list_extract(labels, -1) end as domain from h""")
def x15(t):
    k = F.col("page_id")
    rows = t.pages.select(k.alias("source_id"), F.when(k % 5 == 0, F.concat(F.lit("boards.n"), k, F.lit(".com"))).otherwise("").alias("ats_host"),
                          F.when(k % 2 == 0, F.col("url")).alias("endpoint"), F.when(k % 2 == 0, "https://other.example.org/").otherwise(F.col("url")).alias("source_url"))
    return rows.select("source_id", reports.source_domains(rows).alias("domain"))


def catalog_run(t):
    """Parts as postings of 25 sources, the parts above size 25 known from the run before."""

    k, empty = F.col("p_partkey"), F.array().cast("array<string>")
    parts = dealt_by_rows(t.part.select("p_partkey", "p_brand", "p_name", "p_type", "p_size"), ["p_partkey"], 20_000)  # postings are wide
    rows = parts.select(
        F.concat(F.lit("s"), k % 25).alias("source_id"), k.cast("string").alias("source_job_id"), F.lower("p_brand").alias("company_id"), F.col("p_brand").alias("company_name"), F.concat("p_name", F.when(F.col("p_type") == "PROMO", " engineer").otherwise(" 运营专员")).alias("title"),
        F.lit("武汉市").alias("city"), F.array().cast("array<struct<scope:string,country_code:string,province_code:string,city_code:string,district_code:string,display_name:string,raw:string>>").alias("locations"), F.lit("运营").alias("role_category"),
        F.lit("未知").alias("company_industry"), F.lit("未知").alias("company_type"), F.lit("未知").alias("company_scale"), F.lit("2027").alias("cohort"), F.lit("秋招正式批").alias("batch"), F.lit("本科").alias("education"), empty.alias("major_tags"), empty.alias("skills"),
        F.lit("").alias("description"), empty.alias("requirements"), F.lit(None).cast("date").alias("publish_date"), F.lit("UNKNOWN").alias("publish_date_source"), F.lit(None).cast("date").alias("deadline"), F.concat(F.when(F.col("p_size") == 7, "http").otherwise("https"), F.lit("://jobs.example.com/"), k).alias("apply_url"),
        F.lit("https://jobs.example.com/campus").alias("source_url"), F.lit("x").alias("source_name"), F.lit("A").alias("source_level"), empty.alias("source_evidence"), F.when(F.col("p_size") != 9, F.lit(True)).otherwise(F.lit(False)).alias("is_campus"),
        F.concat_ws(":", F.lower("p_brand"), F.lit("2027")).alias("campaign_id"), F.lit("2027届秋招").alias("campaign_name"), F.lit(None).cast("date").alias("campaign_open_date"), F.lit(None).cast("date").alias("campaign_deadline"), F.lit("https://jobs.example.com/").alias("campaign_official_url"))
    ids = t.nation.select(F.concat(F.lit("s"), "n_nationkey").alias("source_id"), "n_nationkey")
    sources = ids.select("source_id", F.lit("c").alias("company_id"), F.lit("C").alias("company_name"), F.lit("https://jobs.example.com/campus").alias("source_url"), F.lit("example.com").alias("apply_domain"), empty.alias("apply_domains"), F.lit(None).cast("string").alias("ats_host"), F.lit("A").alias("source_level"),
                         F.lit("VERIFIED").alias("status"), F.lit("json").alias("adapter"), F.lit("JSON").alias("access_mode"), F.lit("2026-01-01").cast("date").alias("verified_at"), F.lit("2026-01-01").cast("date").alias("robots_reviewed_at"), F.lit("2026-01-01").cast("date").alias("terms_reviewed_at"),
                         F.lit(None).cast("struct<conclusion:string,sampled_jobs:int,required_field_completeness:double,invalid_row_ratio:double,duplicate_ratio:double,anomalous_drop:boolean>").alias("evidence"))
    log = ids.select("source_id", (F.col("n_nationkey") != 4).alias("complete"), F.lit(False).alias("not_modified"), F.when(F.col("n_nationkey") == 4, "error").otherwise("healthy").alias("health"), F.lit(None).cast("string").alias("reason"), F.lit(0).cast("bigint").alias("raw_count"), F.lit("2026-09-01").cast("timestamp").alias("fetched_at"))
    return build_catalog(rows, sources, log, datetime(2026, 9, 2, 4, 0))


@query("PLAN_catalog_sources", """
    select 's' || (p_partkey % 25) as source_id, count(*) filter (where p_type <> 'PROMO') as jobs from part where p_size not in (7, 9) group by 1 having count(*) filter (where p_type <> 'PROMO') > 0""")
def plan_sources(t):
    return catalog_run(t).jobs.groupBy("source_id").agg(F.count("*").alias("jobs"))


@query("PLAN_catalog_rejects", """
    select case when p_size = 9 then 'social_or_unverified_job' else 'unverified_apply_domain' end as reason, count(*) as rows from part where p_size in (7, 9) group by 1""")
def plan_rejects(t):
    return catalog_run(t).rejects.groupBy(F.split_part("reject_reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("rows"))


@query("PLAN_catalog_decisions", """
    select coalesce(source, '') as source, coalesce(decision, '') as decision, count(*) as rows from (select 's' || (p_partkey % 25) as source, case when p_type = 'PROMO' then 'OUT_OF_SCOPE' else 'TARGET_GENERALIST' end as decision from part where p_size not in (7, 9))
    group by grouping sets ((source, decision), (decision), ())""")
def plan_decisions(t):
    out = catalog_run(t).decisions
    return out.select(F.coalesce("source_id", F.lit("")).alias("source"), F.coalesce("audience_decision", F.lit("")).alias("decision"), "rows")


@query("A17_filled_quality", "select o_orderpriority as source, count(*) as rows, count(*) filter (where o_totalprice >= 5000) as accepted from orders group by 1")
def a17(t):
    counts = quality.source_counts(t.orders, ["o_orderpriority"], "o_orderkey", F.when(F.col("o_totalprice") < 5000, "missing_required_field"), F.lit(False))
    return counts.select(F.col("o_orderpriority").alias("source"), F.col("item_count").alias("rows"), "accepted")
