"""Lookups, anti-joins and entity resolution."""

from pyspark.sql import functions as F

from gleanery.functions.text import name_key
from gleanery.operators import facets, gates, reports, resolve
from gleanery.sources import registry
from gleanery.workload import query

PART_KEYS = "lower(regexp_replace(p_name, '[^0-9A-Za-z]', '', 'g'))"


@query("J1_fill_unknown", """
    select o_orderkey, case when o_orderpriority = '4-NOT SPECIFIED' then c_mktsegment else o_orderpriority end as priority from orders left join customer on c_custkey = o_custkey""")
def j1(t):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("priority"))
    facts = t.customer.select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return reports.fill_unknown(rows, facts, "k", {"priority": "c_mktsegment"}, "4-NOT SPECIFIED").select("o_orderkey", "priority")


@query("J2_source_or_fallback", """
    select l_orderkey, l_linenumber, l_partkey, coalesce(s_name, 'fixture-' || l_suppkey) as source_name from lineitem left join (select * from supplier where s_acctbal > 0) s on s_suppkey = l_suppkey""")
def j2(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    sources = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("source_name"))
    out = reports.with_source(rows, sources, "l_suppkey", {"source_name": F.concat(F.lit("fixture-"), F.col("l_suppkey"))})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "source_name")


def supplier_sources(t):
    names = F.array(*[F.lit(x) for x in ("VERIFIED", "AUTO_VERIFIED", "TARGET", "BLOCKED")])
    ready = F.col("s_acctbal") > 4000
    return t.supplier.select(
        F.col("s_nationkey").alias("company_id"), F.col("s_suppkey").alias("seq"), F.element_at(names, F.col("s_nationkey") % 4 + 1).alias("status"), ready.alias("runnable"),
        F.when(ready, "ready").otherwise(F.concat(F.lit("r"), F.col("s_suppkey") % 3)).alias("gate_reason"), F.lit(None).cast("date").alias("verified_at"),
        F.concat(F.lit("https://s"), F.col("s_suppkey"), F.lit(".example.com/campus")).alias("source_url"), F.lit("html").alias("adapter"), F.lit("HTML").alias("access_mode"))


@query("J5_rollup_sources", """
    select s_nationkey as company_id, count(*) as source_count, count(*) filter (where s_acctbal > 4000) as runnable_source_count,
      coalesce(string_agg(distinct case when s_acctbal <= 4000 then 'r' || (s_suppkey % 3) end, ',' order by case when s_acctbal <= 4000 then 'r' || (s_suppkey % 3) end), '') as not_ready_reasons from supplier group by 1""")
def j5(t):
    out = reports.rollup_sources(supplier_sources(t))
    return out.select("company_id", "source_count", "runnable_source_count", F.array_join("not_ready_reasons", ",").alias("not_ready_reasons"))


@query("J6_current_job_counts", """
    select o_custkey as company_id, count(*) as current_jobs from orders where o_orderstatus = 'O' and year(o_orderdate) = 2000 group by 1""")
def j6(t):
    jobs = t.orders.select(F.col("o_custkey").alias("company_id"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("CLOSED").alias("status"), F.year("o_orderdate").cast("string").alias("cohort"))
    return reports.current_job_counts(jobs, "2000")


DIRECTORY = """src as (select s_nationkey as company_id, s_suppkey as seq, s_nationkey % 4 in (0, 1) as reviewed from supplier),
  best as (select company_id, 'https://s' || seq || '.example.com/campus' as url, reviewed from (select *, row_number() over (partition by company_id order by reviewed desc, seq) rn from src) where rn = 1),
  fst as (select company_id, 'https://s' || min(seq) || '.example.com/campus' as url from src group by 1),
  jobs as (select c_nationkey as company_id, count(*) as n from orders join customer on c_custkey = o_custkey where o_orderstatus = 'O' and year(o_orderdate) = 1999 and c_nationkey % 3 = 0 group by 1),
  obs as (select s_nationkey as company_id, case when max(s_acctbal) > 9000 then 'ACTIVE_CONFIRMED' when max(s_acctbal) > 6000 then 'ACTIVE_LEAD' else 'STALE' end as st from supplier group by 1),
  leads as (select c_nationkey as company_id, 'https://lead' || min(c_custkey) || '.example.com/' as url from customer where c_mktsegment = 'BUILDING' and c_custkey % 2 = 0 group by 1)"""


def directory_input(t):
    companies = t.nation.select(F.col("n_nationkey").alias("company_id"), F.col("n_nationkey").alias("seq"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("https://c"), F.col("n_nationkey"), F.lit(".example.com/jobs"))).alias("career_url"))
    jobs = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("company_id")), "o_custkey").filter("company_id % 3 = 0")
    jobs = jobs.select("company_id", F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("CLOSED").alias("status"), F.year("o_orderdate").cast("string").alias("cohort"))
    leads = t.customer.filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_nationkey").alias("company_id"), F.col("c_custkey").alias("seq"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "https").otherwise("http"), F.lit("://lead"), F.col("c_custkey"), F.lit(".example.com/")).alias("official_url"),
        F.lit("1999届秋招").alias("title"), F.lit(False).alias("official_url_verified"), F.lit("NEEDS_REVIEW").alias("verification_status"), F.lit("https://posts.example.com/1").alias("source_url"))
    return companies, supplier_sources(t), jobs, leads


def now():
    return F.lit("2001-09-01 00:00:00").cast("timestamp")


@query("J7_J8_directory_from_observations", f"""with {DIRECTORY}
    select n_nationkey as company_id, case when coalesce(reviewed, false) or n > 0 or st = 'ACTIVE_CONFIRMED' then 'ACTIVE_CONFIRMED' else 'ACTIVE_LEAD' end as directory_status,
      case when not (coalesce(reviewed, false) or coalesce(n, 0) > 0 or st = 'ACTIVE_CONFIRMED') then 'ENTRY_LEAD' when n_nationkey % 5 = 0 then 'OFFICIAL_CAREER_SITE' else 'OFFICIAL_CAMPAIGN_PAGE' end as entry_type,
      case when n_nationkey % 5 = 0 then 'https://c' || n_nationkey || '.example.com/jobs' else fst.url end as career_url, coalesce(n, 0) as current_jobs, n_regionkey as segment
    from nation join obs on obs.company_id = n_nationkey left join best on best.company_id = n_nationkey left join fst on fst.company_id = n_nationkey left join jobs on jobs.company_id = n_nationkey
    where st <> 'STALE'""")
def j7(t):
    companies, sources, jobs, _ = directory_input(t)
    peak = t.supplier.groupBy(F.col("s_nationkey").alias("company_id")).agg(F.max("s_acctbal").alias("m"))
    text = F.lit(None).cast("string")
    seen = peak.select("company_id", F.when(F.col("m") > 9000, "ACTIVE_CONFIRMED").when(F.col("m") > 6000, "ACTIVE_LEAD").otherwise("STALE").alias("directory_status"), text.alias("entry_type"),
                       text.alias("career_url"), text.alias("evidence_url"), F.array().cast("array<string>").alias("signals"), F.lit(None).cast("timestamp").alias("first_confirmed_at"), now().alias("last_checked_at"))
    focus = t.nation.select(F.col("n_nationkey").alias("company_id"), F.col("n_regionkey").alias("segment"))
    out = reports.company_directory(companies, sources, jobs, now(), "1999", observations=seen, focus=focus)
    return out.select("company_id", "directory_status", "entry_type", "career_url", "current_jobs", F.col("focus_segment").alias("segment"))


@query("J9_A12_directory_with_leads", f"""with {DIRECTORY}
    select n_nationkey as company_id, coalesce(reviewed, false) or n > 0 is true as confirmed,
      coalesce(case when n_nationkey % 5 = 0 then 'https://c' || n_nationkey || '.example.com/jobs' end, leads.url, fst.url) as career_url
    from nation left join best on best.company_id = n_nationkey left join fst on fst.company_id = n_nationkey left join jobs on jobs.company_id = n_nationkey left join leads on leads.company_id = n_nationkey
    where n_nationkey % 5 = 0 or leads.url is not null or fst.url is not null""")
def j9(t):
    companies, sources, jobs, leads = directory_input(t)
    out = reports.company_directory(companies, sources, jobs, now(), "1999", leads=leads)
    return out.select("company_id", (F.col("directory_status") == "ACTIVE_CONFIRMED").alias("confirmed"), "career_url")


@query("A12_directory_summary", f"""with {DIRECTORY},
    d as (select n_nationkey, coalesce(reviewed, false) or coalesce(n, 0) > 0 as confirmed, coalesce(n, 0) as n from nation left join best on best.company_id = n_nationkey
      left join fst on fst.company_id = n_nationkey left join jobs on jobs.company_id = n_nationkey left join leads on leads.company_id = n_nationkey where n_nationkey % 5 = 0 or leads.url is not null or fst.url is not null)
    select count(*) as active_companies, count(*) filter (where confirmed and true) - count(*) filter (where confirmed and n_nationkey not in (select company_id from best)) as official_entries,
      count(*) filter (where not confirmed or n_nationkey not in (select company_id from best)) as entry_leads,
      count(*) filter (where n > 0) as companies_with_jobs, cast(sum(n) as bigint) as eligible_jobs from d""")
def a12(t):
    companies, sources, jobs, leads = directory_input(t)
    out = reports.directory_summary(reports.company_directory(companies, sources, jobs, now(), "1999", leads=leads))
    return out.select("active_companies", "official_entries", "entry_leads", "companies_with_jobs", "eligible_jobs")


@query("J10_without_jobs", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= '2001-01-01')")
def j10(t):
    recent = t.orders.filter(F.col("o_orderdate") >= "2001-01-01").withColumnRenamed("o_custkey", "c_custkey")
    return facets.without_jobs(t.customer, recent, "c_custkey").select("c_custkey")


KEY = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-z]", "")
INDEX = "idx as (select key, arg_min(p_partkey, p_partkey) as id from (select p_partkey, unnest([replace(p_name, ' ', ''), lower(p_brand)]) as key from part where p_size > 25) group by 1)"


def part_index(t, prefer="first"):
    companies = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("company_id"), F.col("p_partkey").alias("seq"), "p_name", "p_brand")
    keys = F.array(F.replace("p_name", F.lit(" "), F.lit("")), F.lower("p_brand"))
    return resolve.key_index(companies, keys, prefer=prefer)


@query("J11_match_by_names", f"""with {INDEX},
    k as (select p_partkey as rank, unnest([replace(p_name, ' ', ''), 'brand#' || (p_partkey % 40), replace(p_name, ' ', '') || 'x']) as key from part),
    m as (select rank, min(id) as lo, max(id) as hi from k join idx using (key) group by 1),
    j as (select p_partkey as rank, lo, hi, p_partkey % 9 = 0 and p_size > 25 as canon from part left join m on rank = p_partkey)
    select rank, coalesce(case when canon then rank when lo = hi then lo end, -1) as matched_company_id, not canon and coalesce(lo <> hi, false) as conflict from j""")
def j11(t):
    rows = t.part.select(F.col("p_partkey").alias("rank"), "p_name", F.when(F.col("p_partkey") % 9 == 0, F.col("p_partkey")).alias("canonical"))
    name = F.replace("p_name", F.lit(" "), F.lit(""))
    keys = F.array(name, F.concat(F.lit("brand#"), F.col("rank") % 40), F.concat(name, F.lit("x")))
    companies = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("company_id"))
    out = _typed_match(resolve.match_by_names(rows, "rank", keys, part_index(t), companies, "canonical"))
    return out.select("rank", F.coalesce("matched_company_id", F.lit(-1).cast("bigint")).alias("matched_company_id"), "conflict")


def _typed_match(df):
    return df.withColumn("matched_company_id", F.col("matched_company_id").cast("bigint"))


@query("J11_A23_authority_candidates", f"""with {INDEX},
    k as (select p_partkey as rank, replace(p_name, ' ', '') as key from part), j as (select rank, id from k left join idx using (key)),
    c as (select rank, id, coalesce('p' || id, 'candidate-isc-' || lpad(rank::varchar, greatest(3, 0), '0')) as cid from j)
    select count(*) as authority_company_count, count(id) as matched_registry_count, count(*) - count(id) as new_candidate_count,
      (select count(*) from (select row_number() over (partition by cid order by rank) rn from c) where rn > 1) as conflict_count from c""")
def j11_candidates(t):
    rows = t.part.select(F.col("p_partkey").alias("rank"), F.replace("p_name", F.lit(" "), F.lit("")).alias("key"))
    index = part_index(t).withColumn("matched_company_id", F.concat(F.lit("p"), F.col("matched_company_id")))
    matched = resolve.match_by_names(rows, "rank", F.array("key"), index)
    return resolve.authority_summary(resolve.authority_candidates(matched))


@query("J12_first_listed_key", f"""with {INDEX},
    k as (select p_partkey, n, key from (select p_partkey, unnest([0, 1]) as n, unnest([lower('Brand#' || (p_partkey % 50)), replace(p_name, ' ', '')]) as key from part))
    select p_partkey as row_id, coalesce((select arg_min(id, n) from k join idx using (key) where k.p_partkey = part.p_partkey), -1) as matched_company_id from part""")
def j12(t):
    rows = t.part.select(F.col("p_partkey").alias("row_id"), "p_name")
    keys = [F.lower(F.concat(F.lit("Brand#"), F.col("row_id") % 50)), F.replace("p_name", F.lit(" "), F.lit(""))]
    out = resolve.match_first_key(rows, "row_id", keys, part_index(t))
    return out.select("row_id", F.coalesce("matched_company_id", F.lit(-1).cast("bigint")).alias("matched_company_id"))


@query("J13_last_company_wins", """
    with idx as (select key, max(p_partkey) as id from (select p_partkey, unnest([replace(p_name, ' ', ''), lower(p_brand)]) as key from part where p_size > 25) group by 1)
    select key, id as matched_company_id from idx""")
def j13(t):
    return part_index(t, "last").select("key", "matched_company_id")


@query("J14_match_identity", """
    with ck as (select p_partkey as cand, unnest(['STOCK_CODE', 'LEGAL_NAME_OR_ALIAS', 'OFFICIAL_DOMAIN']) as kt, unnest([(p_partkey % 700)::varchar, replace(p_name, ' ', ''), lower(p_brand)]) as key from part),
    rk as (select s_suppkey as company_id, unnest(['STOCK_CODE', 'LEGAL_NAME_OR_ALIAS', 'OFFICIAL_DOMAIN']) as kt, unnest([(s_suppkey * 7)::varchar, case when s_suppkey % 3 = 0 then 'redwidget' else 'none' || s_suppkey end, 'brand#' || s_suppkey]) as key from supplier),
    f as (select cand, min(company_id) as lo, max(company_id) as hi, min(case kt when 'STOCK_CODE' then 0 when 'LEGAL_NAME_OR_ALIAS' then 1 else 2 end) as m from ck join rk using (kt, key) group by 1)
    select p_partkey as candidate_id, coalesce(case when lo = hi then lo end, -1) as matched_company_id,
      coalesce(case when lo = hi then ['STOCK_CODE', 'LEGAL_NAME_OR_ALIAS', 'OFFICIAL_DOMAIN'][m + 1] when lo <> hi then 'CONFLICT' end, '') as match_method from part left join f on cand = p_partkey""")
def j14(t):
    cand = t.part.select(F.col("p_partkey").alias("candidate_id"), "p_name", "p_brand")
    comp = t.supplier.select(F.col("s_suppkey").alias("company_id"))
    ck = {"STOCK_CODE": F.array((F.col("candidate_id") % 700).cast("string")), "LEGAL_NAME_OR_ALIAS": F.array(name_key("p_name")), "OFFICIAL_DOMAIN": F.array(F.lower("p_brand"))}
    s = F.col("company_id")
    rk = {"STOCK_CODE": F.array((s * 7).cast("string")), "LEGAL_NAME_OR_ALIAS": F.array(F.when(s % 3 == 0, "redwidget").otherwise(F.concat(F.lit("none"), s))), "OFFICIAL_DOMAIN": F.array(F.concat(F.lit("brand#"), s))}
    out = resolve.match_identity(cand, comp, candidate_keys=ck, company_keys=rk)
    return out.select("candidate_id", F.coalesce("matched_company_id", F.lit(-1).cast("bigint")).alias("matched_company_id"), F.coalesce("match_method", F.lit("")).alias("match_method"))


def alias_sql(source):
    key = lambda x: f"regexp_replace(regexp_replace(lower(trim({x})), '\\s', '', 'g'), '[·・()（）【】\\[\\]{{}}]', '', 'g')"
    return f"""with a as ({source}), al as (select item_id, {key('alias')} as key from a),
    d as (select doc_id, {key('text')} as body from documents),
    h as (select doc_id, item_id, row_number() over (partition by doc_id order by length(key) desc, item_id) rn from d join al on contains(body, key) where length(key) >= 2)
    select documents.doc_id, coalesce(item_id, -1) as matched_company_id from documents left join (select * from h where rn = 1) h using (doc_id)"""


def alias_search(t, aliases):
    rows = aliases.withColumns({"company_id": F.col("item_id"), "seq": F.col("item_id")})
    out = resolve.longest_alias(t.documents.select("doc_id", "text"), "doc_id", "text", rows, tasks=t.tasks)
    return out.select("doc_id", F.coalesce("matched_company_id", F.lit(-1).cast("bigint")).alias("matched_company_id"))


@query("J16_longest_alias", alias_sql(r"select item_id, text as alias from benchmark union all select item_id, regexp_extract(trim(text), '^\S+\s+\S+') from benchmark"))
def j16(t):
    """Whole items, and their first two words: long aliases and short ones that many texts hold."""
    two = t.benchmark.select("item_id", F.regexp_extract(F.trim("text"), r"^\S+\s+\S+", 0).alias("alias"))
    return alias_search(t, t.benchmark.select("item_id", F.col("text").alias("alias")).union(two))


@query("J16_longest_alias_by_join", alias_sql("select item_id, substr(trim(text), 1, 8 + item_id % 5) as alias from benchmark"))
def j16_join(t):
    return alias_search(t, t.benchmark.select("item_id", F.substring(F.trim("text"), F.lit(1), (8 + F.col("item_id") % 5).cast("int")).alias("alias")))


@query("J18_campaign_jobs", """
    select c_mktsegment as campaign_id, o_orderkey as id, strftime(min(o_orderdate), '%Y-%m-%d') as first_at from orders join customer on c_custkey = o_custkey group by 1, 2""")
def j18(t):
    jobs = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("campaign_id")), "o_custkey")
    out = reports.campaign_jobs(jobs.select("campaign_id", F.col("campaign_id").alias("campaign_name"), F.col("o_orderkey").alias("id"), "o_orderdate"), ["o_orderdate"])
    return out.select("campaign_id", "id", F.date_format("first_at.o_orderdate", "yyyy-MM-dd").alias("first_at"))


@query("J19_P29_local_jobs", """
    select e.user_id, e.job_id, coalesce(p_name, 'saved ' || e.job_id) as title, p_partkey is not null as is_current, case when p_partkey is null then 'CLOSED' else 'ACTIVE' end as job_status
    from (select distinct user_id, user_id * 7 + length(event_type) as job_id from events) e left join part on p_partkey = e.job_id and p_size > 20""")
def j19(t):
    states = t.events.select("user_id", (F.col("user_id") * 7 + F.length("event_type")).alias("job_id")).distinct().withColumn("title", F.concat(F.lit("saved "), F.col("job_id")))
    jobs = t.part.filter("p_size > 20").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return facets.local_jobs(states, jobs, ["title"]).select("user_id", "job_id", "title", "is_current", "job_status")


@query("J20_central_groups", """
    with g as (select lower(replace(n_name, '_', '')) as key, 'g' || max(n_nationkey) as gid from nation group by 1),
    c as (select s_suppkey, s_nationkey, 'NATION ' || (s_suppkey % 40) as legal, case when s_suppkey % 2 = 0 then s_suppkey end as m from supplier),
    j as (select c.*, gid, m is not null and m % 3 = 0 and m % 5 <> 0 as child, m % 4 = 0 as loc from c left join g on key = lower(replace(legal, ' ', '')))
    select s_suppkey as candidate_id, case when child and loc then 'LOCAL_STATE_OWNED' when child then 'CENTRAL_SUBSIDIARY' when gid is not null then 'CENTRAL_GROUP' else 'UNCLASSIFIED_STATE_OWNED' end as ownership_class,
      coalesce(case when child then 'parent' || m else gid end, '') as parent_group_id from j""")
def j20(t):
    cand = t.supplier.select(F.col("s_suppkey").alias("candidate_id"), F.concat(F.lit("NATION "), F.col("s_suppkey") % 40).alias("legal_name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("matched_company_id"))
    groups = t.nation.select(F.concat(F.lit("g"), F.col("n_nationkey")).alias("group_id"), F.col("n_nationkey").alias("rank"), F.col("n_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases"))
    k = F.col("s_suppkey")
    comp = t.supplier.select(k.alias("company_id"), F.when(k % 3 == 0, F.concat(F.lit("parent"), k)).alias("parent_group_id"), F.when(k % 4 == 0, "LOCAL_STATE_OWNED").alias("ownership_class"),
                             F.when(k % 5 != 0, F.array(F.lit("https://e.example.com/"))).alias("ownership_evidence_urls"))
    out = resolve.central_group_labels(cand, groups, comp)
    return out.select("candidate_id", "ownership_class", F.coalesce("parent_group_id", F.lit("")).alias("parent_group_id"))


@query("J22_X25_company_segment", """
    select o_orderkey, coalesce(nullif(trim(case when c_acctbal > 5000 then c_mktsegment end), ''), case when c_acctbal > 0 then 'N' || c_nationkey end, o_orderpriority) as segment from orders left join customer on c_custkey = o_custkey""")
def j22(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), "o_orderpriority")
    comp = t.customer.select(F.col("c_custkey").alias("company_id"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("focus"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("N"), F.col("c_nationkey"))).alias("authority"))
    out = facets.with_company(rows, comp)
    return out.select(F.col("id").alias("o_orderkey"), facets.segment(F.col("focus"), F.col("authority"), F.lit(None).cast("string"), F.col("o_orderpriority")).alias("segment"))


@query("J24_official_url", """
    with s as (select s_nationkey, s_suppkey, s_nationkey % 4 = 0 as v, row_number() over (partition by s_nationkey order by s_suppkey) rn from supplier)
    select n_nationkey as company_id, coalesce(case when v then 'https://s' || s_suppkey || '.example.com/campus' when n_nationkey % 5 = 0 then 'https://c' || n_nationkey || '.example.com/jobs' when s_suppkey is not null then 'https://s' || s_suppkey || '.example.com/campus' end, '') as official_url,
      coalesce(v, false) as official_url_verified from nation left join s on s_nationkey = n_nationkey and rn = 1""")
def j24(t):
    companies, sources, _, _ = directory_input(t)
    out = resolve.official_url(companies, sources)
    return out.select("company_id", F.coalesce("official_url", F.lit("")).alias("official_url"), "official_url_verified")


@query("U3_extend_pool", """
    select c_custkey as company_id, c_name as name from customer union all
    select s_suppkey + 1400, s_name from supplier where s_suppkey % 4 <> 0 and s_suppkey + 1400 not in (select c_custkey from customer)""")
def u3(t):
    reg = t.customer.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"))
    found = t.supplier.select((F.col("s_suppkey") + 1400).alias("company_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey")).alias("matched_company_id"))
    return resolve.extend_pool(reg, found).select("company_id", "name")


@query("F25_usable_leads", """
    select c_custkey from customer where c_mktsegment = 'BUILDING' and c_custkey % 2 = 0 and (c_acctbal > 5000 or c_nationkey % 2 = 0)""")
def f25(t):
    leads = t.customer.select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("company_id"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "https").otherwise("http"), F.lit("://x.example.com")).alias("official_url"),
        F.when(F.col("c_mktsegment") == "BUILDING", "2027届校招").otherwise("社招").alias("title"), (F.col("c_acctbal") > 5000).alias("official_url_verified"),
        F.when(F.col("c_nationkey") % 2 == 0, "NEEDS_REVIEW").otherwise("REJECTED").alias("verification_status"))
    return gates.usable_leads(leads).select("c_custkey")


@query("P31_directory_candidates", f"""
    with k as (select p_partkey, p_name, replace(p_name, ' ', '') as key, row_number() over (partition by p_name order by p_partkey) rn from part)
    select 'candidate-' || substr(sha256(key), 1, 12) as candidate_id, key as normalized_name, p_partkey as first_row from k where rn = 1""")
def p31(t):
    rows = t.part.select(F.col("p_name").alias("name"), F.array().cast("array<string>").alias("stock_codes"), F.lit(None).cast("string").alias("market"), "p_partkey")
    out = registry.directory_candidates(rows, "exchange", "https://list.example.com", ["p_partkey"])
    return out.select("candidate_id", "normalized_name", F.col("p_partkey").alias("first_row"))


@query("P31_directory_from_json", """
    with k as (select p_partkey, p_name, replace(p_name, ' ', '') as key, row_number() over (partition by p_name order by p_partkey) rn from part where p_size <> 7)
    select 'candidate-' || substr(sha256(key), 1, 12) as candidate_id, key as normalized_name, p_partkey as first_row, lpad(p_partkey::varchar, 6, '0') as code, case when p_partkey % 2 = 0 then 'SSE' else '-' end as market from k where rn = 1""")
def p31_json(t):
    """Payloads with the rows three levels down, under changing field names; a part of size 7 has no name."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("companyName", "证券简称", "FULL_NAME", "简称")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    market = F.when(F.col("p_partkey") % 2 == 0, ',"exchange":"SSE"').otherwise("")
    named = F.when(F.col("p_size") == 7, "").otherwise(F.concat(F.lit(',"'), name, F.lit('":"'), "p_name", F.lit('"')))
    body = F.concat(F.lit('{"data":{"result":{"items":[{"股票代码":"'), "p_partkey", F.lit('"'), named, market, F.lit("}]}}}"))
    rows = registry.directory_rows(t.part.select("p_partkey", body.alias("body")), "body", ["p_partkey"])
    out = registry.directory_candidates(rows, "exchange", "https://list.example.com", ["p_partkey"])
    return out.select("candidate_id", "normalized_name", F.col("p_partkey").alias("first_row"), F.get("stock_codes", F.lit(0)).alias("code"), F.coalesce("listing_market", F.lit("-")).alias("market"))


@query("J17_audience_violations")
def j17(t):
    details = t.part.filter("p_size <> 7").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.lit(" marketing")).alias("title"), F.when(F.col("p_type") == "PROMO", "设计").otherwise("其他").alias("role_category"),
                                                  F.array().cast("array<string>").alias("requirements"), F.lit("").alias("description"), F.array().cast("array<string>").alias("major_tags"))
    return gates.audience_violations(t.part.select(F.col("p_partkey").alias("id")), details)
