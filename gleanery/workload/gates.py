"""Gates, predicates and their reason codes."""

from pyspark.sql import functions as F

from gleanery.functions import rules, urls
from gleanery.functions.audience import assess
from gleanery.operators import facets, gates, pages
from gleanery.scale import dealt
from gleanery.workload import query

HOST = r"regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"


@query("F1_scope_gate", """
    select d.doc_id, case when toxic = 1 then false when regexp_matches(lower(source), 'lorem|spam|the|3') then false when quality = 1 then true
      when regexp_matches(lower(text), 'lorem|spam|the|3') then false else regexp_matches(lower(text), 'de |la ') end as in_scope from documents d left join labels l using (doc_id)""")
def f1(t):
    rows = t.documents.select("doc_id", "source", "text").join(t.labels, "doc_id", "left")
    flag = F.when(F.col("toxic") == 1, F.lit(False)).when(F.col("quality") == 1, F.lit(True))
    return rows.select("doc_id", rules.in_scope(flag, F.col("source"), F.col("text"), ["lorem", "spam", "the", "3"], ["de ", "la "]).alias("in_scope"))


@query("F2_feed_scope_flag", """
    select p_partkey, case when lower(p_name) like '%experienced%' then 0 when (p_size > 20 and contains(lower(p_name), 'red')) or (p_size <= 20 and regexp_matches(lower(p_name), 'graduate|campus|trainee')) then 1
      when p_type = 'PROMO' then 1 else -1 end as flag from part""")
def f2(t):
    marks = F.when(F.col("p_size") > 20, F.array(F.lit("RED"))).otherwise(F.array().cast("array<string>"))
    flag = rules.feed_scope_flag(F.col("p_name"), marks, F.col("p_type") == "PROMO", F.lit("/campus/"))
    return t.part.select("p_partkey", F.coalesce(flag.cast("int"), F.lit(-1)).alias("flag"))


@query("F3_allow_list", """
    select p_partkey, (p_size <= 10) or p_partkey % 100 = 7 or contains(p_name, 'blue') as allowed from part""")
def f3(t):
    small = F.col("p_size") <= 10
    ids = F.when(~small, F.array(F.lit(" 7 "))).otherwise(F.array().cast("array<string>"))
    marks = F.when(~small, F.array(F.lit("BLUE"))).otherwise(F.array().cast("array<string>"))
    return t.part.select("p_partkey", rules.allow_listed(F.array((F.col("p_partkey") % 100).cast("string")), F.col("p_name"), ids, marks).alias("allowed"))


@query("F4_feed_row_allowed", """
    select doc_id, (doc_id % 3 = 0 or contains(lower(text), 'de')) and not regexp_matches(lower(text), '社招|社会招聘|experienced|社会人才') as allowed from documents""")
def f4(t):
    row = rules.feed_row_allowed(F.array((F.col("doc_id") % 3).cast("string")), F.col("text"), F.col("text"), F.array(F.lit("0")), F.array(F.lit("DE")))
    return t.documents.select("doc_id", row.alias("allowed"))


@query("F6_blocked_category", """
    select p_partkey, case when p_type in ('PROMO', 'ECONOMY') then 'BLOCKED_A' when p_type = 'LARGE' then 'BLOCKED_B' else '' end as reason from part""")
def f6(t):
    table = [("PROMO", "BLOCKED_A"), ("ECONOMY", "BLOCKED_A"), ("LARGE", "BLOCKED_B")]
    return t.part.select("p_partkey", F.coalesce(rules.blocked_category(F.col("p_type"), table), F.lit("")).alias("reason"))


@query("F7_blocked_title", """
    select p_partkey, case when regexp_matches(p_name, '(red|hot)\\s+r') then 'R1' when regexp_matches(p_name, 'gear|rod') then 'R2' when regexp_matches(replace(p_name, ' ', ''), 'bluew') then 'R3' else '' end as reason,
      case when regexp_matches(p_name, '(red|hot)\\s+r') then regexp_extract(p_name, '(red|hot)\\s+r') when regexp_matches(p_name, 'gear|rod') then regexp_extract(p_name, 'gear|rod')
      when regexp_matches(replace(p_name, ' ', ''), 'bluew') then 'bluew' else '' end as term from part""")
def f7(t):
    hit = rules.blocked_title(F.col("p_name"), [(r"(?:red|hot)\s+r", "R1"), ("GEAR|ROD", "R2"), ("blueW", "R3")])
    return t.part.select("p_partkey", F.coalesce(hit["reason"], F.lit("")).alias("reason"), F.coalesce(hit["term"], F.lit("")).alias("term"))


@query("F8_demanded_portfolio", r"""
    with s as (select doc_id, unnest(list_filter(string_split_regex(text, '[。；;\n.!！?？]'), lambda s: trim(s, E' \t\r') <> '')) as s, unnest(generate_series(1, len(list_filter(string_split_regex(text, '[。；;\n.!！?？]'), lambda s: trim(s, E' \t\r') <> '')))) as i from documents),
    h as (select doc_id, arg_min(regexp_extract(s, '(?i)(?:the|de).{0,16}(?:and|la)'), i) as term from s where regexp_matches(s, '(?i)(?:the|de).{0,16}(?:and|la)') and not regexp_matches(s, '(?i)of\s+the') group by 1)
    select doc_id, coalesce(term, '') as term from documents left join h using (doc_id)""")
def f8(t):
    hit = rules.demanded_portfolio(F.array("text"), "(?:the|de).{0,16}(?:and|la)", r"of\s+the")
    return t.documents.select("doc_id", F.coalesce(hit, F.lit("")).alias("term"))


@query("F11_audience_gate")
def f11(t):
    empty = F.array().cast("array<string>")
    rows = dealt(t.documents, t.tasks).select("doc_id", F.col("source").alias("title"), F.lit("其他").alias("role_category"), empty.alias("major_tags"), F.array("text").alias("requirements"), F.lit("").alias("description"))
    return assess(rows).select("doc_id", "audience.decision", F.array_join("audience.reason_codes", ",").alias("reasons"), F.array_join("audience.matched_terms", ",").alias("terms"))


@query("F11_audience_titles", """
    select p_partkey, case when p_type = 'PROMO' then 'OUT_OF_SCOPE' when p_type = 'LARGE' then 'OUT_OF_SCOPE' when p_type in ('SMALL', 'MEDIUM') then 'TARGET_GENERALIST' else 'NEEDS_REVIEW' end as decision,
      case when p_type = 'PROMO' then 'BLOCKED_SPECIALIST_PORTFOLIO' when p_type = 'LARGE' then 'BLOCKED_TECHNICAL_ROLE' when p_type = 'SMALL' then 'ALLOWED_GENERALIST_TITLE'
      when p_type = 'MEDIUM' then 'ALLOWED_TARGET_MAJOR' else 'REVIEW_INSUFFICIENT_REQUIREMENTS' end as reasons from part""")
def f11_titles(t):
    empty, kind = F.array().cast("array<string>"), F.col("p_type")
    rows = t.part.select("p_partkey", F.concat("p_name", F.when(kind == "LARGE", " Software Developer").when(kind == "SMALL", " 运营专员").otherwise("")).alias("title"),
                         F.when(kind == "PROMO", "设计").otherwise("其他").alias("role_category"), empty.alias("major_tags"),
                         F.when(kind == "MEDIUM", F.array(F.lit("计算机或市场营销相关专业"))).otherwise(empty).alias("requirements"), F.lit("").alias("description"))
    return assess(rows).select("p_partkey", "audience.decision", F.array_join("audience.reason_codes", ",").alias("reasons"))


@query("F12_page_guard", "select p_partkey, p_type <> 'LARGE' and p_type <> 'PROMO' as shown from part")
def f12(t):
    title = F.concat("p_name", F.when(F.col("p_type") == "LARGE", " engineer").otherwise(" sales"))
    return t.part.select("p_partkey", rules.passes_page_guard(F.when(F.col("p_type") == "PROMO", "技术").otherwise("运营"), title).alias("shown"))


def gate_sources(t):
    k = F.col("s_suppkey")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    evidence = F.struct(
        F.when(k % 4 == 0, "PROVISIONAL").otherwise("AUTO_VERIFIED").alias("conclusion"), *[F.lit(True).alias(f) for f in ("official_reverse_link", "public_access_no_auth", "robots_terms_allowed", "current_cohort_evidence")],
        (k % 11 != 1).alias("campus_evidence"), F.lit(True).alias("company_identity_exact"), F.lit(True).alias("apply_domain_verified"), (k % 6).cast("int").alias("sampled_jobs"), F.lit(1.0).alias("required_field_completeness"),
        (k % 13 / 100.0).alias("invalid_row_ratio"), F.lit(0.0).alias("duplicate_ratio"), (k % 17 == 3).alias("anomalous_drop"), F.lit(2).alias("consecutive_healthy_runs"))
    return t.supplier.select(
        k.alias("source_id"), pick("greenhouse", "rss", "moka", "lever", "html").alias("adapter"), pick("VERIFIED", "AUTO_VERIFIED", "TARGET").alias("status"), (k % 19 != 0).alias("enabled"),
        F.lit("UNKNOWN").alias("access_mode"), F.when(k % 7 != 0, F.lit("2026-01-01")).cast("date").alias("verified_at"), F.lit("2026-01-01").cast("date").alias("robots_reviewed_at"), F.lit("2026-01-01").cast("date").alias("terms_reviewed_at"),
        F.concat(F.when(k % 23 == 0, "http").otherwise("https"), F.lit("://jobs.example.com/")).alias("source_url"), F.when(k % 5 == 3, F.lit(None)).otherwise(F.lit("https://api.example.com/jobs")).alias("endpoint"),
        F.when(k % 3 == 0, "other.example.net").otherwise("example.com").alias("apply_domain"), F.array(F.when(k % 6 == 0, "example.com").otherwise("none.example.org")).alias("apply_domains"), F.lit(None).cast("string").alias("ats_host"),
        F.lit(False).alias("dom_ready"), evidence.alias("evidence"))


@query("F13_source_gate", """
    with s as (select s_suppkey as k, ['greenhouse', 'rss', 'moka', 'lever', 'html'][s_suppkey % 5 + 1] as adapter, ['VERIFIED', 'AUTO_VERIFIED', 'TARGET'][s_suppkey % 3 + 1] as status from supplier),
    r as (select k, case when k % 19 = 0 then 'disabled' when status = 'TARGET' then 'status_target' when status = 'VERIFIED' and k % 7 = 0 then 'source_review_dates_incomplete'
      when adapter in ('moka', 'html') then 'adapter_requires_reviewed_json_endpoint' when k % 23 = 0 then 'source_url_requires_https' when k % 5 = 3 then 'endpoint_not_configured'
      when k % 3 = 0 and k % 6 <> 0 then 'endpoint_domain_not_allowed'
      when status = 'AUTO_VERIFIED' then case when k % 4 = 0 then 'auto_evidence_provisional' when k % 11 = 1 then 'campus_evidence_missing' when k % 6 < 3 then 'auto_sample_count_insufficient'
        when k % 13 / 100.0 > 0.05 then 'auto_invalid_row_ratio_too_high' when k % 17 = 3 then 'auto_anomalous_job_count_drop' else 'ready' end else 'ready' end as gate_reason from s)
    select k as source_id, gate_reason, gate_reason = 'ready' as runnable from r""")
def f13(t):
    return gates.with_source_gate(gate_sources(t)).select("source_id", "gate_reason", "runnable")


@query("F14_evidence_gate", """
    with s as (select s_suppkey as k, ['greenhouse', 'rss', 'moka', 'lever', 'html'][s_suppkey % 5 + 1] as adapter from supplier),
    r as (select k, list_sort(list_filter([case when adapter in ('moka', 'html') then 'adapter_not_allowlisted' end, case when adapter = 'moka' then 'manual_or_blocked_connector' end,
      case when k % 23 = 0 then 'source_url_requires_https' end, case when k % 11 = 1 then 'campus_evidence_missing' end, case when k % 6 < 3 then 'sample_count_insufficient' end,
      case when k % 13 / 100.0 > 0.05 then 'invalid_row_ratio_too_high' end, case when k % 17 = 3 then 'anomalous_job_count_drop' end], lambda x: x is not null)) as reasons from s)
    select k as source_id, array_to_string(reasons, ',') as reasons, case when len(reasons) = 0 then 'AUTO_VERIFIED' when list_contains(reasons, 'manual_or_blocked_connector') or list_contains(reasons, 'source_url_requires_https') then 'BLOCKED' else 'PROVISIONAL' end as conclusion from r""")
def f14(t):
    rows = gate_sources(t).withColumn("reasons", gates.evidence_reasons())
    return rows.select("source_id", F.array_join("reasons", ",").alias("reasons"), gates.evidence_conclusion("reasons").alias("conclusion"))


@query("F15_safe_urls", r"""
    with u as (select page_id, case page_id % 4 when 0 then replace(url, '://', '://me:secret@') when 1 then 'javascript:' || url else url end as link, url from pages)
    select page_id, coalesce(case when page_id % 4 >= 2 then url end, '') as safe, coalesce(case when page_id % 4 >= 2 and url like 'https://%' then url end, '') as https,
      coalesce(case when page_id % 4 >= 2 and url like 'https://%' then regexp_replace(url, '#.*$', '') end, '') as page_link from u""")
def f15(t):
    k = F.col("page_id") % 4
    link = F.when(k == 0, F.replace("url", F.lit("://"), F.lit("://me:secret@"))).when(k == 1, F.concat(F.lit("javascript:"), F.col("url"))).otherwise(F.col("url"))
    blank = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    return t.pages.select("page_id", blank(urls.safe_url(link), "safe"), blank(urls.https_url(link), "https"), blank(urls.page_url(link), "page_link"))


@query("F16_url_gate", f"""
    with p as (select page_id, url, {HOST} as host from pages)
    select page_id, coalesce(case when url not like 'https://%' then 'unverified_source_url:' || url when not (host like '%.example.net' or host like '%.example.com') then 'unverified_source_domain:' || host
      when page_id % 3 = 0 then 'unverified_apply_domain:apply.example.org' when page_id % 3 = 1 then 'unverified_apply_domain:apply.example.net' end, '') as reason from p""")
def f16(t):
    link = F.when(F.col("page_id") % 3 == 0, "https://apply.example.org/1").when(F.col("page_id") % 3 == 1, "http://apply.example.net/1").otherwise("https://apply.example.net/1")
    reason = gates.url_gate(F.col("url"), link, F.lit("https://example.com/jobs"), F.array(F.lit("example.net")))
    return t.pages.select("page_id", F.coalesce(reason, F.lit("")).alias("reason"))


@query("F21_exact_or_mixed", "select p_partkey, case when p_name = 'red ring' then 'exact' when contains(replace(p_name, ' ', ''), 'redring') then 'exact' when contains(p_name, 'ring') then 'other' else 'other' end as kind from part")
def f21(t):
    return t.part.select("p_partkey", gates.exact_or_mixed(F.col("p_name"), "redring").alias("kind"))


@query("F23_title_filter", """
    select p_partkey, p_type not in ('PROMO', 'LARGE', 'SMALL', 'ECONOMY') as plausible from part""")
def f23(t):
    kind = F.col("p_type")
    title = F.when(kind == "PROMO", "查看详情").when(kind == "LARGE", "2024-01-05").when(kind == "SMALL", "版权所有 X").when(kind == "ECONOMY", "首页").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", pages.is_job_title(title).alias("plausible"))


@query("F26_catalog_check", """
    select count(*) as active_jobs, count(*) filter (where p_size > 5) as complete_jobs, count(*) filter (where p_type = 'PROMO') as non_https_links, round(count(*) filter (where p_size > 5) / count(*), 6) as completeness from part where p_brand <> 'Brand#1'""")
def f26(t):
    jobs = t.part.select(F.col("p_name").alias("title"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("city"), F.concat(F.when(F.col("p_type") == "PROMO", "http").otherwise("https"), F.lit("://x.example.com/")).alias("apply_url"),
                         F.when(F.col("p_brand") == "Brand#1", "CLOSED").otherwise("ACTIVE").alias("status"))
    out = gates.catalog_check(jobs, ["title", "city"], ["apply_url"])
    return out.withColumn("completeness", F.round("completeness", 6))


@query("F27_directory_violations", """
    with d as (select c_custkey % 1400 as company_id, c_custkey, c_acctbal from customer), n as (select company_id, count(*) as n from d group by 1)
    select d.company_id::varchar as company_id, case when n > 1 then 'invalid_company_directory_record' when c_custkey % 7 = 0 then 'inactive_company_directory' when c_custkey % 7 = 1 then 'non_https_company_directory'
      when c_custkey % 7 = 2 then 'lead_entry_type_mismatch' else 'confirmed_entry_type_mismatch' end as violation from d join n using (company_id) where n > 1 or c_custkey % 7 in (0, 1, 2, 3)""")
def f27(t):
    k = F.col("c_custkey")
    rows = t.customer.select(
        (k % 1400).cast("string").alias("company_id"), F.when(k % 7 == 0, "INACTIVE").when(k % 7 == 2, "ACTIVE_LEAD").otherwise("ACTIVE_CONFIRMED").alias("directory_status"),
        F.when(k % 7 == 3, "ENTRY_LEAD").otherwise("OFFICIAL_ATS").alias("entry_type"), F.concat(F.when(k % 7 == 1, "http").otherwise("https"), F.lit("://x.example.com/")).alias("career_url"), F.lit("https://x.example.com/").alias("evidence_url"))
    return gates.directory_violations(rows)


@query("F28_manifest_violations", """
    with m as (select count(*) as n, count(*) filter (where s_acctbal > 5000) as v, count(*) filter (where s_acctbal between 0 and 5000) as a, count(*) filter (where s_nationkey > 0) as p,
      count(*) filter (where s_acctbal < 0) > 0 as demo, count(*) filter (where s_acctbal < 2500) as still_open, count(distinct s_nationkey) as ids from supplier)
    select violation from (select unnest([case when demo then 'demo_catalog' end, case when p < 10 then 'verified_sources' end, case when p <> v + a then 'invalid_publishable_source_counts' end, case when n < p then 'invalid_source_counts' end,
      case when a > 0 and n < a then 'auto_verification_reports_missing' end, case when a > 0 and still_open > 0 then 'auto_verification_incomplete' end, case when a > 0 and ids <> n then 'auto_verification_source_ids' end]) as violation from m) where violation is not null""")
def f28(t):
    balance = F.col("s_acctbal")
    m = t.supplier.agg(F.count("*").alias("source_count"), (F.count_if(balance < 0) > 0).alias("is_demo"), F.count_if(balance > 5000).alias("verified_source_count"),
                       F.count_if(balance.between(0, 5000)).alias("auto_verified_source_count"), F.count_if(F.col("s_nationkey") > 0).alias("publishable_source_count"))
    reports = t.supplier.select(F.col("s_nationkey").alias("source_id"), F.when(balance < 2500, "PROVISIONAL").otherwise("AUTO_VERIFIED").alias("conclusion"))
    return gates.manifest_violations(m, reports, 10)


@query("F30_access_class", """
    with s as (select event_id, [200, 304, 401, 403, 404, 405, 429, 500, 503, 418, 0][event_id % 11 + 1] as st from events)
    select event_id, case when st in (401, 403, 405, 429) then 'access_blocked' when st = 404 then 'not_found' when st >= 500 then 'transient_server_error' when st >= 400 then 'unexpected_status' when st >= 200 then 'ok' else 'unreachable' end as class,
      st >= 500 as retryable from s""")
def f30(t):
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 304, 401, 403, 404, 405, 429, 500, 503, 418, 0)]), (F.col("event_id") % 11 + 1).cast("int"))
    return t.events.select("event_id", gates.access_class(status).alias("class"), gates.is_retryable(status).alias("retryable"))


@query("F20_entry_status", """
    with n as (select s_nationkey, count(*) as n from supplier where s_acctbal > 8000 group by 1)
    select n_nationkey, case when coalesce(n, 0) > 0 then 'SYNCED' when n_regionkey = 2 then 'ENTRY_LEAD' else 'OFFICIAL' end as status, coalesce(n, 0) > 0 or n_regionkey <> 2 as official,
      coalesce(n, 0) = 0 as entry_only from nation left join n on s_nationkey = n_nationkey""")
def f20(t):
    counts = t.supplier.filter("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    rows = t.nation.join(counts, "n_nationkey", "left")
    jobs, kind = F.coalesce("n", F.lit(0)), F.when(F.col("n_regionkey") == 2, "ENTRY_LEAD").otherwise("OFFICIAL_ATS")
    return rows.select("n_nationkey", facets.entry_status(jobs, kind).alias("status"), facets.matches_entry_status(jobs, kind, "OFFICIAL").alias("official"), facets.matches_entry_status(jobs, kind, "ENTRY_ONLY").alias("entry_only"))
