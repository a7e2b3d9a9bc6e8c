"""Source quality, drops, health, counts and audits."""

from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.operators import facets, gates, quality, snapshots
from gleanery.plans.slices import allowed_link_counts, run_quality
from gleanery.workload import query

def now():
    return F.lit("2001-09-01 00:00:00").cast("timestamp")
RUNS = """runs as (select event_type, cast(ts as date) as run, count(*) as raw_rows, count(distinct user_id) as unique_rows from events group by 1, 2),
  latest as (select event_type, cast(ts as date) as run, user_id, value, row_number() over (partition by event_type, cast(ts as date), user_id order by ts desc, event_id) rn from events),
  ok as (select event_type, run, count(*) filter (where value > 1) as valid_rows from latest where rn = 1 group by 1, 2),
  b as (select r.*, valid_rows, array_agg(unique_rows) over w as recent from runs r join ok using (event_type, run)
        window w as (partition by event_type order by run rows between 3 preceding and 1 preceding)),
  m as (select *, cast(floor(list_median(recent)) as bigint) as baseline from b)"""


def flagship(share):
    return f"""with {RUNS.replace('list_median(recent)', "list_aggregate(recent, 'median')")}
      select event_type, strftime(run, '%Y-%m-%d') as run, raw_rows, unique_rows, raw_rows - unique_rows as duplicate_rows,
        round(valid_rows / unique_rows, 6) as completeness, coalesce(baseline, -1) as baseline,
        coalesce(baseline > 0 and unique_rows < baseline * {share}, false) as quarantined from m"""


def run_report(t, share):
    rows = t.events.withColumn("run", F.to_date("ts"))
    out = run_quality(rows, "event_type", "run", "user_id", "ts", "event_id", F.col("value") > 1, share)
    return out.withColumn("run", F.date_format("run", "yyyy-MM-dd")).withColumn("baseline", F.coalesce("baseline", F.lit(-1).cast("bigint")))


@query("A1_A2_run_quality", flagship(0.5))
def a1(t):
    return run_report(t, 0.5)


@query("A2_drop_at_ninety_percent", flagship(0.9))
def a2(t):
    return run_report(t, 0.9)


@query("W7_recent_counts", """
    with r as (select o_custkey % 7 as source, year(o_orderdate) as run, count(*) as n from orders group by 1, 2),
    w as (select source, run, n, array_agg(n) over (partition by source order by run rows between 3 preceding and 1 preceding) as h from r)
    select source, run, n, coalesce(array_to_string(h, ','), '') as recent, coalesce(cast(floor(list_aggregate(h, 'median')) as bigint), -1) as baseline from w""")
def w7(t):
    runs = t.orders.groupBy((F.col("o_custkey") % 7).alias("source"), F.year("o_orderdate").alias("run")).agg(F.count("*").alias("n"))
    out = snapshots.recent_counts(runs, ["source"], "run", "n")
    return out.select("source", "run", "n", F.array_join("recent", ",").alias("recent"), F.coalesce(quality.whole_median(F.col("recent")), F.lit(-1)).cast("bigint").alias("baseline"))


SOURCE_LOG = """log as (select n_nationkey as source_id, n_nationkey % 9 <> 4 as fetch_ok, 40 + 17 * n_nationkey as previous_count,
    [20 + 31 * n_nationkey, 900 - 7 * n_nationkey, 5 * n_nationkey] as h from nation)"""


def nation_log(t):
    n = F.col("n_nationkey").cast("bigint")
    return t.nation.select(
        n.alias("source_id"), (n % 9 != 4).alias("fetch_ok"), F.lit(0).cast("bigint").alias("raw_count"), (40 + 17 * n).alias("previous_count"),
        F.array(20 + 31 * n, 900 - 7 * n, 5 * n).alias("count_history"), F.lit("2001-08-20 12:00:00").cast("timestamp").alias("fetched_at"))


@query("A1_source_quality", f"""
    with {SOURCE_LOG}, c as (select c_nationkey as source_id, count(*) as items, count(distinct o_custkey) as uniq,
      count(*) filter (where o_totalprice >= 5000) as good, count(*) filter (where o_orderpriority = '4-NOT SPECIFIED') as unk
      from orders join customer on c_custkey = o_custkey group by 1),
    j as (select log.source_id, fetch_ok, previous_count, coalesce(items, 0) as items, coalesce(uniq, 0) as uniq, coalesce(good, 0) as good, coalesce(unk, 0) as unk,
      case when list_contains(h, previous_count) then h else list_append(h, previous_count) end as hist from log left join c using (source_id)),
    k as (select *, case when fetch_ok then cast(floor(list_aggregate(hist, 'median')) as bigint) end as base from j)
    select source_id, items as raw_count, uniq as unique_count, items - uniq as duplicate_count, round(case when items > 0 then (items - uniq) / items else 0 end, 6) as duplicate_ratio,
      round(case when uniq > 0 then good / uniq else 0 end, 6) as field_completeness, round(case when uniq > 0 then unk / uniq else 0 end, 6) as unknown_ratio,
      case when fetch_ok then good else 0 end as accepted, case when fetch_ok then items - good else 0 end as rejected, coalesce(base, -1) as baseline_count,
      fetch_ok and coalesce(base > 0 and items < base * 0.5, false) as quarantined,
      case when not fetch_ok then 'fetch_failed_preserve_previous_catalog' when base > 0 and items < base * 0.5 then 'count_drop_over_50_percent:' || base || '->' || items else '' end as reason,
      cast(case when fetch_ok then 11.5 else -1 end as double) as freshness_days from k""")
def a1_report(t):
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("source_id")), "o_custkey")
    problem = F.when(F.col("o_totalprice") < 5000, "missing_required_field")
    counts = quality.source_counts(rows, ["source_id"], "o_custkey", problem, F.col("o_orderpriority") == "4-NOT SPECIFIED")
    out = quality.source_quality(counts, nation_log(t), "source_id", now())
    r6 = lambda c: F.round(c, 6).alias(c)
    return out.select("source_id", "raw_count", "unique_count", "duplicate_count", r6("duplicate_ratio"), r6("field_completeness"), r6("unknown_ratio"), "accepted", "rejected",
                      F.coalesce("baseline_count", F.lit(-1).cast("bigint")).alias("baseline_count"), "quarantined", F.coalesce("reason", F.lit("")).alias("reason"),
                      F.coalesce(F.round("freshness_days", 4), F.lit(-1.0)).alias("freshness_days"))


@query("A1_quality_rejects", """
    select o_orderpriority as source_id, o_orderkey, case when o_totalprice < 5000 then 'missing_required_field' else 'invalid_apply_url' end as reason
    from orders where o_totalprice < 5000 or o_orderstatus = 'F'""")
def a1_rejects(t):
    problem = F.when(F.col("o_totalprice") < 5000, "missing_required_field").when(F.col("o_orderstatus") == "F", "invalid_apply_url")
    return quality.quality_rejects(t.orders.withColumnRenamed("o_orderpriority", "source_id"), "source_id", "o_orderkey", problem)


@query("A3_health_rows", """
    with s as (select n_nationkey as source_id, 11 * n_nationkey as c, [30 + n_nationkey, 60, 90] as h, ['healthy', 'not_modified', 'blocked', 'stale', 'quarantined'][n_nationkey % 5 + 1] as health from nation),
    b as (select *, cast(floor(list_aggregate(h, 'median')) as bigint) as base from s)
    select source_id, health, c as fetched_job_count, base as baseline_count, c < base * 0.5 and health not in ('blocked', 'error', 'not_ready') as anomalous_drop, 11.5::double as freshness_days from b""")
def a3(t):
    rows = quality.health_rows(_health_input(t), now())
    return rows.select("source_id", "health", "fetched_job_count", "baseline_count", "anomalous_drop", "freshness_days")


def _health_input(t):
    n = F.col("n_nationkey").cast("bigint")
    states = F.array(*[F.lit(s) for s in ("healthy", "not_modified", "blocked", "stale", "quarantined")])
    return t.nation.select(
        n.alias("source_id"), (11 * n).alias("fetched_job_count"), F.lit(None).cast("bigint").alias("job_count"), F.array(30 + n, F.lit(60).cast("bigint"), F.lit(90).cast("bigint")).alias("count_history"),
        F.element_at(states, (n % 5 + 1).cast("int")).alias("health"), F.lit(None).cast("double").alias("freshness_days"),
        F.lit("2001-08-20 12:00:00").cast("timestamp").alias("fetched_at"), (n % 5 == 1).alias("not_modified"))


@query("A3_health_summary", """
    with s as (select n_nationkey % 5 as k, 11 * n_nationkey < 60 * 0.5 as low from nation)
    select count(*) as source_count, count(*) filter (where k in (0, 1)) as healthy, count(*) filter (where k = 1) as not_modified,
      count(*) filter (where low and k <> 2) as anomalous_drop, count(*) filter (where k in (2, 3)) as stale, count(*) filter (where k = 4) as quarantined from s""")
def a3_summary(t):
    return quality.health_summary(quality.health_rows(_health_input(t), now()))


@query("A4_decision_counts", """
    select coalesce(o_orderpriority, '') as source, coalesce(o_orderstatus, '') as decision, count(*) as rows,
      cast(grouping(o_orderpriority, o_orderstatus) as bigint) as level from orders
    group by grouping sets ((o_orderpriority, o_orderstatus), (o_orderstatus), ())""")
def a4(t):
    out = quality.decision_counts(t.orders, "o_orderpriority", "o_orderstatus")
    return out.select(F.coalesce("o_orderpriority", F.lit("")).alias("source"), F.coalesce("o_orderstatus", F.lit("")).alias("decision"), "rows", F.col("level").cast("bigint").alias("level"))


@query("A4_reason_counts", """
    with x as (select lang, unnest(list_filter([case when n_chars > 2000 then 'LONG' end, case when text like '%!%' then 'LOUD' end, case when text like '%@%' then 'MAIL' end], lambda v: v is not null)) as reason from documents)
    select coalesce(lang, '') as source, reason, count(*) as rows from x group by grouping sets ((lang, reason), (reason))""")
def a4_reasons(t):
    from gleanery.functions.rules import reason_list

    rows = t.documents.withColumn("reasons", reason_list((F.col("n_chars") > 2000, "LONG"), (F.col("text").contains("!"), "LOUD"), (F.col("text").contains("@"), "MAIL")))
    return quality.reason_counts(rows, "lang", "reasons").select(F.coalesce("lang", F.lit("")).alias("source"), "reason", "rows")


@query("A11_fixed_class_counts", """
    select k as event_type, i - 1 as class_no, (select count(*) from events where event_type = k) as rows
    from (select unnest(['view', 'click', 'refund', 'error']) as k, unnest([1, 2, 3, 4]) as i)""")
def a11(t):
    return facets.fixed_class_counts(t.events, "event_type", ["view", "click", "refund", "error"])


@query("A16_evidence_counts", """
    select count(*) as source_count, count(*) filter (where s_nationkey % 4 = 0) as verified, count(*) filter (where s_nationkey % 4 = 1) as auto_verified,
      count(*) filter (where s_suppkey % 3 = 0) as provisional, count(*) filter (where s_nationkey % 4 = 2) as quarantined, count(*) filter (where s_nationkey % 4 = 3) as blocked from supplier""")
def a16(t):
    names = F.array(*[F.lit(x) for x in ("VERIFIED", "AUTO_VERIFIED", "QUARANTINED", "BLOCKED")])
    rows = t.supplier.select(F.element_at(names, F.col("s_nationkey") % 4 + 1).alias("status"), F.when(F.col("s_suppkey") % 3 == 0, "PROVISIONAL").alias("conclusion"))
    return quality.evidence_counts(rows)


@query("A17_audit_counts", """
    select o_orderpriority as source, count(*) as job_count, count(*) filter (where o_orderstatus = 'O') as unknown_cohort_count,
      count(*) filter (where o_orderstatus = 'O') as unknown_batch_count, least(3, count(*)) as sample_count, count(*) >= 3 as meets_three_sample_target from orders group by 1""")
def a17(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("source"), "o_orderkey", "o_orderstatus")
    counts, _ = quality.audit_sources(rows, "source", "o_orderkey", [F.col("o_orderkey").asc()], "o_orderstatus", "o_orderstatus", "O")
    return counts


@query("A17_audit_samples", """
    with r as (select o_orderpriority as source, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as i, count(*) over (partition by o_orderpriority) as n from orders)
    select source, o_orderkey from r where n <= 3 or i in (0, n // 2, n - 1)""")
def a17_samples(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("source"), "o_orderkey", "o_orderstatus")
    _, samples = quality.audit_sources(rows, "source", "o_orderkey", [F.col("o_orderkey").asc()], "o_orderstatus", "o_orderstatus", "O")
    return samples.select("source", "o_orderkey")


@query("A18_filled_share", """
    select source, round((count(nullif(trim(text), '')) + count(nullif(lang, 'fr')) + count(nullif(n_chars, 0))) / (3 * count(*)), 6) as filled from documents group by 1""")
def a18(t):
    cols = [F.col("text"), F.nullif("lang", F.lit("fr")), F.nullif("n_chars", F.lit(0).cast("bigint"))]
    return t.documents.groupBy("source").agg(F.round(quality.filled_share(cols), 6).alias("filled"))


@query("Z1_clamp_ratio", """
    select l_orderkey, l_linenumber, l_partkey, greatest(0.0, least(1.0, (l_quantity - 10) / 20)) as clamped from lineitem""")
def z1(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", quality.clamp_ratio((F.col("l_quantity") - 10) / 20).alias("clamped"))


@query("J15_allowed_hosts", r"""
    with h as (select regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) as host, count(*) as pages from pages group by 1)
    select host, pages, host = 'spam-farm.example.org' or host like '%.spam-farm.example.org' or host = 'example.net' or host like '%.example.net' as allowed from h""")
def j15(t):
    return allowed_link_counts(t.pages, ["example.net", "*.spam-farm.example.org"])


@query("J21_domain_audit", r"""
    with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) as host, page_id % 5 as source_id from pages)
    select page_id, source_id, case source_id when 0 then host like '%.example.com' when 1 then host like '%.example.net' when 2 then host like '%.example.org' or host like '%.example.com'
      when 3 then false else host like '%.example.net' end as domain_valid from p""")
def j21(t):
    rows = t.pages.select("page_id", (F.col("page_id") % 5).cast("int").alias("source_id"), urls.url_host("url").alias("host"))
    k = F.col("r_regionkey")
    domains = F.when(k == 0, F.array(F.lit("example.com"))).when(k == 2, F.array(F.lit("example.org"), F.lit("example.com"))).when(k == 3, F.array(F.lit("ample.com"))).otherwise(F.array(F.lit("example.net")))
    out = quality.domain_audit(rows, t.region.select(k.alias("source_id"), domains.alias("domains")), "source_id", F.col("host"))
    return out.select("page_id", "source_id", "domain_valid")


@query("S4_rank_list_check", """
    select count(*) as row_count, count(distinct n_nationkey + 1) as ranks, min(n_nationkey + 1) as low, max(n_nationkey + 1) as high, count(distinct lower(n_name)) as names, true as valid from nation""")
def s4(t):
    rows = t.nation.withColumn("rank", F.col("n_nationkey") + 1)
    return gates.dense_rank_check(rows, "rank", 25, F.lower("n_name"), ["n_name"]).select("row_count", "ranks", "low", "high", "names", "valid")


@query("S3_key_violations", """
    select o_custkey as key, 'duplicate_key' as violation from orders where o_custkey % 50 <> 0 group by 1 having count(*) > 1
    union all select case when o_custkey % 50 = 0 then null else o_custkey end, 'blank_key' from orders where o_custkey % 50 = 0
    union all select case when o_custkey % 50 = 0 then null else o_custkey end, 'low_total' from orders where not (o_totalprice >= 2000)""")
def s3(t):
    from gleanery.sources.registry import key_violations

    rows = t.orders.select(F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("key"), "o_totalprice")
    return key_violations(rows, "key", {"low_total": F.col("o_totalprice") >= 2000})


@query("W8_failure_streak", """
    with r as (select user_id, event_id, event_type, row_number() over w as n, max(case when event_type <> 'error' then 1 else 0 end) over w as seen from events
      window w as (partition by user_id order by ts, event_id)),
    g as (select user_id, event_id, n, coalesce(max(case when event_type <> 'error' then n end) over (partition by user_id order by n), 0) as last_ok from r)
    select user_id, event_id, n - last_ok as consecutive_failures from g""")
def w8(t):
    rows = t.events.select("user_id", "event_id", "event_type", "ts")
    out = snapshots.failure_streak(rows, ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()], F.col("event_type") != "error")
    return out.select("user_id", "event_id", "consecutive_failures")
