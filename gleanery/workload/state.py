"""Snapshots, lifecycle, validators, histories and state merges."""

import uuid

from pyspark.sql import functions as F

from gleanery.operators import snapshots
from gleanery.scale import dealt_by_rows, ensure_checkpoint_dir, keep_first, top_per_group
from gleanery.sources import feeds, sinks
from gleanery.streaming import state
from gleanery.workload import query

SPLIT = "2024-01-15"
def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def half(t, first: bool):
    """Newest event per (type, user) before or after the split: two snapshots of the same keyed rows."""

    e = t.events.filter(F.col("ts") < SPLIT if first else F.col("ts") >= SPLIT)
    return keep_first(e, ["event_type", "user_id"], [F.col("ts").desc(), F.col("event_id").asc()])


HALVES = f"""a as (select * from (select *, row_number() over (partition by event_type, user_id order by ts desc, event_id) rn from events where ts < '{SPLIT}') where rn = 1),
  b as (select * from (select *, row_number() over (partition by event_type, user_id order by ts desc, event_id) rn from events where ts >= '{SPLIT}') where rn = 1)"""


@query("J3_snapshot_diff", f"""with {HALVES}
    select coalesce(a.event_type, b.event_type) as event_type, coalesce(a.user_id, b.user_id) as user_id,
      case when a.user_id is null then 'added' when b.user_id is null then 'removed' when a.props <> b.props then 'changed' else 'same' end as change
    from a full join b on a.event_type = b.event_type and a.user_id = b.user_id""")
def j3(t):
    return snapshots.snapshot_diff(half(t, True), half(t, False), ["event_type", "user_id"], "props")


def job_state(rows, misses, status):
    return rows.select(
        F.col("event_type").alias("source_id"), F.col("user_id").alias("id"), F.col("event_id").alias("origin"), F.col("props").alias("content_hash"), status.alias("status"),
        misses.cast("int").alias("first_missing_successes"), F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_verified_at"), F.lit(None).cast("timestamp").alias("changed_at"))


@query("T1_J4_lifecycle", f"""with {HALVES},
    f as (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as s, unnest([true, true, false, true, true]) as complete, unnest([false, true, false, false, false]) as quarantined),
    j as (select coalesce(a.event_type, b.event_type) as s, coalesce(a.user_id, b.user_id) as id, a.event_id as ao, b.event_id as bo, a.ts as ats, b.ts as bts,
      a.user_id % 2 as m, case when a.user_id % 17 = 0 then 'CLOSED' else 'ACTIVE' end as st, a.props as ap, b.props as bp from a full join b on a.event_type = b.event_type and a.user_id = b.user_id),
    k as (select j.*, not complete or quarantined as keep from j join f using (s))
    select s as source_id, id, case when keep then ao when bo is null then ao else bo end as origin,
      case when keep then st when bo is not null then 'ACTIVE' when m + 1 >= 2 then 'CLOSED' else st end as status,
      case when keep then m when bo is not null then 0 else m + 1 end as misses,
      strftime(case when keep or bo is null or ao is not null then ats else bts end, '%Y-%m-%d %H:%M:%S') as first_seen,
      case when not keep and ao is not null and bo is not null and ap <> bp then '2024-02-01' else '' end as changed
    from k where not (keep and ao is null)""")
def t1(t):
    old = job_state(half(t, True), F.col("user_id") % 2, F.when(F.col("user_id") % 17 == 0, "CLOSED").otherwise("ACTIVE"))
    new = job_state(half(t, False), F.lit(0), F.lit("ACTIVE"))
    flags = t.events.select(F.col("event_type").alias("source_id")).distinct().withColumns({"complete": F.col("source_id") != "purchase", "quarantined": F.col("source_id") == "error"})
    out = snapshots.advance_lifecycle(old, new, flags, now())
    return out.select("source_id", "id", "origin", "status", F.col("first_missing_successes").alias("misses"), F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
                      F.coalesce(F.date_format("changed_at", "yyyy-MM-dd"), F.lit("")).alias("changed"))


@query("T1_keyed_lifecycle", f"""with {HALVES},
    f as (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as s, unnest([true, true, false, true, true]) as complete, unnest([false, true, false, false, false]) as quarantined),
    j as (select coalesce(a.event_type, b.event_type) as s, coalesce(a.user_id, b.user_id) as id, a.ts as ats, b.ts as bts, a.props as ap, b.props as bp from a full join b on a.event_type = b.event_type and a.user_id = b.user_id),
    k as (select j.*, not complete or quarantined as keep from j join f using (s))
    select s as source_id, id::varchar as id, case when keep or bp is null then ap else bp end as content_hash, case when not keep and bts is null then 1 else 0 end as misses,
      strftime(coalesce(ats, bts), '%Y-%m-%d %H:%M:%S') as first_seen, case when not keep and ap <> bp then '2024-02-01' else '' end as changed
    from k where not (keep and ats is null)""")
def t1_keyed(t):
    """Two snapshots through the stream, in as many files as tasks write: rows wait in the state for the end of their snapshot."""

    spark = t.spark
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/lifecycle-{uuid.uuid4().hex}"
    for run, at in ((0, "2024-01-15"), (1, "2024-02-01")):
        when = F.lit(at).cast("timestamp")
        rows = half(t, run == 0).select(
            F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("id"), F.col("props").alias("content_hash"), F.lit("ACTIVE").alias("status"), F.lit(0).alias("first_missing_successes"),
            F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_verified_at"), F.lit(None).cast("timestamp").alias("changed_at"))
        ends = rows.groupBy("source_id").agg(F.count("*").alias("postings")).withColumns({"complete": F.col("source_id") != "purchase" if run else F.lit(True), "quarantined": F.col("source_id") == "error" if run else F.lit(False)})
        feed = rows.unionByName(ends, allowMissingColumns=True).withColumns({"run": F.lit(run).cast("long"), "run_at": when})
        feed.coalesce(1).write.mode("append").parquet(f"{root}/in")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, state.ROCKSDB)
    try:
        stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        running = state.keyed_lifecycle(stream, shards=2).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    out = state.latest_lifecycle(spark.read.parquet(f"{root}/out"))
    return out.select("source_id", "id", "content_hash", F.col("first_missing_successes").alias("misses"), F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
                      F.coalesce(F.date_format("changed_at", "yyyy-MM-dd"), F.lit("")).alias("changed"))


@query("F22_T5_retention", """
    select o_orderkey from orders where o_orderstatus <> 'F' or o_orderdate >= timestamp '2001-07-01' - interval 90 days""")
def f22(t):
    rows = t.orders.withColumn("status", F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("ACTIVE"))
    return snapshots.retain(rows, F.lit("2001-07-01 00:00:00").cast("timestamp"), 90, "status", "o_orderdate").select("o_orderkey")


def fetch_log(t):
    n = F.col("n_nationkey").cast("bigint")
    return t.nation.select(n.alias("source_id"), (n % 6 != 5).alias("complete"), (n % 3 == 0).alias("not_modified"), F.lit("healthy").alias("health"), F.lit(None).cast("string").alias("reason"))


HELD_SOURCES = "(select *, case when s_acctbal > 7000 then s_nationkey else s_nationkey + 100 end as source from supplier)"


def held_postings(t):
    """Every supplier as a posting of an earlier snapshot; poor ones belong to sources that the log doesn't have."""

    source = F.when(F.col("s_acctbal") > 7000, F.col("s_nationkey")).otherwise(F.col("s_nationkey") + 100)
    return t.supplier.select(source.cast("bigint").alias("source_id"), F.col("s_suppkey").alias("id"), F.lit("old").alias("origin"))


@query("T3_reuse_unmodified", f"""
    with held as (select distinct source as s_nationkey from {HELD_SOURCES}),
    j as (select n_nationkey, n_nationkey % 6 <> 5 as c, n_nationkey % 3 = 0 as nm, s_nationkey is not null as has from nation left join held on s_nationkey = n_nationkey)
    select n_nationkey as source_id, nm and has as reuse_previous, c and not (nm and not has) as complete,
      case when nm and not has then 'stale' else 'healthy' end as health, case when nm and not has then 'not_modified_without_previous_snapshot' else '' end as reason from j""")
def t3(t):
    out = snapshots.reuse_unmodified(fetch_log(t), held_postings(t).select("source_id"))
    return out.select("source_id", "reuse_previous", "complete", "health", F.coalesce("reason", F.lit("")).alias("reason"))


@query("T3_reused_snapshot", f"""
    with held as {HELD_SOURCES}
    select source as source_id, s_suppkey as id, 'old' as origin from held where source < 100 and source % 3 = 0
    union all select c_nationkey, c_custkey, 'new' from customer where not (c_nationkey % 3 = 0 and c_nationkey in (select source from held))""")
def t3_rows(t):
    old = held_postings(t)
    new = t.customer.select(F.col("c_nationkey").cast("bigint").alias("source_id"), F.col("c_custkey").alias("id"), F.lit("new").alias("origin"))
    return snapshots.current_or_previous(new, old, snapshots.reuse_unmodified(fetch_log(t), old))


@query("T3_S24_merge_validators", """
    select coalesce(c_custkey, s_suppkey * 20) as source_id, coalesce(s_name, c_name) as etag
    from customer c full join (select * from supplier where s_nationkey % 4 <> 0) s on c_custkey = s_suppkey * 20""")
def t3_validators(t):
    old = t.customer.select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("etag"))
    new = t.supplier.select((F.col("s_suppkey") * 20).alias("source_id"), F.col("s_name").alias("etag"), F.when(F.col("s_nationkey") % 4 == 0, "error").otherwise("healthy").alias("health"))
    return snapshots.merge_validators(old, new)


HISTORY = """(select o_custkey, list(cast(floor(o_totalprice) as bigint) order by o_orderdate, o_orderkey) as h from (
    select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn <= 8 group by 1)"""


def price_history(t):
    """The eight newest totals per customer, oldest first: a stored history of fixed length."""

    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", F.floor("o_totalprice").alias("v"))
    newest = top_per_group(rows, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 8)
    packed = newest.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "v"))).alias("r"))
    return packed.select("o_custkey", F.transform("r", lambda x: x["v"]).alias("h"))


@query("T4_O12_push_history", f"""
    select o_custkey, case when o_custkey % 4 in (0, 1) then array_to_string((h || [o_custkey])[-6:], ',') else array_to_string(h, ',') end as history from {HISTORY} x""")
def t4(t):
    out = snapshots.push_history(F.col("h"), F.col("o_custkey"), F.col("o_custkey") % 4 != 2, F.col("o_custkey") % 4 == 3)
    return price_history(t).select("o_custkey", F.array_join(out, ",").alias("history"))


@query("S14_clean_history", f"""
    select o_custkey, array_to_string(list_filter(list_transform(h, lambda v: v - 100000), lambda v: v >= 0)[-6:], ',') as history from {HISTORY} x""")
def s14(t):
    raw = F.transform("h", lambda v: (v - 100000).cast("string"))
    return price_history(t).select("o_custkey", F.array_join(snapshots.clean_history(raw), ",").alias("history"))


@query("T2_J23_merge_observations", f"""with {HALVES},
    o as (select event_type || ':' || user_id as company_id, event_id % 4 as f, ts as confirmed from a),
    n as (select event_type || ':' || user_id as company_id, ['ACTIVE_CONFIRMED', 'BLOCKED', 'STALE', 'INACTIVE'][event_id % 4 + 1] as st, ts from b),
    j as (select coalesce(o.company_id, n.company_id) as company_id, o.company_id is not null as has_old, n.company_id is not null as has_new, f, st, confirmed, ts from o full join n on o.company_id = n.company_id)
    select company_id, case when not has_new then 'ACTIVE_LEAD' when st = 'ACTIVE_CONFIRMED' then st when st in ('BLOCKED', 'STALE') and has_old then case when f + 1 < 3 then 'STALE' else 'INACTIVE' end else st end as directory_status,
      case when not has_new then f when st = 'ACTIVE_CONFIRMED' then 0 else coalesce(f, 0) + 1 end as consecutive_failures,
      coalesce(strftime(coalesce(confirmed, case when st = 'ACTIVE_CONFIRMED' then ts end), '%Y-%m-%d %H:%M:%S'), '') as first_confirmed from j""")
def t2(t):
    text, stamp = F.lit(None).cast("string"), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    states = F.array(*[F.lit(s) for s in ("ACTIVE_CONFIRMED", "BLOCKED", "STALE", "INACTIVE")])
    signals = F.array().cast("array<string>").alias("signals")
    company = F.concat("event_type", F.lit(":"), "user_id").alias("company_id")
    old = half(t, True).select(
        company, text.alias("cohort"), F.lit("ACTIVE_LEAD").alias("directory_status"), text.alias("entry_type"), text.alias("career_url"),
        text.alias("evidence_url"), signals, text.alias("last_checked_at"), stamp("ts").alias("first_confirmed_at"), (F.col("event_id") % 4).cast("int").alias("consecutive_failures"),
        text.alias("last_error_type"), F.lit(True).alias("public"))
    new = half(t, False).select(
        company, text.alias("cohort"), F.element_at(states, (F.col("event_id") % 4 + 1).cast("int")).alias("directory_status"), text.alias("entry_type"),
        text.alias("career_url"), signals, stamp("ts").alias("checked_at"), text.alias("error_type"))
    out = snapshots.merge_observations(old, new)
    return out.select("company_id", "directory_status", "consecutive_failures", F.coalesce("first_confirmed_at", F.lit("")).alias("first_confirmed"))


@query("T7_remaining_work", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def t7(t):
    return snapshots.remaining_work(t.customer, t.orders.filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


@query("T7_merge_processed", f"""with {HALVES} select event_type, user_id, coalesce(b.event_id, a.event_id) as event_id from a full join b using (event_type, user_id)""")
def t7_merge(t):
    return snapshots.merge_processed(half(t, True), half(t, False), ["event_type", "user_id"], ["event_id"]).select("event_type", "user_id", "event_id")


@query("T8_saturation", """
    with f as (select user_id, min(cast(ts as date)) as run from events group by 1),
    r as (select d.run, (select count(*) from f where f.run = d.run) as added from (select distinct cast(ts as date) as run from events) d)
    select strftime(run, '%Y-%m-%d') as run, added, sum(added) over w = 0 and count(*) over w = 2 as saturated from r window w as (order by run rows between 1 preceding and current row)""")
def t8(t):
    days = t.events.select(F.to_date("ts").alias("run")).distinct()
    added = t.events.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("run")).groupBy("run").agg(F.count("*").alias("_n"))
    runs = days.join(added, "run", "left").select("run", F.coalesce("_n", F.lit(0)).cast("bigint").alias("added"))
    return snapshots.saturation(runs, "run", "added").withColumn("run", F.date_format("run", "yyyy-MM-dd"))


STAGE = "['NOT_APPLIED', 'APPLIED', 'SCREENING', 'INTERVIEW', 'OFFER'][k + 1]"


def stage_log(t):
    stages = F.array(*[F.lit(s) for s in ("NOT_APPLIED", "APPLIED", "SCREENING", "INTERVIEW", "OFFER")])
    k = F.col("event_id") % 5
    return t.events.select(F.col("user_id"), F.col("event_type").alias("job_id"), "ts", "event_id", F.element_at(stages, (k + 1).cast("int")).alias("stage"))


@query("T9_stage_events", f"""
    with s as (select user_id, event_type as job_id, event_id, ts, {STAGE.replace('k', 'event_id % 5')} as stage from events),
    l as (select *, lag(stage) over (partition by user_id, job_id order by ts, event_id) as before from s)
    select user_id, job_id, event_id, stage, case when stage = 'APPLIED' then 'NOTE' else stage end as event_type from l where stage <> 'NOT_APPLIED' and stage is distinct from before""")
def t9(t):
    out = snapshots.stage_events(stage_log(t), ["user_id", "job_id"], [F.col("ts").asc(), F.col("event_id").asc()])
    return out.select("user_id", "job_id", "event_id", "stage", "event_type")


@query("T9_applied_at", """
    select user_id, event_type as job_id, coalesce(strftime(min(case when event_id % 5 <> 0 then ts end), '%Y-%m-%d %H:%M:%S'), '') as applied_at from events group by 1, 2""")
def t9_applied(t):
    out = snapshots.applied_at(stage_log(t), ["user_id", "job_id"], "ts")
    return out.withColumn("applied_at", F.coalesce(F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")))


@query("S11_paging_state", """
    with p as (select l_orderkey, l_linenumber, sum(cast(l_quantity as bigint)) as n from lineitem group by 1, 2),
    a as (select l_orderkey, sum(n) as row_count, max(l_linenumber) as last_page, count(*) as pages, arg_max(n, l_linenumber) as last_rows,
      case when l_orderkey % 2 = 0 then 60 end as total from p group by 1)
    select l_orderkey as source_id, cast(row_count as bigint) as row_count, coalesce(case when pages < last_page then 'incomplete_pagination' when row_count >= total then null when total is not null and last_rows = 0 then 'incomplete_pagination'
      when total is null and last_rows < 25 then null when last_page >= 7 then 'truncated_feed' else 'incomplete_pagination' end, '') as error from a""")
def s11(t):
    lines = dealt_by_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"])
    pages = lines.groupBy(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("page")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("row_count"))
    pages = pages.withColumns({"total": F.when(F.col("source_id") % 2 == 0, 60), "page_size": F.lit(25), "max_pages": F.lit(7)})
    return feeds.paging_state(pages).select("source_id", "row_count", F.coalesce("error", F.lit("")).alias("error"))


@query("S11_rows_of_whole_feeds", """
    with p as (select o_custkey, count(*) as n from orders group by 1)
    select o_orderkey from orders where o_custkey in (select o_custkey from p where n >= 10)""")
def s11_rows(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("source_id")).agg((F.count("*") >= 10).alias("complete"))
    return feeds.complete_rows(t.orders.withColumnRenamed("o_custkey", "source_id"), counts).select("o_orderkey")


@query("S31_parse_health", """
    with o as (select o_custkey, count(*) as raw_count, count(*) filter (where o_orderpriority <> '5-LOW') as in_scope, count(*) filter (where o_orderpriority <> '5-LOW' and o_totalprice > 300000) as valid_rows from orders group by 1),
    j as (select c_custkey as source_id, c_custkey % 11 <> 0 as recognised, coalesce(raw_count, 0) as raw_count, coalesce(in_scope, 0) as in_scope, coalesce(valid_rows, 0) as valid_rows from customer left join o on o_custkey = c_custkey)
    select *, coalesce(case when not recognised then 'incomplete_payload' when in_scope > 0 and valid_rows = 0 then 'invalid_items' end, '') as error,
      recognised and not (in_scope > 0 and valid_rows = 0) as complete from j""")
def s31(t):
    sources = t.customer.select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") % 11 != 0).alias("recognised"))
    rows = t.orders.withColumnRenamed("o_custkey", "source_id")
    out = feeds.parse_health(sources, rows, F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") > 300000)
    return out.withColumn("error", F.coalesce("error", F.lit("")))


@query("S25_refresh_sources", """
    with r as (select s_suppkey, s_nationkey, ['VERIFIED', 'AUTO_VERIFIED', 'TARGET'][s_nationkey % 3 + 1] as status, ['VERIFIED', 'AUTO_VERIFIED', 'TARGET'][case when s_suppkey % 5 = 0 then 2 else s_nationkey % 3 end + 1] as old from supplier)
    select s_suppkey as source_id, status, case when status = old and status <> 'TARGET' then 'healthy' else 'not_ready' end as health,
      case when status = old and status <> 'TARGET' then 'kept' when status = 'TARGET' then 'status_target' else '' end as reason from r""")
def s25(t):
    names = F.array(*[F.lit(x) for x in ("VERIFIED", "AUTO_VERIFIED", "TARGET")])
    k = F.col("s_nationkey") % 3
    registry = t.supplier.select(F.col("s_suppkey").alias("source_id"), F.element_at(names, k + 1).alias("status"))
    published = t.supplier.select(F.col("s_suppkey").alias("source_id"), F.element_at(names, F.when(F.col("s_suppkey") % 5 == 0, 2).otherwise(k) + 1).alias("status"), F.lit("healthy").alias("health"), F.lit("kept").alias("reason"))
    return sinks.refresh_sources(registry, published, kept=("health", "reason")).withColumn("reason", F.coalesce("reason", F.lit("")))


@query("S28_upsert_job_states", """
    with p as (select user_id, event_type, max_by(case when event_id % 3 = 0 then 'SUITABLE' end, event_id) filter (where event_id % 3 = 0) as interest, arg_max(case when event_id % 2 = 0 then 'APPLIED' else 'OFFER' end, event_id) as stage from events where ts >= '2024-01-15' group by 1, 2),
    o as (select user_id, event_type, 'UNSUITABLE' as interest, 'SCREENING' as stage, min(ts) as created from events where ts < '2024-01-15' group by 1, 2)
    select coalesce(o.user_id, p.user_id) as user_id, coalesce(o.event_type, p.event_type) as job_id, coalesce(p.interest, o.interest, 'UNSET') as interest, coalesce(p.stage, o.stage) as stage,
      coalesce(strftime(created, '%Y-%m-%d %H:%M:%S'), '2024-02-01 00:00:00') as created from o full join p using (user_id, event_type)""")
def s28(t):
    e = t.events.withColumnRenamed("event_type", "job_id")
    old = e.filter(F.col("ts") < SPLIT).groupBy("user_id", "job_id").agg(F.lit("UNSUITABLE").alias("interest"), F.lit("SCREENING").alias("stage"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    patches = e.filter(F.col("ts") >= SPLIT).select("user_id", "job_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "SUITABLE").alias("interest"), F.when(F.col("event_id") % 2 == 0, "APPLIED").otherwise("OFFER").alias("stage"))
    out = sinks.upsert_job_states(old, patches, now())
    return out.select("user_id", "job_id", "interest", "stage", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("S29_toggle_and_delete", """
    with f as (select user_id, count(*) % 2 = 1 as flip from events where event_type = 'click' group by 1)
    select o_orderkey, case when coalesce(flip, false) then o_orderstatus <> 'F' else o_orderstatus = 'F' end as completed from orders left join f on user_id = o_orderkey
    where o_custkey not in (select s_suppkey from supplier)""")
def s29(t):
    events = t.orders.select(F.col("o_orderkey").alias("event_id"), "o_custkey", (F.col("o_orderstatus") == "F").alias("completed"), F.lit(None).cast("timestamp").alias("completed_at"))
    toggles = t.events.filter("event_type = 'click'").select(F.col("user_id").alias("event_id"))
    kept = sinks.without_rows(events, t.supplier.select(F.col("s_suppkey").alias("o_custkey")), ["o_custkey"])
    return sinks.toggle_done(kept, toggles, now()).select(F.col("event_id").alias("o_orderkey"), "completed")


@query("S29_preference_defaults", "select c_custkey, case when c_acctbal < 0 then 'MAINLAND_CHINA' else c_mktsegment end as scope from customer")
def s29_defaults(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("scope"))
    return sinks.with_defaults(rows, {"scope": F.lit("MAINLAND_CHINA")})


@query("S26_csv_cells", """
    select c_custkey::varchar as c_custkey, case when c_acctbal::varchar like '-%' then '''' || c_acctbal::varchar else c_acctbal::varchar end as c_acctbal from customer""")
def s26(t):
    return sinks.csv_rows(t.customer.select("c_custkey", "c_acctbal"))
