"""Choosing rows per key, ranks, samples, unions and orders."""

from pyspark.sql import functions as F

from gleanery.operators import dedup, facets, reports
from gleanery.scale import collect_in_chunks, rank_rows
from gleanery.workload import query

DAY = "to_date(ts)"


@query("W1_latest_per_key", """
    select user_id, event_type, event_id, value from (
      select *, row_number() over (partition by user_id, event_type order by ts desc, event_id) rn from events) where rn = 1""")
def w1(t):
    return dedup.latest_per_key(t.events, ["user_id", "event_type"], "ts", ["event_id"]).select("user_id", "event_type", "event_id", "value")


@query("W2_first_per_key", """
    select raw_key, first_id from (select lower(concat_ws('|', p_name, p_brand, p_type)) as raw_key, p_partkey as first_id,
      row_number() over (partition by lower(concat_ws('|', p_name, p_brand, p_type)) order by p_partkey) rn from part) where rn = 1""")
def w2(t):
    rows = t.part.withColumn("raw_key", dedup.raw_key("p_name", "p_brand", "p_type"))
    return dedup.first_per_key(rows, ["raw_key"], ["p_partkey"]).select("raw_key", F.col("p_partkey").alias("first_id"))


@query("W3_global_rank", "select row_number() over (order by c_acctbal desc, c_custkey) as rank, c_custkey from customer")
def w3(t):
    return rank_rows(t.customer.select("c_acctbal", "c_custkey"), [F.col("c_acctbal").desc(), F.col("c_custkey").asc()]).select("rank", "c_custkey")


@query("W3_rank_in_hot_group", """
    select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as place,
      count(*) over (partition by o_orderpriority) as group_size from orders""")
def w3_groups(t):
    rows = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    out = rank_rows(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], ["o_orderpriority"], "place", "group_size")
    return out.select("o_orderpriority", "o_orderkey", "place", "group_size")


@query("W4_spread_sample", """
    with r as (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) - 1 as i,
      count(*) over (partition by o_orderpriority) as n from orders)
    select o_orderpriority, o_orderkey, i + 1 as sample_pos from r where n <= 3 or i in (0, n // 2, n - 1)""")
def w4(t):
    rows = t.orders.select("o_orderpriority", "o_orderkey", "o_orderdate")
    return dedup.spread_sample(rows, ["o_orderpriority"], [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]).select("o_orderpriority", "o_orderkey", "sample_pos")


@query("W5_bounded_samples", """
    select event_type, event_id, sample_no from (
      select event_type, event_id, row_number() over (partition by event_type order by ts, event_id) as sample_no from events) where sample_no <= 40""")
def w5(t):
    return dedup.bounded_samples(t.events.select("event_type", "event_id", "ts"), ["event_type"], [F.col("ts").asc(), F.col("event_id").asc()], 40).select("event_type", "event_id", "sample_no")


@query("W6_top_with_more", """
    with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as pos,
      count(*) over (partition by o_custkey) > 5 as has_more from orders)
    select o_custkey, o_orderkey, pos, has_more from r where pos <= 5""")
def w6(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return dedup.top_with_more(rows, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").asc()]).select("o_custkey", "o_orderkey", "pos", "has_more")


@query("W9_groups_by_head", """
    select o_orderkey, o_custkey, strftime(first_value(o_orderdate) over (partition by o_custkey order by o_orderdate desc, o_orderkey), '%Y-%m-%d') as head_date
    from orders""")
def w9(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    out = dedup.order_groups_by_head(rows, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").asc()], "o_orderdate")
    return out.select("o_orderkey", "o_custkey", F.date_format("group_o_orderdate", "yyyy-MM-dd").alias("head_date"))


@query("W10_first_seen", "select user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen from events group by 1, 2")
def w10(t):
    out = dedup.earliest(t.events, ["user_id", "event_type"], "ts", "first")
    return out.select("user_id", "event_type", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("W11_best_per_key", """
    select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by (event_type = 'purchase') desc, ts, event_id) rn
      from events) where rn = 1""")
def w11(t):
    return dedup.best_per_key(t.events, ["user_id"], F.col("event_type") == "purchase", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("W12_longest_per_key", """
    select lang, doc_id, n_chars from (select *, row_number() over (partition by lang order by length(text) desc, doc_id) rn from documents) where rn = 1""")
def w12(t):
    return dedup.longest_per_key(t.documents, ["lang"], "text", ["doc_id"]).select("lang", "doc_id", "n_chars")


@query("A15_merge_values", """
    with x as (select n_regionkey, n_nationkey, unnest([n_name, 'ID' || (n_nationkey % 3)]) as value, unnest([0, 1]) as pos from nation
               join (select distinct c_nationkey from customer) c on c_nationkey = n_nationkey)
    select n_regionkey, value, min(n_nationkey) as first_nation from x group by 1, 2""")
def a15(t):
    keep = t.nation.join(t.customer.select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi")
    rows = keep.withColumn("names", F.array("n_name", F.concat(F.lit("ID"), (F.col("n_nationkey") % 3).cast("string"))))
    return dedup.merge_values(rows, ["n_regionkey"], ["names"], "n_nationkey").select("n_regionkey", "value", F.col("first_at.n_nationkey").alias("first_nation"))


@query("A15_merge_scalars", """
    select user_id, arg_min(event_type, event_id) filter (where event_type <> 'error') as event_type, arg_min(value, event_id) as value from events group by 1""")
def a15_scalars(t):
    rows = t.events.withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    return dedup.merge_scalars(rows, ["user_id"], ["event_type", "value"], "event_id")


@query("A5_ordered_chunks", """
    with r as (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) - 1 as i from orders)
    select o_orderpriority, i // 500 as chunk_no, count(*) as items, string_agg(o_orderkey::varchar, ',' order by i) as members from r group by 1, 2""")
def a5_chunks(t):
    rows = t.orders.select("o_orderpriority", "o_orderkey", "o_orderdate")
    out = collect_in_chunks(rows, ["o_orderpriority"], "o_orderkey", [F.col("o_orderdate"), F.col("o_orderkey")], 500, "members")
    return out.select("o_orderpriority", "chunk_no", F.size("members").cast("bigint").alias("items"), F.array_join("members", ",").alias("members"))


@query("U1_union_rows", """
    select 'customer' as kind, c_name as name, c_mktsegment as segment from customer
    union all select 'supplier', s_name, null from supplier""")
def u1(t):
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return dedup.union_rows(a, t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name")))


@query("U2_union_later_wins", """
    with both_ as (select 0 as b, user_id, event_id, value from events where event_type = 'view' union all
                  select 1, user_id, event_id, value from events where event_type = 'click')
    select user_id, event_id, value from (select *, row_number() over (partition by user_id order by b desc, event_id desc) rn from both_) where rn = 1""")
def u2(t):
    e = t.events.select("user_id", "event_id", "value", "event_type")
    formal, late = e.filter("event_type = 'view'"), e.filter("event_type = 'click'")
    return dedup.union_later_wins(["user_id"], ["event_id"], formal, late).select("user_id", "event_id", "value")


@query("U4_set_difference", """
    select count(*) as remaining from (select c_nationkey from customer except select s_nationkey from supplier where s_acctbal > 5000
      except select n_nationkey from nation where n_regionkey = 1)""")
def u4(t):
    key = lambda df, c: df.select(F.col(c).alias("k"))
    return facets.set_difference_count(key(t.customer, "c_nationkey"), key(t.supplier.filter("s_acctbal > 5000"), "s_nationkey"),
                                       key(t.nation.filter("n_regionkey = 1"), "n_nationkey"), key="k")


@query("U5_key_intersection", "select p_partkey, len(list_intersect(string_split(p_name, ' '), ['red', 'widget', 'ring'])) > 0 as overlaps from part")
def u5(t):
    words = F.array(F.lit("red"), F.lit("widget"), F.lit("ring"))
    return t.part.select("p_partkey", F.arrays_overlap(F.split("p_name", " "), words).alias("overlaps"))


@query("U6_ordered_union", """
    select p_partkey, concat_ws(' ', split_part(p_name, ' ', 1), nullif(split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)),
      case when lower(p_type) in (split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) then null else lower(p_type) end) as words from part""")
def u6(t):
    words = dedup.ordered_union(F.split("p_name", " "), F.array(F.lower("p_type")))
    return t.part.select("p_partkey", F.array_join(words, " ").alias("words"))


@query("O1_catalog_order", """
    select o_orderkey, row_number() over (order by o_orderdate desc, o_orderpriority desc, o_orderstatus desc, o_orderkey) as place from orders""")
def o1(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    order = reports.catalog_order("o_orderdate", "o_orderpriority", "o_orderstatus")
    return rank_rows(rows, [*order, F.col("o_orderkey").asc()], rank="place").select("o_orderkey", "place")


@query("O5_sort_modes", """
    select 'deadline' as mode, p_partkey, row_number() over (order by p_size, p_retailprice desc, p_partkey) as place from part
    union all select 'publish', p_partkey, row_number() over (order by p_retailprice desc, p_name, p_partkey) from part
    union all select 'match', p_partkey, row_number() over (order by case when p_type = 'PROMO' then 1 else 0 end desc, p_retailprice desc, p_partkey) from part
    union all select 'open', p_partkey, row_number() over (order by p_size desc, p_partkey) from part
    union all select 'company', p_partkey, row_number() over (order by p_name, p_partkey) from part""")
def o5(t):
    rows = t.part.select("p_partkey", "p_size", "p_retailprice", "p_name", "p_type")
    modes = []
    for mode in ("deadline", "publish", "match", "open", "company"):
        keys = facets.sort_keys(mode, title="p_name", company="p_name", publish="p_retailprice", deadline="p_size", first_seen="p_size", matched=F.col("p_type") == "PROMO", seq="p_partkey")
        modes.append(rank_rows(rows, keys, rank="place").select(F.lit(mode).alias("mode"), "p_partkey", "place"))
    return dedup.union_rows(*modes)


@query("O6_chinese_order")
def o6(t):
    return t.supplier.select("s_name").orderBy(facets.in_chinese_order("s_name"))


@query("O7_next_actions", "select event_id, event_type from events where event_type <> 'error' order by ts, event_id limit 5")
def o7(t):
    rows = t.events.withColumn("done", F.col("event_type") == "error")
    return facets.next_actions(rows, 5, "ts", "done", "event_id").select("event_id", "event_type")


@query("O8_recent_leads", "select o_orderkey from orders order by o_orderdate desc, o_totalprice limit 24")
def o8(t):
    return facets.recent_leads(t.orders, 24, "o_orderdate", "o_totalprice").select("o_orderkey")


@query("O10_domain_batch", """
    with r as (select c_custkey, case when c_nationkey = 3 then 'unknown' else 'nation' || c_nationkey end as dom,
      row_number() over (order by c_mktsegment <> 'BUILDING', c_custkey) as pos from customer),
    s as (select * from r where pos > 100), h as (select dom from s where dom <> 'unknown' group by 1 order by min(pos) limit 10)
    select c_custkey from s where dom = 'unknown' or dom in (select dom from h) order by pos limit 50""")
def o10(t):
    domain = F.when(F.col("c_nationkey") == 3, "unknown").otherwise(F.concat(F.lit("nation"), F.col("c_nationkey")))
    order = [(F.col("c_mktsegment") != "BUILDING").cast("int").asc(), F.col("c_custkey").asc()]
    return reports.domain_batch(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), order, domain, 100, 50, 10, "c_custkey").select("c_custkey")
