"""Faceted search, preferences, grouped and personal views."""

from pyspark.sql import functions as F

from gleanery.functions.locations import location
from gleanery.operators import facets
from gleanery.workload import query

def now():
    return F.lit("1999-06-15 10:00:00").cast("timestamp")


@query("F18_matches_choices", """
    select p_partkey from part where p_type in ('PROMO', 'LARGE') and p_size in (1, 5, 9, 30)""")
def f18(t):
    return facets.facet_filter(t.part, {"p_type": ["PROMO", "LARGE"], "p_size": [1, 5, 9, 30], "p_brand": []}).select("p_partkey")


@query("F19_facet_filter", """
    select o_orderkey from orders left join customer on c_custkey = o_custkey where contains(lower(o_orderpriority || ' ' || c_name || ' ' || c_mktsegment), 'high customer#00000') and o_orderstatus = 'O'
      and o_orderdate >= '1998-01-01' and o_orderdate <= '2000-12-31' and o_totalprice >= 10000 and c_acctbal > 0""")
def f19(t):
    comp = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_acctbal")
    rows = facets.with_company(t.orders, comp, "o_custkey")
    out = facets.facet_filter(rows, {"o_orderstatus": ["O"]}, {"o_orderdate": ("1998-01-01", "2000-12-31"), "o_totalprice": (10000, None)}, " HIGH Customer#00000", ["o_orderpriority", "c_name", "c_mktsegment"], F.col("c_acctbal") > 0)
    return out.select("o_orderkey")


@query("F19_text_search", "select doc_id from documents where contains(lower(text), 'the license') or contains(lower(source || ' ' || text), 'tion and')")
def f19_text(t):
    either = facets.text_match(["text"], "the LICENSE") | facets.text_match(["source", "text"], "tion and")
    return t.documents.filter(either).select("doc_id")


def customer_places(t):
    """Two places per customer: the nation it lives in and the one its key points to."""

    n = F.col("c_nationkey")
    one = location(scope=F.when(n % 3 == 0, "OVERSEAS").otherwise("MAINLAND_CHINA"), country_code=F.concat(F.lit("C"), n % 4), province_code=F.concat(F.lit("P"), n % 5), city_code=F.concat(F.lit("P"), n % 5, F.lit("-N"), n), display_name=F.concat(F.lit("N"), n, F.lit("市")), raw=F.concat(F.lit("N"), n))
    m = (F.col("c_custkey") % 25).cast("int")
    two = location(scope=F.lit("MAINLAND_CHINA"), country_code=F.concat(F.lit("C"), m % 4), province_code=F.concat(F.lit("P"), m % 5), city_code=F.concat(F.lit("P"), m % 5, F.lit("-N"), m), display_name=F.when(m == 7, "全国").otherwise(F.concat(F.lit("N"), m)), raw=F.concat(F.lit("N"), m))
    return t.customer.select("c_custkey", F.array(one, two).alias("locations"))


@query("F17_matches_location", """
    with x as (select c_custkey, c_nationkey as n, c_custkey % 25 as m from customer)
    select c_custkey from x where (n % 3 <> 0 and n % 5 = 1 and n in (1, 6, 11)) or m = 7 or (m % 5 = 1 and m in (1, 6, 11))""")
def f17(t):
    fits = facets.matches_location("locations", scopes=["MAINLAND_CHINA"], provinces=["P1"], city_codes=["P1-N1", "P1-N6", "P1-N11"])
    return customer_places(t).filter(fits).select("c_custkey")


@query("F17_named_city", """
    with x as (select c_custkey, c_nationkey as n, c_custkey % 25 as m from customer) select c_custkey from x where n in (4, 8) or m in (4, 8, 7)""")
def f17_names(t):
    return customer_places(t).filter(facets.matches_location("locations", cities=["N4市", "N8"])).select("c_custkey")


@query("F24_F31_date_predicates", """
    with d as (select o_orderkey, o_orderstatus, o_orderdate as ts, date_diff('day', timestamp '1999-06-15 18:00:00'::date, (o_orderdate + interval 8 hours)::date) as days from orders)
    select o_orderkey, days between 0 and 7 as due_soon, days < 0 and o_orderstatus <> 'F' as is_overdue, days = 0 as is_today, ts between timestamp '1999-06-15 10:00:00' and timestamp '1999-06-22 10:00:00' as in_week from d""")
def f24(t):
    from gleanery.functions.dates import is_due_within

    rows = facets.schedule_flags(t.orders.withColumn("done", F.col("o_orderstatus") == "F"), now(), "o_orderdate", "done")
    return rows.select("o_orderkey", is_due_within("o_orderdate", now()).alias("due_soon"), "is_overdue", "is_today", "in_week")


@query("F31_tracked_rows", "select o_orderkey from orders where contains(lower(o_orderpriority || ' ' || o_orderstatus), 'urgent') and o_orderstatus = 'P'")
def f31(t):
    rows = t.orders.withColumnRenamed("o_orderstatus", "stage")
    return facets.tracked_rows(rows, "Urgent", "P", ["o_orderpriority", "stage"]).select("o_orderkey")


@query("A19_stage_counts", """
    select k as stage, i - 1 as class_no, (select count(*) from orders where o_orderstatus = k) as rows from (select unnest(['O', 'X', 'F', 'P']) as k, unnest([1, 2, 3, 4]) as i)""")
def a19(t):
    return facets.fixed_class_counts(t.orders.withColumnRenamed("o_orderstatus", "stage"), "stage", ["O", "X", "F", "P"])


@query("A20_option_values", "select distinct p_brand from part where p_size > 45")
def a20(t):
    return facets.option_values(t.part, "p_brand", F.col("p_size") > 45)


@query("A20_city_options", """
    with x as (select c_custkey, c_nationkey as n, 0 as pos, 'N' || c_nationkey || '市' as label, case when c_nationkey % 3 = 0 then 'OVERSEAS' else 'MAINLAND_CHINA' end as scope from customer
      union all select c_custkey, c_custkey % 25, 1, case when c_custkey % 25 = 7 then '全国' else 'N' || (c_custkey % 25) end, 'MAINLAND_CHINA' from customer)
    select 'P' || (n % 5) || '-N' || n as value, label from (select *, row_number() over (partition by n order by c_custkey desc, pos desc) rn from x where scope = 'MAINLAND_CHINA' and n % 5 in (1, 2) and label <> '全国') where rn = 1""")
def a20_cities(t):
    return facets.city_options(customer_places(t), scope="MAINLAND_CHINA", provinces=["P1", "P2"], seq="c_custkey")


@query("A21_overview", """
    with d as (select o_orderdate, o_orderpriority, date_diff('day', date '1999-06-15', (o_orderdate + interval 8 hours)::date) as days from orders)
    select count(*) filter (where o_orderdate > timestamp '1999-01-01') as new_since_visit, count(*) filter (where days between 0 and 7) as due_soon, count(*) filter (where o_orderpriority = '5-LOW') as matched, count(*) as shown from d""")
def a21(t):
    return facets.overview(t.orders, now(), F.lit("1999-01-01 00:00:00").cast("timestamp"), F.col("o_orderpriority") == "5-LOW", "o_orderdate", "o_orderdate")


@query("A21_tracked_count", "select count(*) filter (where event_type not in ('view', 'error')) as active_tracked from events")
def a21_tracked(t):
    return facets.tracked_count(t.events.select(F.when(F.col("event_type") == "view", "NOT_APPLIED").when(F.col("event_type") == "error", "REJECTED").otherwise("APPLIED").alias("stage")))


@query("X24_match_reasons", """
    select p_partkey, array_to_string(list_filter([case when p_type = 'PROMO' then p_type end, case when p_size > 20 then 'big' end, case when contains(p_name, 'red') then 'red' end, case when p_brand = 'Brand#3' then p_brand end], lambda x: x is not null)[1:3], ',') as reasons from part""")
def x24(t):
    got = facets.match_reasons([(F.col("p_type") == "PROMO", F.col("p_type")), (F.col("p_size") > 20, "big"), (F.col("p_name").contains("red"), "red"), (F.col("p_brand") == "Brand#3", F.col("p_brand"))])
    return t.part.select("p_partkey", F.array_join(got, ",").alias("reasons"))


@query("U2_shown_jobs", "select coalesce(b.p_partkey, a.p_partkey) as id, case when b.p_partkey is null then 'formal' else 'provisional' end as origin from (select * from part where p_size > 10) a full join (select * from part where p_size < 20) b on a.p_partkey = b.p_partkey")
def u2_shown(t):
    formal = t.part.filter("p_size > 10").select(F.col("p_partkey").alias("id"), F.lit("formal").alias("origin"))
    late = t.part.filter("p_size < 20").select(F.col("p_partkey").alias("id"), F.lit("provisional").alias("origin"))
    return facets.shown_jobs(formal, late, ["id"])
