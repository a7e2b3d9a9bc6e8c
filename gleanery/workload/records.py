"""Envelopes, record mapping and sanitizers. Items are JSON built from the shared tables, so their number grows with them."""

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import dates, urls
from gleanery.scale import dealt, ensure_checkpoint_dir
from gleanery.sources import envelopes, feeds, records, registry, sinks
from gleanery.workload import query


@query("P1_map_record", """
    select doc_id, coalesce(case when lang <> 'en' then lang end, source, 'none') as label, coalesce(nullif(trim(substr(text, 1, 1)), ''), 'none') as first_char from documents""")
def p1(t):
    spec = {"label": [F.when(F.col("lang") != "en", F.col("lang")).otherwise(F.lit(" ")), "source"], "first_char": [F.trim(F.substring("text", 1, 1))]}
    return records.map_record(t.documents, spec, ["doc_id"], {"label": "none", "first_char": "none"})


def bodies(t):
    """One JSON body per event; the wrapper depends on the event."""

    wraps = ["{{\"jobs\":[{0},{0}]}}", "{{\"data\":{{\"list\":[{0}]}}}}", "[{0},{0},{0}]", "{{\"d\":{{\"results\":[]}}}}", "{{\"message\":{0}}}", "{{\"broken\":"]
    k = F.col("event_id") % len(wraps)
    chain = None
    for i, wrap in enumerate(wraps):
        made = F.lit(wrap.replace("{{", "{").replace("}}", "}"))
        made = F.replace(made, F.lit("{0}"), F.col("props"))
        chain = F.when(k == i, made) if chain is None else chain.when(k == i, made)
    return t.events.select("event_id", chain.alias("body"))


@query("S6_unwrap_envelopes", """
    select event_id, case event_id % 6 when 0 then 2 when 1 then 1 when 2 then 3 else 0 end as items, event_id % 6 < 4 as found,
      cast(case event_id % 6 when 0 then 2 when 1 then 1 when 2 then 3 else 0 end * cast(json_extract(props, '$.k') as bigint) as bigint) as total from events""")
def s6(t):
    rows = envelopes.unwrap(bodies(t), "body")
    k = F.try_variant_get("item", "$.k", "bigint")
    return rows.groupBy("event_id").agg(F.count(k).alias("items"), F.bool_or("found").alias("found"), F.coalesce(F.sum(k), F.lit(0)).alias("total"))


@query("S7_directory_envelopes", """
    select event_id, 4 as rows, cast(4 * cast(json_extract(props, '$.k') as bigint) as bigint) as total from events""")
def s7(t):
    body = F.replace(F.lit('{"companies":[{0}],"data":{"items":[{0},{0}],"rows":[1]},"result":[{0}],"other":[{0}]}'), F.lit("{0}"), F.col("props"))
    rows = envelopes.all_directory_rows(F.try_parse_json(body))
    total = F.aggregate(rows, F.lit(0).cast("bigint"), lambda acc, x: acc + F.try_variant_get(x, "$.k", "bigint"))
    return t.events.select("event_id", F.size(rows).alias("rows"), total.alias("total"))


@query("S7_deep_envelopes", """
    select event_id, case when event_id % 2 = 0 then 6 else 2 end as rows, cast(case when event_id % 2 = 0 then 6 else 2 end * cast(json_extract(props, '$.k') as bigint) as bigint) as total from events""")
def s7_deep(t):
    """Envelopes three to five levels deep, beside lists on the way."""
    shallow = '{"data":{"result":{"items":[{0},{0}]}}}'
    deep = '{"data":{"items":[{0}],"result":{"data":{"rows":[{0},{0},7],"result":{"list":[{0},{0},{0}]}}}}}'
    body = F.replace(F.when(F.col("event_id") % 2 == 0, deep).otherwise(shallow), F.lit("{0}"), F.col("props"))
    rows = envelopes.all_directory_rows(F.try_parse_json(body))
    total = F.aggregate(rows, F.lit(0).cast("bigint"), lambda acc, x: acc + F.try_variant_get(x, "$.k", "bigint"))
    return t.events.select("event_id", F.size(rows).alias("rows"), total.alias("total"))


@query("S8_S12_page_meta", """
    select event_id, event_id % 500 as total, case when event_id % 2 = 0 then 20 else -1 end as page_size, case when event_id % 3 = 0 then 2 else 0 end as items, case when event_id % 3 = 0 then event_id % 500 else -1 end as listing_total from events""")
def s8(t):
    rows = F.when(F.col("event_id") % 3 == 0, "[{},{}]").otherwise("null")
    size = F.when(F.col("event_id") % 2 == 0, ',"pageSize":"20"').otherwise("")
    body = F.concat(F.lit('{"data":{"total":"'), F.col("event_id") % 500, F.lit('","list":'), rows, size, F.lit("}}"))
    payload = F.try_parse_json(body)
    meta, page = envelopes.page_meta(payload), envelopes.listing_page(payload)
    none = F.lit(-1).cast("bigint")
    return t.events.select("event_id", F.coalesce(meta["total"], none).alias("total"), F.coalesce(meta["page_size"], none).alias("page_size"), F.size(page["items"]).alias("items"), F.coalesce(page["total"], none).alias("listing_total"))


@query("S1_json_rows_and_rejects", """
    select event_type, count(*) filter (where event_id % 7 not in (3, 5)) as good, cast(sum(case when event_id % 7 not in (3, 5) then cast(json_extract(props, '$.k') as bigint) end) as bigint) as total, 0 as rejected from events group by 1
    union all select 'rejects', 0, 0, count(*) from events where event_id % 7 in (3, 5)""")
def s1(t):
    """A snapshot written as JSON lines and scanned: some lines are cut short, some lack the required field."""
    line = F.concat(F.lit('{"kind":"'), "event_type", F.lit('"'), F.when(F.col("event_id") % 7 == 5, "").otherwise(F.concat(F.lit(',"k":'), F.try_variant_get(F.parse_json("props"), "$.k", "string"))), F.when(F.col("event_id") % 7 == 3, "").otherwise("}"))
    ensure_checkpoint_dir(t.spark)
    path = f"{t.spark.sparkContext.getCheckpointDir()}/snapshot-{uuid.uuid4().hex}"
    t.events.select(line.alias("value")).write.text(path)
    good, rejects = registry.read_json_rows(t.spark, path, T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("k", T.LongType(), False)]), multi_line=False)
    counts = good.groupBy(F.col("kind").alias("event_type")).agg(F.count("*").alias("good"), F.sum("k").alias("total")).withColumn("rejected", F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    return counts.unionByName(rejects.groupBy().agg(F.count("*").alias("rejected")).select(F.lit("rejects").alias("event_type"), zero.alias("good"), zero.alias("total"), "rejected"))


@query("S30_payload_kind", "select page_id, case when page_id % 2 = 0 or page_id % 3 = 0 then 'json' else 'html' end as kind from pages")
def s30(t):
    body = F.when(F.col("page_id") % 2 == 0, F.lit(' \n{"a":1}')).otherwise(F.col("html"))
    kind = F.when(F.col("page_id") % 3 == 0, "Application/JSON; charset=utf-8").otherwise("text/html")
    return t.pages.select("page_id", envelopes.payload_kind(kind, body).alias("kind"))


@query("Z2_jsonld_objects", "select p_partkey, case when p_size > 25 then 2 else 1 end as objects, case when p_size > 25 then 1 else 0 end as postings from part")
def z2(t):
    one = F.concat(F.lit('{"@type":"Organization","name":"'), "p_name", F.lit('"}'))
    graph = F.concat(F.lit('{"@graph":['), one, F.lit(',{"@type":["Thing","https://schema.org/JobPosting"],"title":"'), "p_name", F.lit('"}]}'))
    found = envelopes.jsonld_objects(F.array(F.when(F.col("p_size") > 25, graph).otherwise(one), F.lit("not json")))
    return t.part.select("p_partkey", F.size(found).alias("objects"), F.size(F.filter(found, lambda x: envelopes.is_type(x))).alias("postings"))


@query("Z2_deep_graphs", "select p_partkey, cast(2 + p_size % 4 as int) as objects, 1 as postings, p_name as title from part")
def z2_deep(t):
    """Graphs nested two to five deep."""
    inner = F.concat(F.lit('[{"@type":"JobPosting","title":"'), "p_name", F.lit('"}]'))
    nested = inner
    wrapped = [inner]
    for _ in range(5):
        nested = F.concat(F.lit('[{"@graph":'), nested, F.lit('},{"@type":"Thing"}]'))
        wrapped.append(nested)
    depth = (F.col("p_size") % 4 + 1).cast("int")
    body = F.concat(F.lit('{"@graph":'), F.element_at(F.array(*wrapped), depth + 1), F.lit("}"))
    found = envelopes.jsonld_objects(F.array(body, F.lit("not json")))
    jobs = F.filter(found, lambda x: envelopes.is_type(x))
    return t.part.select("p_partkey", F.size(found).alias("objects"), F.size(jobs).alias("postings"), F.try_variant_get(F.get(jobs, F.lit(0)), "$.title", "string").alias("title"))


@query("Z3_assigned_object", "select p_partkey, p_partkey as id, p_name as name from part")
def z3(t):
    script = F.concat(F.lit("<script>var a = {}; window.BSGlobal = {\"id\":"), "p_partkey", F.lit(',"x":{"y":"}"},"name":"'), "p_name", F.lit("\"}; run({});</script>"))
    got = envelopes.assigned_object(script, "BSGlobal")
    return t.part.select("p_partkey", F.try_variant_get(got, "$.id", "bigint").alias("id"), F.try_variant_get(got, "$.name", "string").alias("name"))


FEED_SQL = """select p_partkey, p_name as title, 'j' || p_partkey as id, 'https://x.example.com/jobs/' || p_partkey as url, '2026-09-10' as published from part where p_size > 10"""


def feed_bodies(t):
    """One RSS or Atom body per part; small parts lack the link."""

    link = F.when(F.col("p_size") > 10, F.concat(F.lit("<link>/jobs/"), "p_partkey", F.lit("</link>"))).otherwise("")
    rss = F.concat(F.lit("<rss><channel><item><guid>j"), "p_partkey", F.lit("</guid><title>"), "p_name", F.lit("</title>"), link, F.lit("<pubDate>Thu, 10 Sep 2026 08:00:00 GMT</pubDate></item></channel></rss>"))
    href = F.when(F.col("p_size") > 10, F.concat(F.lit('<link href="https://x.example.com/jobs/'), "p_partkey", F.lit('"/>'))).otherwise("")
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>j'), "p_partkey", F.lit("</id><title>"), "p_name", F.lit("</title>"), href, F.lit("<published>2026-09-10T08:00:00Z</published></entry></feed>"))
    return t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, rss).otherwise(atom).alias("body"), F.lit("https://x.example.com/").alias("base_url"))


@query("S9_feed_rows", FEED_SQL)
def s9(t):
    return feeds.feed_rows(feed_bodies(t), ["p_partkey"], tasks=t.tasks).select("p_partkey", "title", "id", "url", F.date_format("published_at", "yyyy-MM-dd").alias("published"))


@query("S10_feed_counts", "select p_partkey, true as valid_xml, 1 as record_count, case when p_size > 10 then 1 else 0 end as usable_rows from part")
def s10(t):
    return feeds.feed_counts(feed_bodies(t), ["p_partkey"], tasks=t.tasks)


# --- one feed shape per query ---------------------------------------------------------------------------

def items(t, adapter, fields, extra=None):
    """Part rows as VARIANT items, joined with the columns of their source."""

    parts = [F.lit("{")]
    for i, (name, value) in enumerate(fields.items()):
        parts += [F.lit(("," if i else "") + json.dumps(name) + ":"), value]
    none = F.array().cast("array<string>")
    return dealt(t.part, t.tasks).select(
        F.try_parse_json(F.concat(*parts, F.lit("}"))).alias("item"), F.lit(adapter).alias("adapter"), F.lit("src").alias("source_id"), F.lower("p_brand").alias("company_id"), F.lit("Acme").alias("company_name"),
        F.lit("A").alias("source_level"), F.lit("https://acme.example.com/campus/").alias("source_url"), F.lit("https://acme.example.com/api/jobs").alias("endpoint"), none.alias("evidence_urls"), F.lit("").alias("note"),
        F.lit(None).cast("string").alias("current_cohort_signal"), none.alias("allowed_job_ids"), none.alias("allowed_title_markers"), none.alias("campus_markers"), F.lit(False).alias("campus_only"),
        F.lit("acme.jobs.feishu.cn").alias("ats_host"), F.lit("campus").alias("website_path"), *(extra or []))


def quoted(value):
    return F.concat(F.lit('"'), value, F.lit('"'))


def key():
    return F.col("p_partkey").cast("string")


def name():
    return F.col("p_name")


SHAPES = {
    "greenhouse": ("P6", lambda: {"id": key(), "title": quoted(name()), "absolute_url": quoted(F.concat(F.lit("/jobs/"), key())), "location": F.lit('{"name":"Gotham"}'), "content": quoted(F.col("p_type")), "updated_at": F.lit('"2020-01-01"'), "published_at": F.lit('"2026-08-20T01:00:00Z"')}),
    "lever": ("P7", lambda: {"id": quoted(key()), "text": quoted(name()), "hostedUrl": quoted(F.concat(F.lit("/jobs/"), key())), "categories": F.lit('{"location":"Gotham"}'), "descriptionPlain": quoted(F.col("p_type")), "createdAt": F.lit("1787187600000")}),
    "workday": ("P8", lambda: {"bulletFields": F.concat(F.lit('["'), key(), F.lit('"]')), "title": quoted(name()), "externalPath": quoted(F.concat(F.lit("/jobs/"), key())), "locationsText": F.lit('"Gotham"'), "description": quoted(F.col("p_type")), "postedOn": F.lit('"2026-08-20"')}),
    "rss": ("P12", lambda: {"id": quoted(key()), "title": quoted(name()), "url": quoted(F.concat(F.lit("/jobs/"), key())), "location": F.lit('["Gotham"]'), "summary": quoted(F.col("p_type")), "publishedAt": F.lit('"2026-08-20"')}),
    "ashby": ("P13", lambda: {"jobPostingId": quoted(key()), "title": quoted(name()), "jobUrl": quoted(F.concat(F.lit("/jobs/"), key())), "location": F.lit('"Gotham"'), "description": quoted(F.col("p_type")), "publishedAt": F.lit('"2026-08-20"'), "isListed": (F.col("p_size") > 10).cast("string")}),
    "workable": ("P14", lambda: {"shortcode": quoted(key()), "title": quoted(name()), "city": F.lit('"Gotham"'), "description": quoted(F.col("p_type")), "published": F.lit('"2026-08-20"')}),
    "smartrecruiters": ("P15", lambda: {"id": quoted(key()), "name": quoted(name()), "ref": quoted(F.concat(F.lit("/jobs/"), key())), "location": F.lit('{"city":"Gotham","name":"x"}'), "jobAd": quoted(F.col("p_type")), "releasedDate": F.lit('"2026-08-20"')}),
    "bamboohr": ("P16", lambda: {"jobId": quoted(key()), "jobName": quoted(name()), "detailUrl": quoted(F.concat(F.lit("/jobs/"), key())), "locations": F.lit('[{"name":"Gotham"}]'), "content": quoted(F.col("p_type")), "datePosted": F.lit('"2026-08-20"')}),
    "beisen": ("P17", lambda: {"jobId": quoted(key()), "jobTitle": quoted(name()), "detailUrl": quoted(F.concat(F.lit("/jobs/"), key())), "cityName": F.lit('"Gotham"'), "jobDescription": quoted(F.col("p_type")), "publishDate": F.lit('"2026-08-20"')}),
    "jsonld": ("P18", lambda: {"identifier": F.concat(F.lit('{"value":"'), key(), F.lit('"}')), "title": quoted(name()), "url": quoted(F.concat(F.lit("/jobs/"), key())), "jobLocation": F.lit('{"address":{"addressLocality":"Gotham"}}'), "description": quoted(F.col("p_type")), "datePosted": F.lit('"2026-08-20"')}),
}


def mapped(df, *more):
    return df.select("source_job_id", "company_id", "title", "city", "description", "apply_url", "publish_date_source", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_date"), "campaign_id", *more)


def shape_sql(adapter):
    base = "'https://acme.example.com/campus/j/'" if adapter == "workable" else "'https://acme.example.com/jobs/'"
    where = "where p_size > 10" if adapter == "ashby" else ""
    return f"""select p_partkey::varchar as source_job_id, lower(p_brand) as company_id, p_name as title, 'Gotham' as city, p_type as description, {base} || p_partkey as apply_url, 'OFFICIAL' as publish_date_source,
      '2026-08-20' as publish_date, lower(p_brand) || ':未知:未知' as campaign_id from part {where}"""


def _register(adapter, code, fields):
    @query(f"{code}_{adapter}_items", shape_sql(adapter))
    def run(t):
        return mapped(records.map_items(items(t, adapter, fields()), [adapter]))


for _adapter, (_code, _fields) in SHAPES.items():
    _register(_adapter, _code, _fields)


@query("P2_P19_generic_items", """
    select p_partkey::varchar as source_job_id, lower(p_brand) as company_id, p_name as title, '未知' as city, p_type as description, 'https://x.example.com/' || p_partkey as apply_url, 'UNKNOWN' as publish_date_source, '2026-08-20' as publish_date,
      'Gotham|N' || p_size as places, 'red,hot' as skills from part""")
def p2(t):
    place = F.concat(F.lit('["Gotham",{"displayName":"N'), F.col("p_size"), F.lit('","cityCode":"X-1"}]'))
    fields = {"jobId": key(), "jobTitle": quoted(name()), "applyUrl": quoted(F.concat(F.lit("https://x.example.com/"), key())), "detail": quoted(F.col("p_type")), "postedAt": F.lit('"2026-08-20"'), "location": place, "tags": F.lit('["red","hot"]')}
    out = records.map_items(items(t, "json", fields), ["json"])
    return mapped(out, F.array_join(F.transform("locations", lambda x: x["display_name"]), "|").alias("places"), F.array_join("skills", ",").alias("skills")).drop("campaign_id")


@query("P3_tencent_items", """
    select p_partkey::varchar as source_job_id, p_name as title, 'https://careers.tencent.com/' || p_partkey as apply_url, p_type || E'\n' || p_brand as description, 'UNKNOWN' as publish_date_source, '' as publish_date from part""")
def p3(t):
    fields = {"PostId": key(), "RecruitPostName": quoted(name()), "PostURL": quoted(F.concat(F.lit("http://careers.tencent.com/"), key())), "Responsibility": quoted(F.col("p_type")), "Requirement": quoted(F.col("p_brand")), "LastUpdateTime": F.lit('"2026-08-20"')}
    return records.map_items(items(t, "tencent", fields), ["tencent"]).select("source_job_id", "title", "apply_url", "description", "publish_date_source", F.coalesce(F.col("publish_date").cast("string"), F.lit("")).alias("publish_date"))


@query("P9_baidu_items", """
    select p_partkey::varchar as source_job_id, p_name || ' 产品' as title, '产品' as role_category, '2027' as cohort, '硕士' as education, 'https://talent.baidu.com/jobs/detail/GRADUATE/' || p_partkey as apply_url, '2027届校园招聘' as campaign_name from part where p_size > 10 and p_type <> 'PROMO'""")
def p9(t):
    fields = {"postId": key(), "name": quoted(F.concat(name(), F.lit(" 产品"))), "workContent": F.lit('"2027届"'), "serviceCondition": F.lit('"硕士"'), "publishDate": F.lit('"2026-08-20"'),
              "recruitType": quoted(F.when(F.col("p_size") > 10, "GRADUATE").otherwise("SOCIAL")), "projectType": quoted(F.when(F.col("p_type") == "PROMO", "实习").otherwise("校招"))}
    return records.map_items(items(t, "baidu", fields), ["baidu"]).select("source_job_id", "title", "role_category", "cohort", "education", "apply_url", "campaign_name")


@query("P10_jd_items", """
    select p_partkey::varchar as source_job_id, p_name as title, '上海、' || p_brand as city, '供应链/采购/物流' as role_category, '2026-08-20' as publish_date from part where p_type <> 'PROMO'""")
def p10(t):
    cities = F.concat(F.lit('[{"workCity":"中国-上海市"},{"workCity":"x-y-'), F.col("p_brand"), F.lit('"},{"workCity":"上海"}]'))
    fields = {"publishId": key(), "positionName": quoted(name()), "jobDirection": quoted(F.when(F.col("p_type") == "PROMO", "社招").otherwise("采销")), "publishTime": F.lit("1787187600000"), "requirementVoList": cities}
    return records.map_items(items(t, "jd", fields), ["jd"]).select("source_job_id", "title", "city", "role_category", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_date"))


@query("P11_feishu_items", """
    select p_partkey::varchar as source_job_id, p_name as title, '上海、北京' as city, '运营' as role_category, 'https://acme.jobs.feishu.cn/campus/position/' || p_partkey || '/detail' as apply_url, '2026-08-20' as publish_date from part where p_size <= 25 or p_type = 'PROMO'""")
def p11(t):
    kind = F.when(F.col("p_type") == "PROMO", '{"id":"9","name":"校招","parent":{"id":"2"}}').when(F.col("p_size") <= 25, '{"id":"201","name":"校招"}').otherwise('{"id":"101","name":"其他"}')
    fields = {"id": key(), "title": quoted(name()), "city_list": F.lit('[{"name":"上海"},{"name":""},{"name":"北京"}]'), "job_function": F.lit('{"name":"运营"}'), "recruit_type": kind, "publish_time": F.lit("1787187600000")}
    return records.map_items(items(t, "feishu", fields), ["feishu"]).select("source_job_id", "title", "city", "role_category", "apply_url", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_date"))


@query("P4_P5_context_fields", """
    select p_partkey::varchar as source_job_id, '2027' as cohort, '秋招正式批' as batch, '本科' as education, p_brand || '|R2' as requirements, lower(p_brand) || ':2027:秋招正式批' as campaign_id, '2027届秋招正式批' as campaign_name from part where p_size <= 40""")
def p4(t):
    fields = {"id": key(), "title": quoted(name()), "url": quoted(F.concat(F.lit("https://x.example.com/"), key())), "categories": F.lit('{"a":"2027届","b":"秋招"}'), "bulletFields": F.lit('["本科"]'), "description": quoted(F.when(F.col("p_size") > 40, "experienced hire").otherwise("")),
              "requirements": F.concat(F.lit('["'), F.col("p_brand"), F.lit('"," ","R2 "]'))}
    out = records.map_items(items(t, "feed", fields), ["feed"])
    return out.select("source_job_id", "cohort", "batch", "education", F.array_join("requirements", "|").alias("requirements"), "campaign_id", "campaign_name")


@query("G1_G2_G3_adapter_routing", """
    select case when p_size <= 15 then 'greenhouse' when p_size <= 30 then 'lever' else 'own' end as adapter, count(*) as rows from part group by 1""")
def g1(t):
    k = F.col("p_size")
    fields = {"id": key(), "title": quoted(name()), "text": quoted(name()), "url": quoted(F.concat(F.lit("https://x.example.com/"), key()))}
    rows = items(t, "x", fields, [k.alias("size")]).withColumn("adapter", F.when(F.col("size") <= 15, "Greenhouse").when(F.col("size") <= 30, "lever").otherwise("own"))
    rows = rows.withColumn("source_id", F.lower("adapter"))
    out = records.map_items(rows, ["greenhouse", "lever"], custom={"own": records.map_generic})
    return out.groupBy(F.col("source_id").alias("adapter")).agg(F.count("*").alias("rows"))


@query("P1_split_rejects", "select coalesce(case when p_size <= 10 then 'missing_apply_url' when p_type = 'PROMO' then 'missing_title' end, 'valid') as state, count(*) as rows from part group by 1")
def p1_rejects(t):
    rows = t.part.select(F.when(F.col("p_size") > 10, F.lit("https://x.example.com/")).alias("apply_url"), F.when(F.col("p_type") != "PROMO", F.col("p_name")).alias("title"))
    good, bad = records.split_rejects(rows)
    return good.select(F.lit("valid").alias("state")).unionByName(bad.select(F.col("reject_reason").alias("state"))).groupBy("state").agg(F.count("*").alias("rows"))


@query("P20_S16_inbox", """
    with r as (select c_custkey, c_name, c_mktsegment, c_custkey % 1000 as id, row_number() over (partition by c_custkey % 1000 order by c_custkey) as rn from customer where c_acctbal > 0 and c_nationkey % 6 <> 0)
    select id::varchar as id, c_name as title, c_mktsegment as company_name, '未知' as city, 'https://x.example.com/' || c_custkey as apply_url, 'https://x.example.com/' || c_custkey as source_url from r where rn = 1""")
def p20(t):
    k = F.col("c_custkey")
    rows = t.customer.select((k % 1000).cast("string").alias("id"), F.col("c_name").alias("jobTitle"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("company"), F.lit("secret").alias("cookie"), F.lit("<p>").alias("html"), k.alias("seq"),
                             F.concat(F.when(F.col("c_nationkey") % 6 == 0, "http").otherwise("https"), F.lit("://x.example.com/"), k).alias("applyUrl"))
    out = registry.load_inbox(rows, F.lit("2026-09-01 00:00:00").cast("timestamp"))
    return out.select("id", "title", "company_name", "city", "apply_url", "source_url")


@query("S17_U1_inbox_upsert", """
    select coalesce(b.id, a.id) as id, coalesce(b.title, a.title) as title from (select c_custkey as id, c_name as title from customer where c_custkey < 1000) a full join (select c_custkey as id, c_mktsegment as title from customer where c_custkey >= 900) b using (id)""")
def s17(t):
    at = F.lit("2026-09-01 00:00:00").cast("timestamp").alias("imported_at")
    old = t.customer.filter("c_custkey < 1000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), at)
    new = t.customer.filter("c_custkey >= 900").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("title"), at)
    return registry.upsert_inbox(old, new).select("id", "title")


@query("P30_inbox_postings", """
    select 'local-' || substr(sha256(lower(c_name)), 1, 12) || '-inbox' as source_id, c_custkey::varchar as source_job_id, 'x.example.com' as apply_domain from customer""")
def p30(t):
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("company_name"), F.lit("t").alias("title"), F.lit("c").alias("city"), F.lit("").alias("description"), F.array().cast("array<string>").alias("requirements"),
                             F.lit("https://x.example.com/a").alias("apply_url"), F.lit("https://x.example.com/").alias("source_url"))
    return registry.inbox_postings(rows).select("source_id", "source_job_id", "apply_domain")


@query("P21_sanitize_leads", "select c_custkey::varchar as id, c_name as title, c_mktsegment as companyName from customer where c_nationkey % 5 <> 0 and c_acctbal > 0")
def p21(t):
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("id"), "c_name", F.col("c_mktsegment").alias("companyName"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise(F.lit(" ")).alias("title"), F.lit("https://p.example.com/").alias("sourceUrl"),
                             F.when(F.col("c_nationkey") % 5 == 0, "elsewhere").otherwise("xiaohongshu").alias("sourcePlatform"), F.lit("CODE").alias("referralCode"))
    return registry.sanitize_leads(rows).select("id", "title", "companyName")


@query("P22_sanitize_observations", """
    select c_custkey::varchar as company_id, substr(trim(c_name), 1, 200) as company_name, case when c_custkey % 4 = 0 then 'ACTIVE_LEAD' else '' end as directory_status, case when c_custkey % 600 between 100 and 599 then c_custkey % 600 else -1 end as status_code, 'A,B' as signals,
      case when c_nationkey % 2 = 0 then 'https://x.example.com/' else '' end as career_url from customer""")
def p22(t):
    k = F.col("c_custkey")
    rows = t.customer.select(k.cast("string").alias("company_id"), F.concat(F.lit("  "), "c_name").alias("company_name"), F.when(k % 4 == 0, "ACTIVE_LEAD").otherwise("HACKED").alias("directory_status"), (k % 600).cast("string").alias("status_code"),
                             F.array(F.lit(" A "), F.lit("B"), F.lit("A"), F.lit("")).alias("signals"), F.when(F.col("c_nationkey") % 2 == 0, "https://x.example.com/").otherwise("javascript:x").alias("career_url"), F.lit("<html>").alias("html"))
    out = registry.sanitize_observations(rows)
    return out.select("company_id", "company_name", F.coalesce("directory_status", F.lit("")).alias("directory_status"), F.coalesce("status_code", F.lit(-1)).alias("status_code"), F.array_join("signals", ",").alias("signals"), F.coalesce("career_url", F.lit("")).alias("career_url"))


@query("P23_rename_fields", "select p_partkey as pPartkey, p_name as pName, p_brand || p_type as nestedValue from part")
def p23(t):
    rows = t.part.select("p_partkey", "p_name", F.struct(F.array(F.struct(F.concat("p_brand", "p_type").alias("inner_value"))).alias("deep_list")).alias("outer_struct"))
    out = registry.rename_fields(rows, "camel")
    return out.select("pPartkey", "pName", F.col("outerStruct.deepList")[0]["innerValue"].alias("nestedValue"))


def sheet(t):
    """Supplier rows in the fixed workbook layout; the header names one moved column."""

    k = F.col("s_suppkey")
    body = t.supplier.select((k + 4).alias("row_no"), F.concat(F.lit("SZ:"), k).alias("A"), F.col("s_name").alias("B"), F.lit("2024-06-30").alias("C"), F.when(k % 3 == 0, "国企").when(k % 3 == 1, "国企；民企").otherwise("民企").alias("D"), F.lit("正常上市").alias("E"),
                             F.col("s_name").alias("H"), F.when(k % 4 == 0, "a.example.com;b.example.com").when(k % 4 == 1, "").otherwise("www.example.com").alias("I"), F.lit("trade").alias("J"), F.lit("").alias("K"))
    head = t.region.filter("r_regionkey < 3").select((F.col("r_regionkey") + 1).cast("bigint").alias("row_no"), *[F.lit(n).alias(c) for c, n in zip("ABCDEHIJK", ["证券代码", "证券简称", "截止日期", "股权性质", "上市状态", "中文全称", "公司网址", "主营业务", "x"])])
    return head.unionByName(body)


@query("S18_workbook_rows", """
    select s_suppkey + 4 as row_no, lpad(s_suppkey::varchar, 6, '0') as stock_code, s_name as short_name, '2024-06-30' as as_of, '正常上市' as listing_state from supplier""")
def s18(t):
    return registry.workbook_rows(sheet(t)).select("row_no", "stock_code", "short_name", F.date_format("equity_as_of", "yyyy-MM-dd").alias("as_of"), "listing_state")


@query("P32_F21_workbook_candidates", """
    select s_suppkey + 4 as row_no, case s_suppkey % 3 when 0 then 'candidate' else 'review' end as kind, case when s_suppkey % 3 = 1 then 'mixed_equity_nature_manual_review' else case s_suppkey % 4 when 0 then 'homepage_multiple_addresses' when 1 then 'homepage_missing' else '' end end as reasons from supplier where s_suppkey % 3 <> 2""")
def p32(t):
    good, review = registry.workbook_candidates(registry.workbook_rows(sheet(t)))
    return good.select("row_no", F.lit("candidate").alias("kind"), F.array_join("review_reasons", ",").alias("reasons")).unionByName(review.select("row_no", F.lit("review").alias("kind"), F.col("reason").alias("reasons")))


@query("A13_merge_summary", """
    select count(*) as state_owned_count, count(*) filter (where s_suppkey % 4 <> 1) as website_count, count(*) filter (where s_suppkey % 4 <> 1) as valid_website_count, count(*) filter (where s_suppkey % 4 = 1) as missing_website_count,
      count(*) as normal_listing_count, count(*) filter (where s_suppkey % 4 = 0) as website_anomaly_count, count(*) filter (where s_suppkey % 5 = 0) as matched_registry_count, count(*) filter (where s_suppkey % 5 = 1) as identity_conflict_count from supplier where s_suppkey % 3 = 0""")
def a13(t):
    from gleanery.operators.resolve import merge_summary

    good, _ = registry.workbook_candidates(registry.workbook_rows(sheet(t)))
    k = F.col("row_no") - 4
    rows = good.withColumns({"matched_company_id": F.when(k % 5 == 0, k), "match_method": F.when(k % 5 == 1, "CONFLICT")})
    return merge_summary(rows).drop("first_equity_date", "last_equity_date")


@query("S19_two_column_list", """
    select 'sasac-central-' || lpad((n_nationkey + 1)::varchar, 3, '0') as group_id, n_nationkey + 1 as rank, n_name as name, case when n_regionkey = 0 then '' else 'http://www.n' || n_nationkey || '.example.com/' end as homepage from nation""")
def s19(t):
    half = t.nation.select("n_nationkey", "n_name", F.concat(F.lit("No "), F.col("n_nationkey") + 1).alias("rank"), F.when(F.col("n_regionkey") == 0, "http://wap.sasac.gov.cn/list").otherwise(F.concat(F.lit("http://www.n"), "n_nationkey", F.lit(".example.com/"))).alias("link"))
    left = half.filter("n_nationkey < 13").select(F.col("n_nationkey").alias("row"), F.col("rank").alias("rank_left"), F.col("n_name").alias("name_left"), F.col("link").alias("link_left"))
    right = half.filter("n_nationkey >= 13").select((F.col("n_nationkey") - 13).alias("row"), F.col("rank").alias("rank_right"), F.col("n_name").alias("name_right"), F.col("link").alias("link_right"))
    out = registry.two_column_list(left.join(right, "row", "left"), ["row"], "http://www.sasac.gov.cn/x.html", ["www.sasac.gov.cn", "sasac.gov.cn", "wap.sasac.gov.cn"])
    return out.select("group_id", "rank", "name", F.coalesce("homepage", F.lit("")).alias("homepage"))


@query("S20_newer_if_valid", """
    with good as (select count(*) = 25 and count(distinct n_nationkey) = 25 and min(n_nationkey) = 0 and max(n_nationkey) = 24 and count(distinct n_name) = 25 as ok from nation),
    bad as (select count(*) = 25 and count(distinct c_nationkey) = 25 and count(distinct c_name) = 25 as ok from customer)
    select n_nationkey as id, 'nation' as origin from nation, good where ok union all select r_regionkey, 'region' from region, good where not ok
    union all select c_custkey, 'customer' from customer, bad where ok union all select s_suppkey, 'supplier' from supplier, bad where not ok""")
def s20(t):
    from gleanery.operators.gates import dense_rank_check, newer_if_valid

    def chosen(new, key, previous, previous_key, rank, name):
        ids = lambda table, c: getattr(t, table).select(F.col(c).cast("bigint").alias("id"), F.lit(table).alias("origin"))
        check = dense_rank_check(getattr(t, new).withColumn("rank", F.col(rank) + 1), "rank", 25, F.col(name))
        return newer_if_valid(ids(new, key), ids(previous, previous_key), check)

    ranked = chosen("nation", "n_nationkey", "region", "r_regionkey", "n_nationkey", "n_name")
    return ranked.unionByName(chosen("customer", "c_custkey", "supplier", "s_suppkey", "c_nationkey", "c_name"))


@query("S26_P24_list_rows", """
    select p_partkey::varchar as p_partkey, p_name, coalesce(case when p_size > 20 then p_brand end, '-') as p_brand, coalesce(case when p_size > 10 then 1 end, 0) as tagged from part""")
def s26(t):
    from gleanery.operators.reports import list_projection

    rows = t.part.select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", F.when(F.col("p_size") > 20, F.col("p_brand")).otherwise(F.lit("")).alias("p_brand"), F.when(F.col("p_size") > 10, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.lit("long").alias("description"))
    return list_projection(rows).select("p_partkey", "p_name", F.coalesce("p_brand", F.lit("-")).alias("p_brand"), F.when(F.col("tags").isNotNull(), 1).otherwise(0).alias("tagged"))


@query("S23_version_stamp", """
    with v as (select strftime(max(ts), '%Y.%m.%d.%H%M') as catalog_version from events)
    select 'customer' as product, c_custkey as id, catalog_version from customer, v union all select 'supplier', s_suppkey, catalog_version from supplier, v""")
def s23(t):
    version = t.events.agg(dates.catalog_version(F.max("ts")).alias("v")).first()["v"]  # one row: the newest event names the version
    rows = t.customer.select(F.lit("customer").alias("product"), F.col("c_custkey").alias("id")).unionByName(t.supplier.select(F.lit("supplier").alias("product"), F.col("s_suppkey").alias("id")))
    return sinks.stamped(rows, version)


@query("X22_apply_links", r"""
    select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/en/p' || page_id || '.html' as resolved from pages""")
def x22_links(t):
    base = F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.lit("/jobs/"), "page_id", F.lit(".html?from="), F.length("html"))
    return t.pages.select("page_id", urls.absolute_url(F.concat(F.lit("../en/p"), "page_id", F.lit(".html")), base).alias("resolved"))
