"""Pages, feeds, payload shapes and sanitizers."""

import json

from pyspark.sql import functions as F

from gleanery.operators import pages
from gleanery.sources import envelopes, feeds, records, registry, sinks


def page(spark, html, url="https://acme.example.com/careers"):
    return pages.parse_pages(spark.createDataFrame([(1, url, html)], "page_id int, url string, html string"))


def analysis(spark, html, url="https://acme.example.com/careers"):
    return pages.analyse_pages(page(spark, html, url), ["page_id"]).first()


def test_visible_text_hides_scripts(spark):
    row = page(spark, "<title>T</title><meta name=description content='D'><p>a<script>var x='</p>'</script> b</p><svg>no</svg>").select(pages.visible_text().alias("t"), "page.title").first()
    assert row["t"].split() == ["T", "D", "T", "a", "b"] and row["title"] == "T"


def test_vendor_and_structured_rows(spark):
    got = analysis(spark, "<a href='https://jobs.ashbyhq.com/acme'>jobs</a><script type='application/ld+json'>{\"@type\":\"JobPosting\",\"title\":\"x\"}</script>")
    assert got["detected_ats"] == "ASHBY" and got["structured_job_count"] == 1 and got["endpoints"] == ["https://api.ashbyhq.com/posting-api/job-board/acme"]
    host = analysis(spark, "<p>x</p>", "https://acme.wd1.myworkdayjobs.com/en-US/Acme_Careers")
    assert (host["detected_ats"], host["confidence"]) == ("WORKDAY", "HIGH") and host["endpoints"] == ["https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/Acme_Careers/jobs"]


def test_triage(spark):
    assert analysis(spark, "<p>请完成验证</p>")["classification"] == "PUBLIC_ACCESS_UNAVAILABLE"
    assert analysis(spark, "<p>plain</p>")["classification"] == "MANUAL_IMPORT_ONLY"
    assert analysis(spark, "<table><tr><td>x</td></tr></table>")["classification"] == "CONNECTOR_CANDIDATE"


def test_table_rows_skip_navigation(spark):
    html = "<table><tr><th>岗位</th></tr><tr><td>产品经理</td><td>上海</td></tr><tr><td>首页</td><td>x</td></tr><tr><td>财务助理</td><td>具备经验</td></tr></table>"
    got = pages.table_jobs(page(spark, html), ["page_id"]).orderBy("row_no").collect()
    assert [(r["title"], r["location"], r["apply_url"]) for r in got] == [("产品经理", "上海", "https://acme.example.com/careers"), ("财务助理", "未知", "https://acme.example.com/careers")]


def test_directory_table(spark):
    html = "<table><tr><th>证券代码</th><th>证券简称</th></tr><tr><td>000001</td><td>平安银行</td></tr><tr><td>600000</td><td>浦发银行</td></tr></table>"
    got = pages.directory_companies(page(spark, html), [], "page_id").orderBy("row_no").collect()
    assert [(r["name"], r["stock_code"]) for r in got] == [("平安银行", "000001"), ("浦发银行", "600000")]


def test_feed_rows_and_schema_change(spark):
    ok = "<rss><channel><item><guid>1</guid><title>校园运营</title><link>/jobs/1</link><pubDate>Thu, 10 Sep 2026 08:00:00 GMT</pubDate></item></channel></rss>"
    bad = "<rss><channel><item><description>x</description></item></channel></rss>"
    df = spark.createDataFrame([("a", ok, "https://x.com/f"), ("b", bad, ""), ("c", "not xml", "")], "source_id string, body string, base_url string")
    row = feeds.feed_rows(df, ["source_id"]).collect()
    assert [(r["id"], r["url"], str(r["published_at"])) for r in row] == [("1", "https://x.com/jobs/1", "2026-09-10")]
    counts = {r["source_id"]: (r["valid_xml"], r["record_count"], r["usable_rows"]) for r in feeds.feed_counts(df, ["source_id"]).collect()}
    assert counts == {"a": (True, 1, 1), "b": (True, 1, 0), "c": (False, 0, 0)}


SOURCE = {"source_id": "s", "company_id": "acme", "company_name": "Acme", "source_level": "A", "source_url": "https://acme.example.com/campus", "endpoint": None, "note": "", "current_cohort_signal": None,
          "campus_only": True, "ats_host": None, "website_path": "campus"}


def items(spark, adapter, rows):
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "body string").select(F.try_parse_json("body").alias("item"), F.lit(adapter).alias("adapter"), *[F.lit(v).cast("boolean" if isinstance(v, bool) else "string").alias(k) for k, v in SOURCE.items()])
    lists = ["evidence_urls", "allowed_job_ids", "allowed_title_markers", "campus_markers"]
    return records.map_items(df.select("*", *[F.array().cast("array<string>").alias(c) for c in lists]), [adapter]).collect()


def test_own_portals(spark):
    baidu = [{"postId": "1", "name": "运营", "recruitType": "GRADUATE", "projectType": "校招", "publishDate": "2026-08-01"}, {"postId": "2", "name": "社招运营", "recruitType": "SOCIAL"}]
    assert [r["source_job_id"] for r in items(spark, "baidu", baidu)] == ["1"]
    jd = items(spark, "jd", [{"publishId": 9, "positionName": "采销", "requirementVoList": [{"workCity": "中国-北京-北京市"}, {"workCity": "上海市"}, {"workCity": "北京"}]}])
    assert jd[0]["city"] == "北京、上海" and jd[0]["apply_url"].endswith("publishId=9")
    tencent = items(spark, "tencent", [{"PostId": 3, "RecruitPostName": "x", "PostURL": "http://careers.tencent.com/3", "LastUpdateTime": "2026-01-01"}])[0]
    assert tencent["apply_url"] == "https://careers.tencent.com/3" and tencent["publish_date"] is None
    feishu = items(spark, "feishu", [{"id": "7", "title": "产品", "city_list": [{"name": "上海"}], "publish_time": 1789000000000, "recruit_type": {"id": "201", "name": "校招"}}, {"id": "8", "title": "x", "recruit_type": {"id": "101"}}])
    assert [(r["source_job_id"], r["city"]) for r in feishu] == [("7", "上海")]


def test_envelopes(spark):
    bodies = [{"data": {"list": [1, 2]}}, {"d": {"results": [1]}}, [1, 2, 3], {"a": {"b": {"c": {"list": [1]}}}}, {"data": {"result": {"items": [5]}}}]
    df = spark.createDataFrame([(json.dumps(b),) for b in bodies], "b string")
    got = [r["n"] for r in df.select(F.coalesce(F.size(envelopes.row_list(F.try_parse_json("b"))), F.lit(-1)).alias("n")).collect()]
    assert got == [2, 1, 3, -1, 1]


def test_sanitizers_drop_private_fields(spark):
    rows = spark.createDataFrame([("1", "t", "c", "https://x.com/1", "secret", 1), ("2", "t", "c", "http://x.com/1", "secret", 2)], "id string, title string, companyName string, applyUrl string, cookie string, seq int")
    got = registry.load_inbox(rows, F.current_timestamp())
    assert "cookie" not in got.columns and [r["id"] for r in got.collect()] == ["1"]


def test_json_snapshot_and_round_trips(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"sourceId": "a", "pageSize": 5}, {"source_id": "b"}]', encoding="utf-8")
    got = registry.read_registry(spark, str(tmp_path / "a.json"), "source_id string, page_size int").orderBy("source_id").collect()
    assert [tuple(r) for r in got] == [("a", 5), ("b", None)]
    (tmp_path / "r.json").write_text('{"id": 1}\n{"id": "x"}\n{broken\n', encoding="utf-8")
    good, bad = registry.read_json_rows(spark, str(tmp_path / "r.json"), "id int", multi_line=False)
    assert good.count() == 1 and bad.count() == 2
    assert registry.read_observations(spark, str(tmp_path / "none"), "company_id string") is None
    assert registry.read_state(spark, str(tmp_path / "none"), "id string").count() == 0
    df = spark.createDataFrame([("=HYPERLINK(1)", '上海,"北京"')], "a string, b string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    text = next(f for f in (tmp_path / "csv").glob("part-*") if b"HYPERLINK" in f.read_bytes()).read_bytes().decode("utf-8")
    assert text.startswith('\ufeff"a","b"\r\n')
    assert "\"'=HYPERLINK(1)\"" in text and '""北京""' in text
    sinks.write_backup({"states": df}, str(tmp_path / "backup"))
    assert sinks.read_backup(spark, str(tmp_path / "backup"), {"states": "a string, b string"}, {"states": ["a"]})["states"].count() == 1


def test_unclosed_tags_end_where_they_must_and_cost_linear_time():
    import time

    from gleanery.operators.pages import _read_page

    row = _read_page("<table><tr><td>a<td>b<tr><td>c</table>")["rows"]
    assert [r["cells"] for r in row] == [["a", "b"], ["c"]]
    start = time.process_time()
    page = _read_page("<p>word " * 40_000 + "<b>" * 40_000 + "<li><a href='x'>t" * 2_000)
    assert time.process_time() - start < 6 and page["text"].startswith("word word") and len(page["links"]) == 2_000


def test_scale_joins_agree(spark):
    import pytest

    from gleanery.scale import lookup_join

    facts = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(30)], "k int, v int")
    lookup = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        both = [sorted(map(str, lookup_join(facts, lookup, "k", how, max_rows=n).collect())) for n in (10, 1)]
        assert both[0] == both[1]
    with pytest.raises(ValueError):
        lookup_join(facts, lookup, "k", "full_outer")
