"""Decision tables for text, place, date, identity and gate rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanery.functions import dates, ids, locations, rules, text, urls
from gleanery.functions.audience import assess

POSTING = "n int, title string, role_category string, requirements array<string>, description string, major_tags array<string>"
TARGET, OUT, REVIEW = "TARGET_GENERALIST", "OUT_OF_SCOPE", "NEEDS_REVIEW"
TITLES = {"general": ["品牌推广岗", "税务助理", "Sales Associate"], "vague": ["储备干部", "轮岗生"], "blocked": ["嵌入式助理", "律师助理", "护士长助理"]}
DEMANDS = {
    "none": [], "free": ["专业不限"], "soft": ["土木工程优先"], "hard": ["须为土木工程专业"], "good": ["历史或哲学专业"], "mixed": ["土木工程或历史专业"], "folio": ["须提交作品集"],
}


def expected(title_kind, category, demand):
    if title_kind == "blocked" or category == "设计" or demand in ("hard", "folio"):
        return OUT
    if demand in ("free", "good", "mixed") or title_kind == "general":
        return TARGET
    return REVIEW


AUDIENCE = [
    (title, category, DEMANDS[demand], "", [], expected(kind, category, demand))
    for kind, titles in TITLES.items() for title in titles for category in ("其他", "设计") for demand in DEMANDS
]


def test_audience_gate(spark):
    rows = [(i, t, c, r, d, g) for i, (t, c, r, d, g, _) in enumerate(AUDIENCE)]
    got = {r["n"]: r["decision"] for r in assess(spark.createDataFrame(rows, POSTING)).select("n", "audience.decision").collect()}
    wrong = [(AUDIENCE[i], got[i]) for i in range(len(AUDIENCE)) if got[i] != AUDIENCE[i][-1]]
    assert not wrong


def one(spark, column, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column(F.col("v")).alias("x")).first()["x"]


YEARS = range(2025, 2029)


@pytest.mark.parametrize(("words", "year"), [
    *[(f"{y}届春招-仓储管理", str(y)) for y in YEARS], *[(f"{y % 100}届提前批", str(y)) for y in YEARS], *[(f"成立于{y}年，欢迎加入", "未知") for y in YEARS]])
def test_cohort(spark, words, year):
    assert one(spark, rules.cohort, words) == year


@pytest.mark.parametrize(("label", "category"), [("战略与投资", "金融/投研"), ("销售、服务与支持", "销售/商务"), ("未知的岗位族", "其他"), ("运营", "运营")])
def test_role_category(spark, label, category):
    assert one(spark, rules.role_category, label) == category


def test_standalone_ai(spark):
    assert one(spark, rules.feed_role_category, "AI 产品") == "算法/AI"
    assert one(spark, rules.feed_role_category, "maintain 运营") == "运营"


def test_text_cleaning(spark):
    assert one(spark, text.clean_text, "<p>hello</p><script>bad()</script>  world") == "hello world"
    assert one(spark, text.clean_text, "a &amp; b　c") == "a & b c"
    loose = {"Head of R&D": "Head of R&D", "AT&T": "AT&T", "Tom &Jerry": "Tom &Jerry", "a<b> R&D": "a R&D", "x < y": "x < y", "<a title='1 > 0'>t</a>": "t", "p<!-- n -->q": "pq", "cut <i": "cut <i"}
    assert {k: one(spark, text.clean_text, k) for k in loose} == loose
    assert one(spark, text.normalize_city, "AT&T") == "AT&T"
    assert one(spark, lambda v: text.clean_text(F.repeat(v, F.lit(3000))), "<b>long ") == " ".join(["long"] * 3000)
    assert one(spark, text.clean_list, ["数据分析", " 数据分析 ", "", "<b>x</b>"], "v array<string>") == ["数据分析", "x"]
    assert one(spark, text.name_key, "  腾讯（00700.HK） ") == "腾讯00700hk"
    assert one(spark, text.name_key, "ＡＢＣ①ß") == "abc1ss"


@pytest.mark.parametrize(("value", "code"), [
    *[(shape.format(n), f"{n:06d}") for n in (7, 4321, 688981) for shape in ("{}", "{}.0", "SZSE:{}")], ("2.25", None), (str(10**7), None)])
def test_stock_code(spark, value, code):
    assert one(spark, urls.stock_code, value) == code


@pytest.mark.parametrize(("host", "ok"), [("hr.shop.test", True), ("shop.test", True), ("shop.test.other.test", False), ("myshop.test", False)])
def test_domain_match(spark, host, ok):
    assert one(spark, lambda v: urls.host_under_any(v, F.array(F.lit("*.shop.test"))), host) is ok


@pytest.mark.parametrize(("host", "domain"), [("x.y.shop.test", "shop.test"), ("p.q.net.cn", "q.net.cn"), ("intranet", "intranet")])
def test_traffic_domain(spark, host, domain):
    assert one(spark, urls.traffic_domain, host) == domain


def test_urls(spark):
    assert one(spark, urls.https_url, "https://u:p@example.com/") is None
    assert one(spark, urls.safe_url, "javascript:alert(1)") is None
    far = "https://example.com/" + "a" * 2100
    assert one(spark, urls.safe_url, far) is None and one(spark, urls.https_url, far) is None and one(spark, urls.page_url, far) is None
    assert one(spark, urls.url_problem, far) == "too_long" and one(spark, urls.url_problem, "https://example.com/") is None
    assert one(spark, urls.page_url, "https://example.com/a#b") == "https://example.com/a"
    assert one(spark, lambda v: urls.absolute_url(v, F.lit("https://x.com/a/b?c")), "d/../e") == "https://x.com/a/e"
    assert one(spark, lambda v: urls.absolute_url(v, F.lit("https://x.com/a/b")), "//y.com/z") == "https://y.com/z"


def test_dates(spark):
    day = dt.date(2026, 9, 10)
    assert one(spark, dates.feed_date, "Thu, 10 Sep 2026 08:00:00 GMT") == day
    assert one(spark, dates.feed_date, "Fri, 11 Sep 2026 02:00:00 +0800") == day
    assert one(spark, dates.prefix_date, "2026-09-10T00:00:00Z") == day
    assert one(spark, dates.prefix_date, "2026-13-40") is None
    assert one(spark, dates.date_in_text, "截至2026年9月10日") == day
    assert one(spark, dates.epoch_date, "1789000000000") == one(spark, dates.epoch_date, "1789000000")


def test_locations(spark):
    got = one(spark, locations.parse_locations, "北京、武汉市 / 上海")
    assert [x["display_name"] for x in got] == ["北京", "武汉", "上海"]
    assert one(spark, locations.split_cities, "北京、武汉市 / 上海") == ["北京", "武汉", "上海"]
    abroad = one(spark, locations.parse_locations, "日本;remote;台湾;浦东新区;广西;Gotham")
    assert [(x["scope"], x["country_code"], x["display_name"]) for x in abroad] == [
        ("OVERSEAS", "JP", "日本 · 日本"), ("REMOTE", None, "远程"), ("HONG_KONG_MACAU_TAIWAN", "TW", "台湾"), ("MAINLAND_CHINA", "CN", "上海 · 浦东新区"),
        ("MAINLAND_CHINA", "CN", "广西"), ("UNKNOWN", None, "Gotham")]


def test_given_locations_are_completed(spark):
    rows = spark.createDataFrame([([("UNKNOWN", None, None, None, None, "武汉", "武汉"), ("OVERSEAS", None, None, None, None, "东京", "东京")],)], f"v array<{locations.LOCATION_TYPE}>")
    got = rows.select(locations.complete_locations("v").alias("x")).first()["x"]
    assert [(x["scope"], x["country_code"], x["city_code"]) for x in got] == [("MAINLAND_CHINA", "CN", "HB-武汉"), ("OVERSEAS", "JP", None)]


@pytest.mark.parametrize(("flag", "title", "body", "ok"), [
    (False, "校园产品", "校招", False), (True, "社会招聘高级工程师", "", False), (True, "校园产品实习生", "experienced", True), (None, "招聘经理", "负责招聘策略", False), (None, "管培生", "2027届", True)])
def test_scope_gate(spark, flag, title, body, ok):
    rows = spark.createDataFrame([(flag, title, body)], "f boolean, t string, b string")
    assert rows.select(rules.in_scope(F.col("f"), F.col("t"), F.concat_ws(" ", "t", "b")).alias("x")).first()["x"] is ok


def test_job_ids(spark):
    rows = spark.createDataFrame([("c", " 1 ", "t", "武汉市", "2027", "https://x/"), ("c", None, "t", "武汉市", "2027", "https://x/")], "company_id string, source_job_id string, title string, city string, cohort string, apply_url string")
    got = [r["x"] for r in rows.select(ids.stable_job_id().alias("x")).collect()]
    assert got[0] == "c:1" and len(got[1]) == 2 + 16
