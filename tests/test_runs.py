"""Whole runs, streams against batch, and the driver contract."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.operators import reports, snapshots
from gleanery.plans.catalog import build_catalog
from gleanery.streaming import state
from gleanery.workload import load_all

NOW = datetime(2026, 9, 2, 4, 0)
LOCATION = "array<struct<scope:string,country_code:string,province_code:string,city_code:string,district_code:string,display_name:string,raw:string>>"
RAW = f"""source_id string, source_job_id string, company_id string, company_name string, title string, city string, locations {LOCATION}, role_category string, company_industry string, company_type string, company_scale string,
  cohort string, batch string, education string, major_tags array<string>, skills array<string>, description string, requirements array<string>, publish_date date, publish_date_source string, deadline date, apply_url string, source_url string,
  source_name string, source_level string, source_evidence array<string>, is_campus boolean, campaign_id string, campaign_name string, campaign_open_date date, campaign_deadline date, campaign_official_url string"""
SOURCES = """source_id string, company_id string, company_name string, source_url string, apply_domain string, apply_domains array<string>, ats_host string, source_level string, status string, adapter string, access_mode string, verified_at date,
  robots_reviewed_at date, terms_reviewed_at date, evidence struct<conclusion:string,sampled_jobs:int,required_field_completeness:double,invalid_row_ratio:double,duplicate_ratio:double,anomalous_drop:boolean>"""
LOG = "source_id string, complete boolean, not_modified boolean, health string, reason string, raw_count bigint, fetched_at timestamp"


def raw(key, title, tags=(), campus=True, url="https://jobs.example.com/", requirements=(), category="运营"):
    return ("s", key, "demo", "演示", title, "武汉市", None, category, "未知", "未知", "未知", "2027", "秋招正式批", "本科", list(tags), [], "<p>参与运营<script>alert(1)</script></p>", list(requirements), None, "UNKNOWN", None,
            url + key, "https://jobs.example.com/campus", "x", "A", [], campus, "demo:2027", "2027届秋招", None, None, None)


def run(spark, rows, previous=None, counts=None, complete=True, not_modified=False, minimum=0, now=NOW):
    sources = spark.createDataFrame([("s", "demo", "演示", "https://jobs.example.com/campus", "example.com", [], None, "A", "VERIFIED", "json", "JSON", None, None, None, None)], SOURCES)
    log = spark.createDataFrame([("s", complete, not_modified, "not_modified" if not_modified else "healthy" if complete else "error", None, 0, now)], LOG)
    return build_catalog(spark.createDataFrame(rows, RAW), sources, log, now, previous, counts, minimum_verified=minimum)


@pytest.fixture(scope="module")
def first(spark):
    return run(spark, [raw("1", "运营策划", ["不限专业"]), raw("2", "营销实习生", ["市场营销"]), raw("3", "高级工程师", campus=False), raw("4", "软件工程师"), raw("5", "运营", url="https://evil.test/"), raw("1", "运营策划", ["不限专业"])])


def test_first_run(first):
    jobs = {r["id"]: r for r in first.jobs.collect()}
    assert set(jobs) == {"demo:1", "demo:2"} and jobs["demo:1"]["city"] == "武汉" and "alert" not in jobs["demo:1"]["description"]
    assert sorted(r["reject_reason"].split(":")[0] for r in first.rejects.collect()) == ["social_or_unverified_job", "unverified_apply_domain"]
    overall = {r["audience_decision"]: r["rows"] for r in first.decisions.filter("level = 2").collect()}
    assert overall == {"TARGET_GENERALIST": 3, "OUT_OF_SCOPE": 1}
    m = first.manifest.first()
    assert (m["total_jobs"], m["active_jobs"], m["verified_source_count"], m["catalog_version"]) == (2, 2, 1, "2026.09.02.0400")
    assert [(r["job_count"], r["status"]) for r in first.campaigns.collect()] == [(2, "OPEN")]
    assert first.counts_state.first()["count_history"] == [3]  # observed before the audience gate


def test_next_runs(spark, first):
    later = NOW + timedelta(hours=5)
    kept = run(spark, [], first.jobs, first.counts_state, complete=False, now=later)
    assert kept.jobs.count() == 2 and kept.counts_state.first()["count_history"] == [3]
    same = run(spark, [], first.jobs, first.counts_state, not_modified=True, minimum=1, now=later)
    assert same.jobs.count() == 2 and same.counts_state.first()["count_history"] == [3]
    dropped = run(spark, [raw("1", "运营策划", ["不限专业"])], first.jobs, first.counts_state, now=later)
    assert dropped.quality.first()["quarantined"] and dropped.jobs.count() == 2 and dropped.counts_state.first()["count_history"] == [3, 1]
    missed = run(spark, [raw("1", "运营策划", ["不限专业"]), raw("4", "软件工程师")], first.jobs, first.counts_state, now=later)
    got = {r["id"]: (r["status"], r["first_missing_successes"], r["first_seen_at"]) for r in missed.jobs.collect()}
    assert got == {"demo:1": ("ACTIVE", 0, NOW), "demo:2": ("ACTIVE", 1, NOW)}
    with pytest.raises(RuntimeError, match="verified_source_gate_failed"):
        run(spark, [], None, None, complete=False, minimum=1)


def test_products_are_written(spark, first, tmp_path):
    first.write(str(tmp_path))
    base = tmp_path / first.version
    assert spark.read.parquet(str(base / "details")).count() == 2 and len(list((base / "details").glob("detail_shard=*"))) == 1
    listed = spark.read.parquet(str(base / "list"))
    assert "description" not in listed.columns and listed.first()["catalog_version"] == first.version
    assert spark.read.parquet(str(base / "campaign_jobs")).count() == 2


def test_observation_stream_equals_batch(spark, tmp_path):
    rows = [("c", NOW + timedelta(days=i), s) for i, s in enumerate(["ACTIVE_CONFIRMED", "STALE", "BLOCKED", "STALE", "ACTIVE_CONFIRMED", "INACTIVE"])] + [("d", NOW, "STALE")]
    schema = "company_id string, checked_at timestamp, directory_status string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = state.observation_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("obs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = [(r["directory_status"], r["consecutive_failures"]) for r in spark.table("obs").filter("company_id = 'c'").orderBy("checked_at").collect()]
    text = F.lit(None).cast("string")
    old = spark.createDataFrame([], "company_id string, cohort string, directory_status string, entry_type string, career_url string, evidence_url string, signals array<string>, last_checked_at timestamp, first_confirmed_at timestamp, consecutive_failures int, last_error_type string, public boolean")
    want = []
    for company, at, status in rows[:-1]:
        seen = spark.createDataFrame([(company, status, at)], "company_id string, directory_status string, checked_at timestamp").withColumns({"cohort": text, "entry_type": text, "career_url": text, "error_type": text, "signals": F.array().cast("array<string>")})
        old = spark.createDataFrame(snapshots.merge_observations(old, seen).collect(), old.schema)
        want.append((old.first()["directory_status"], old.first()["consecutive_failures"]))
    assert got == want


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    names = ["source_id", "id", "content_hash", "status", "first_missing_successes", "first_seen_at", "last_verified_at", "changed_at"]
    schema = "source_id string, id string, content_hash string, status string, first_missing_successes int, first_seen_at timestamp, last_verified_at timestamp, changed_at timestamp, complete boolean, quarantined boolean, run_at timestamp"
    runs = [["a", "b"], ["a"], ["a"]]
    frames = []
    for i, ids in enumerate(runs):
        at = NOW + timedelta(days=i)
        frames.append(spark.createDataFrame([("s", x, "h", "ACTIVE", 0, at, at, None, True, False, at) for x in ids], schema))
        frames[-1].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = state.lifecycle_stream(stream, str(tmp_path / "state"), names).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["id"]: (r["status"], r["first_missing_successes"]) for r in spark.read.parquet(str(tmp_path / "state" / "v00000002")).collect()}
    assert got == {"a": ("ACTIVE", 0), "b": ("CLOSED", 2)}


def test_keyed_lifecycle_equals_batch(spark, tmp_path):
    """Twenty snapshots of three sources, some incomplete or quarantined, postings that come, change, go and return; stream against batch."""
    r = random.Random(4)
    names = ["source_id", "id", "content_hash", "status", "first_missing_successes", "first_seen_at", "last_verified_at", "changed_at"]
    schema = state.LIFECYCLE_ROW + ", run long, run_at timestamp, complete boolean, quarantined boolean, postings long"
    previous, touched = spark.createDataFrame([], state.LIFECYCLE_ROW), 0
    for run in range(20):
        at = NOW + timedelta(days=12 * run)
        rows, flags = [], []
        for source in ("s", "t", "u")[: 3 if run % 4 else 2]:
            ids = [f"p{i}" for i in range(12) if r.random() < 0.7 and i < 6 + run and not (i == 0 and run > 5)]
            complete, quarantined = r.random() < 0.8, r.random() < 0.1
            flags.append((source, complete, quarantined))
            rows += [(source, x, f"h{r.randrange(2)}", "ACTIVE", 0, at, at, None, run, at, None, None, None) for x in ids]
            rows.append((source, None, None, None, None, None, None, None, run, at, complete, quarantined, len(ids)))
            if run == 9:
                rows.append((source, "late", "h", "ACTIVE", 0, at, at, None, 3, at, None, None, None))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        current = spark.createDataFrame([x[:8] for x in rows if x[1] is not None and x[1] != "late"], state.LIFECYCLE_ROW)
        sources = spark.createDataFrame(flags, "source_id string, complete boolean, quarantined boolean")
        out = snapshots.retain(snapshots.advance_lifecycle(previous, current, sources, F.lit(at)), F.lit(at), 90).select(*names)
        previous = spark.createDataFrame(out.collect(), state.LIFECYCLE_ROW)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
        query = state.keyed_lifecycle(stream, shards=3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = state.latest_lifecycle(spark.read.parquet(str(tmp_path / "out"))).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, previous.collect()), key=lambda x: x[:2]) or sorted(map(str, got.collect())) == sorted(map(str, previous.collect()))


def test_stage_stream_and_first_seen(spark, tmp_path):
    rows = [("u", "j", NOW + timedelta(hours=i), s) for i, s in enumerate(["NOT_APPLIED", "APPLIED", "APPLIED", "INTERVIEW", "OFFER"])]
    schema = "user_id string, job_id string, ts timestamp, stage string"
    spark.createDataFrame(rows + rows[-1:], schema).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("stages", state.stage_event_stream(source())), ("seen", state.first_seen_stream(source(), ["user_id", "job_id", "stage"], "ts"))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        query.processAllAvailable()
        query.stop()
    assert [r["event_type"] for r in spark.table("stages").orderBy("ts").collect()] == ["NOTE", "INTERVIEW", "OFFER"]
    assert spark.table("seen").count() == 4


def test_directory_cases(spark):
    companies = spark.createDataFrame([("v", 1, "甲", "https://v.example.com"), ("l", 2, "乙", "https://l.example.com"), ("n", 3, "丙", None), ("p", 4, "丁", None)], "company_id string, seq int, name string, career_url string")
    sources = spark.createDataFrame([("v", 1, "VERIFIED", "https://v.example.com/api", "feishu", "JSON", None)], "company_id string, seq int, status string, source_url string, adapter string, access_mode string, verified_at date")
    jobs = spark.createDataFrame([("l", "ACTIVE", "2026")], "company_id string, status string, cohort string")
    leads = spark.createDataFrame([("p", 1, "https://p.example.com", "2027届秋招", False, "NEEDS_REVIEW", "https://post")], "company_id string, seq int, official_url string, title string, official_url_verified boolean, verification_status string, source_url string")
    got = {r["company_id"]: (r["directory_status"], r["entry_type"]) for r in reports.company_directory(companies, sources, jobs, F.lit(NOW), leads=leads).collect()}
    assert got == {"v": ("ACTIVE_CONFIRMED", "OFFICIAL_ATS"), "l": ("ACTIVE_LEAD", "ENTRY_LEAD"), "p": ("ACTIVE_LEAD", "ENTRY_LEAD")}


def test_driver_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(load_all()) > 200
    out = contract.entry(spark)
    assert out.columns[:2] == ["event_type", "run"] and out.count() > 0
