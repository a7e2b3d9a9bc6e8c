"""Registered queries against their SQL on tables with values that the small shared ones lack."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery import workload
from gleanery.functions import text
from gleanery.operators import pagejobs, pages
from gleanery.scale import dealt_by_rows, keep_first
from gleanery.sources import feeds


def against_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    query = workload.load_all()[name]
    got = query.run(spark, str(folder))
    rel = con.sql(query.sql)
    want = sorted(rel.select(", ".join(f'"{c}"' for c in got.columns)).fetchall(), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    return want


def web(spark):
    titles = [(0, "u", "a&amp;&amp"), (1, "u", "R&amp;D &am"), (2, "w", "&lt;x&gt; &quo"), (3, "u", "y"), (22, "v", "z &amp"), (23, "v", "q")]
    return spark.createDataFrame([(k, f"https://{u}.example.com/", f"<html><head><title>{t}</title></head><body><p>b</p></body></html>") for k, u, t in titles], "page_id long, url string, html string")


def test_titles_with_open_references(spark, tmp_path):
    assert dict(against_sql(spark, tmp_path, "H1_page_titles", pages=web(spark)))[0] == "a&&amp"


def test_changed_pages_with_open_references_and_one_address(spark, tmp_path):
    assert len(against_sql(spark, tmp_path, "H14_analyse_changed", pages=web(spark))) == 5


def test_open_references_outside_titles(spark):
    html = "<p>a &amp b &#38; &#x26 &nosuch; &</p><a href='/x?a=1&ampb=2&amp;c'>l</a><script type='application/ld+json'>{\"t\":\"&amp &amp;\"}</script>"
    row = pages.parse_pages(spark.createDataFrame([(1, html)], "page_id int, html string"), closed_only=True).first()["page"]
    assert row["text"] == "a &amp b & &#x26 &nosuch; & l" and row["links"][0]["href"] == "/x?a=1&ampb=2&c" and row["json_ld"] == ['{"t":"&amp &amp;"}']


def test_vanished_page_whose_address_stays(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "url string, html string")
    keep = lambda df: df.select("url", "content_hash", "bucket", "html")
    pagejobs.analyse_changed(rows(("u", "one"), ("u", "two")), str(tmp_path), 0, keep)
    out = pagejobs.analyse_changed(rows(("u", "two")), str(tmp_path), 1, keep)
    assert [r["html"] for r in out.collect()] == ["two"]


def test_stock_codes_of_keys_beyond_six_digits(spark, tmp_path):
    keys = [0, 7, 999_996, 999_999, 1_000_000, 1_000_001, 1_000_002, 1_000_003, 12_345_678]
    assert dict(against_sql(spark, tmp_path, "X17_stock_code", part=spark.createDataFrame([(k,) for k in keys], "p_partkey long")))[12345678] == "123456"


def test_pages_are_parsed_in_small_parts():
    bounds = list(pages._parts([300_000, None, 100_000, 100_000, 100_000, 5]))
    assert bounds == [(0, 1), (1, 5), (5, 6)] and list(pages._parts([])) == []


def test_company_rollup_makes_its_analyses_once(spark):
    made = spark.sparkContext.accumulator(0)

    def analyses(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch.assign(classification="NEEDS_MANUAL_REVIEW", vendors=[["MOKA"]] * len(batch))

    rows = spark.range(40).mapInPandas(analyses, "id long, classification string, vendors array<string>").selectExpr("id % 4 as company", "classification", "vendors")
    assert [r["pages"] for r in pages.company_rollup(rows, "company").collect()] == [10] * 4 and made.value == 40


def test_texts_leave_arrow_in_small_parts():
    most = []

    class Texts:  # an Arrow array that tells how many of its values became Python objects at once
        def __init__(self, values):
            self.values, self.type = values, values.type

        def __len__(self):
            return len(self.values)

        def slice(self, at, rows):
            return Texts(self.values.slice(at, rows))

        def to_pylist(self):
            most.append(len(self.values))
            return self.values.to_pylist()

    out = text.in_parts(Texts(pa.array(["a", None] * 1500)), str.upper)
    assert out.to_pylist() == ["A", None] * 1500 and max(most) <= 256
    assert text.in_parts(pa.array([], pa.string()), str.upper).to_pylist() == []


@pytest.mark.parametrize("name", ["X2_long_list", "X4_normalize_locations", "P2_P19_generic_items"])
def test_costly_row_work_is_dealt_and_done_once(spark, root, name):
    df = workload.load_all()[name].run(spark, root)  # one small input split
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() == spark.read.parquet(f"{root}/part.parquet").count()


def test_paging_state_of_long_feeds_in_blocks(spark):
    feed = lambda k, nums, last: [(k, p, 0 if p == max(nums) else 25, None, 25, 200) for p in nums for _ in range(last)]
    rows = feed(1, range(1, 131), 1) + feed(2, [p for p in range(1, 131) if p != 70], 1) + feed(3, range(1, 66), 2) + [(4, None, 5, None, 25, 200)]
    out = feeds.paging_state(spark.createDataFrame(rows, "source_id long, page int, row_count long, total long, page_size int, max_pages int"))
    got = {r["source_id"]: (r["pages"], r["last_page"], r["last_rows"], r["row_count"], r["error"]) for r in out.collect()}
    assert got == {1: (130, 130, 0, 129 * 25, None), 2: (129, 130, 0, 128 * 25, "incomplete_pagination"), 3: (65, 65, 0, 2 * 64 * 25, None), 4: (0, None, None, 5, "incomplete_pagination")}


def test_paging_state_deals_lines_once_by_their_number(spark, root):
    assert dealt_by_rows(spark.range(1000), ["id"], 10).rdd.getNumPartitions() == 100
    plan = workload.load_all()["S11_paging_state"].run(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def test_first_rows_dealt_to_tasks(spark):
    rows = spark.range(2000).select((F.col("id") % 7 * (F.col("id") % 3 > 0).cast("int")).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("at"), "id")
    order = [F.col("at").desc_nulls_last(), F.col("id").asc()]
    dealt = keep_first(rows, ["k"], order, 5)
    assert sorted(dealt.collect()) == sorted(keep_first(rows, ["k"], order).collect()) and dealt.columns == rows.columns
    assert dealt.rdd.getNumPartitions() == 5


def test_catalog_keeps_its_tasks(spark, root):
    from gleanery.workload import reports

    jobs = reports.catalog_run(workload.Tables(spark, root)).jobs
    assert jobs.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and jobs.count() > 0
