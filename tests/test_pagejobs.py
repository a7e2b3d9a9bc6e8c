"""Postings of whole pages: precedence, duplicates, long pages, totals, and runs over changed pages only."""

import pytest
from pyspark.sql import functions as F

from gleanery.operators import pagejobs, pages

SOURCE = {"source_id": "s", "company_id": "c", "company_name": "甲", "source_level": "B"}
LD = '<script type="application/ld+json">{"@type":"JobPosting","title":"产品运营","url":"/jobs/1","identifier":"https://x.example.com/jobs/1","jobLocation":"北京"}</script>'
ROW = "<tr><td><a href='/jobs/%d'>岗位%d</a></td><td>武汉</td></tr>"


@pytest.fixture(scope="module")
def collected(spark):
    many = "<table>" + "".join(ROW % (i, i) for i in range(450)) + "</table>"
    links = "<h1>校园招聘</h1>" + "".join(f"<a href='/campus/{i}'>校招岗位{i}</a>" for i in range(320)) + "<footer><a href='/campus/x'>校招页脚</a></footer>"
    html = {0: LD + "<table><tr><td><a href='/jobs/1'>产品运营</a></td><td>北京</td></tr></table>" + links, 1: many, 2: links, 3: "", 4: None, 5: "<table><tr><th>职位</th></tr></table>" + links, 6: "<p>no words</p><a href='/a/1'>岗位一二</a>"}
    none = F.array().cast("array<string>")
    rows = spark.createDataFrame([(i, f"https://x.example.com/p{i}", h) for i, h in html.items()], "page_id long, url string, html string")
    rows = pages.parse_pages(rows).drop("html").withColumns({k: F.lit(v) for k, v in SOURCE.items()} | {
        "source_url": F.col("url"), "evidence_urls": none, "current_cohort_signal": F.lit(None).cast("string"), "allowed_job_ids": none, "allowed_title_markers": none, "campus_markers": none, "apply_domains": F.array(F.lit("example.com"))})
    return pagejobs.collect_pages(rows, ["page_id"])


def test_links_only_where_nothing_better_is_found_and_nothing_is_cut(collected):
    got = {(r["page_id"], r["kind"]): r["count"] for r in collected.jobs.groupBy("page_id", "kind").count().collect()}
    assert got == {(0, pagejobs.JSONLD): 1, (1, pagejobs.ROW): 450, (2, pagejobs.LINK): 320, (5, pagejobs.LINK): 320}


def test_counts_are_those_of_the_rows_written(collected):
    counts = {r["page_id"]: r.asDict() for r in collected.counts.collect()}
    assert set(counts) == set(range(7)) and counts[3]["raw_jobs"] == counts[4]["raw_jobs"] == 0
    for name in ("raw_jobs", "eligible_jobs", "review_jobs", "excluded_jobs"):
        assert collected.totals[name] == sum(c[name] for c in counts.values())
    assert collected.totals["raw_jobs"] == collected.jobs.count() == 1091
    shown = collected.catalog(["page_id"], include_review=True)
    assert shown.count() == shown.select("id").distinct().count() <= 1091


def test_only_changed_pages_are_analysed_again(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("https://x.example.com/"), "id").alias("url"), F.concat(F.lit("<title>t"), "id", F.lit("</title>")).alias("html"))
    state, parsed = str(tmp_path / "state"), []

    def analyse(run):
        def titles(changed):
            parsed.append(changed.count())
            return pages.parse_pages(changed).select("url", "content_hash", "bucket", "page.title", F.lit(run).alias("run"))

        return titles

    assert pagejobs.analyse_changed(rows, state, 0, analyse(0), buckets=8).count() == 200
    edited = rows.withColumn("html", F.when(F.col("url").rlike("/[17]$"), F.lit("<title>new</title>")).otherwise(F.col("html")))
    changed = {r["url"]: (r["title"], r["run"]) for r in pagejobs.analyse_changed(edited, state, 1, analyse(1), buckets=8).collect()}
    assert parsed == [200, 2] and len(changed) == 200
    assert changed["https://x.example.com/7"] == ("new", 1) and changed["https://x.example.com/8"] == ("t8", 0)
    again = pagejobs.analyse_changed(edited, state, 1, analyse(1), buckets=8)  # a run may be repeated
    assert {r["url"]: r["title"] for r in again.collect()} == {u: t for u, (t, _) in changed.items()}
    gone = pagejobs.analyse_changed(edited.filter("url not like '%9'"), state, 2, analyse(2), buckets=8)
    assert parsed[-1] == 0 and gone.count() == 180
    assert pagejobs.analyse_changed(rows.limit(0), state, 3, analyse(3), buckets=8).count() == 0
