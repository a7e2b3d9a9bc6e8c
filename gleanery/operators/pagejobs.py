"""Jobs of stored web pages, from the parsed page to gated rows, counts and the web catalog.

A page's postings come from its JSON-LD blocks, then its visible table rows; only a page that yields neither is read for job-looking
links. Which of the three apply is decided inside the row, on arrays, so nothing is joined back to the page.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleanery import defaults as d
from gleanery.functions import urls
from gleanery.functions.rules import feed_row_allowed, has_any
from gleanery.functions.text import let, single_spaced
from gleanery.operators import pages as p
from gleanery.operators.gates import url_gate
from gleanery.operators.provisional import gated_jobs, page_counts, web_catalog
from gleanery.scale import keep_first, lookup_join, materialize, with_computed
from gleanery.sources import records
from gleanery.sources.envelopes import first_field, is_type, jsonld_objects

JSONLD, ROW, LINK = 0, 1, 2
SKIPPED_LINK = "^(javascript:|data:|mailto:|tel:|#)"
CANDIDATE = ("struct<kind:int,at:int,posting:variant,title:string,href:string,location:string,description:string,requirements:string,own_id:string>")


def _candidate(kind: int, at: Column, **fields: Column) -> Column:
    names = {"posting": "variant", "title": "string", "href": "string", "location": "string", "description": "string", "requirements": "string", "own_id": "string"}
    values = [fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()]
    return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), *values)


def _in_scope(title: Column, context: Column) -> Column:
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("allowed_job_ids", "allowed_title_markers", "campus_markers")]
    return feed_row_allowed(F.array().cast("array<string>"), title, context, *lists)


def posting_candidates(postings: str) -> Column:
    """JSON-LD postings in scope."""

    found = F.transform(postings, lambda x, i: _candidate(JSONLD, i, posting=x, title=F.trim(F.coalesce(first_field(x, "title", "name"), F.lit("")))))
    return F.filter(found, lambda c: _in_scope(c["title"], records.context_text(c["posting"])))


def row_candidates(rows: Column) -> Column:
    """Visible table rows with a data cell and a plausible title; body rows where the page has any."""

    usable = lambda x: (x != "") & ~x.isin(*d.TITLE_STOPWORDS) & (F.length(x) <= 160)
    body = F.filter(rows, lambda r: r["in_body"])
    chosen = F.when(F.size(body) > 0, body).otherwise(rows)

    def read(r, i):
        cells = r["cells"]
        rest = F.slice(cells, 2, F.size(cells))
        second = F.try_element_at(cells, F.lit(2))
        plain = F.when((second != "") & (F.length(second) <= 80) & ~second.rlike(d.ROW_REQUIREMENT_WORDS), second)
        return _candidate(
            ROW, i, title=F.when(~r["hidden"] & (r["data_cells"] > 0), F.try_element_at(F.concat(F.filter(r["labels"], usable), F.filter(cells, usable)), F.lit(1))),
            href=F.try_element_at(F.filter(r["hrefs"], lambda h: ~F.lower(F.trim(h)).rlike(SKIPPED_LINK)), F.lit(1)),
            location=F.coalesce(F.try_element_at(F.filter(rest, lambda c: has_any(c, d.ROW_CITY_WORDS)), F.lit(1)), plain, F.lit(d.UNKNOWN)),
            description=F.array_join(F.filter(cells, lambda c: c != ""), " "), requirements=F.array_join(F.slice(cells, 3, F.size(cells)), " "),
            own_id=F.concat(F.lit("row-"), i, F.lit("-"), F.substring(F.sha2(F.array_join(cells, "|"), 256), 1, 12)))

    return F.filter(F.transform(chosen, read), lambda c: F.coalesce(p.is_job_title(c["title"]) & _in_scope(c["title"], F.concat_ws(" ", c["title"], c["description"], c["location"])), F.lit(False)))


def link_candidates(links: Column) -> Column:
    """Shown links outside navigation with a plausible title. Their address is judged once it is resolved."""

    found = F.transform(links, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    shown = F.filter(found, lambda c: (c["x"]["tag"] == "a") & ~c["x"]["nav"] & ~c["x"]["hidden"] & c["x"]["href"].isNotNull() & ~F.lower(F.trim(c["x"]["href"])).rlike(SKIPPED_LINK))
    out = F.transform(shown, lambda c: _candidate(LINK, c["i"], title=single_spaced(c["x"]["text"]), href=c["x"]["href"], location=F.lit(d.UNKNOWN), description=c["x"]["around"], requirements=c["x"]["around"]))
    return F.filter(out, lambda c: F.coalesce(p.is_job_title(c["title"]) & _in_scope(c["title"], F.concat_ws(" ", c["title"], c["description"])), F.lit(False)))


def page_jobs(parsed: DataFrame, keep: Sequence[str], url: str = "url", page: str = "page") -> DataFrame:
    """All postings of parsed pages (H12), mapped like feed items, with ``keep``, ``kind`` and ``at`` (the place on the page).

    ``parsed`` also holds the page's source: its columns of the record mapping and ``apply_domains``. Of postings of a page with the same
    id, title and address the first counts, JSON-LD before rows. No page, list or text is cut.
    """

    held = with_computed(parsed, {"_ld": F.filter(jsonld_objects(F.col(f"{page}.json_ld")), lambda x: is_type(x))})
    sure = let(F.concat(posting_candidates("_ld"), row_candidates(F.col(f"{page}.rows"))), lambda found: F.when(
        (F.size(found) > 0) | ~p.is_recruitment_page(F.col(url), F.col(f"{page}.text")), found).otherwise(link_candidates(F.col(f"{page}.links"))))
    rows = held.withColumn("_c", F.explode(sure)).withColumn("_page_url", F.col(url)).drop("_ld", page)
    rows = with_computed(rows, {"_to": urls.absolute_url(F.coalesce("_c.href", F.lit("")), F.col("_page_url"))})
    rows = with_computed(rows, {"_to": urls.page_url("_to")})
    path, title = F.lower(urls.url_path("_to")), F.col("_c.title")
    hint = has_any(path, d.JOB_LINK_PATH_WORDS) | has_any(title, d.JOB_LINK_TITLE_WORDS) | F.col("_c.description").rlike("20\\d{2}[年./-]")
    rows = rows.filter((F.col("_c.kind") != LINK) | F.coalesce(urls.host_under_any(urls.url_host("_to"), "apply_domains") & hint, F.lit(False)))
    item = F.to_variant_object(F.struct(
        title.alias("title"), F.col("_c.description").alias("description"), F.coalesce("_to", "_page_url").alias("url"), F.col("_c.location").alias("jobLocation"),
        F.col("_c.requirements").alias("qualifications"), F.coalesce("_to", "_c.own_id").alias("identifier")))
    rows = with_computed(rows, {"item": F.coalesce("_c.posting", item), "endpoint": F.col("_page_url"), "kind": F.col("_c.kind"), "at": F.col("_c.at")}).drop("_c", "_to", "_page_url")
    jobs = records.map_feed(rows, "jsonld", keep=[*keep, "kind", "at", "apply_domains"])
    jobs = with_computed(jobs, {"_key": F.lower(F.concat_ws("|", F.coalesce("source_job_id", F.lit("")), "title", "apply_url"))})
    return keep_first(jobs, [*keep, "_key"], [F.col("kind").asc(), F.col("at").asc()]).drop("_key")


@dataclass
class Collected:
    """``jobs``: gated postings of all pages; ``counts``: one row per page; ``totals``: rows written, seen as they were written."""

    jobs: DataFrame
    counts: DataFrame
    totals: dict[str, int]

    def catalog(self, keep: Sequence[str], include_review: bool = False) -> DataFrame:
        return web_catalog(self.jobs, [*keep, "kind", "at"], include_review)


def collect_pages(parsed: DataFrame, keep: Sequence[str], url: str = "url", page: str = "page") -> Collected:
    """Extract, map, gate and count the postings of parsed pages (P36). Pages without a posting count zero.

    The gated rows are written once; their totals are observed on the way, and counts and catalog read what was written.
    """

    jobs = page_jobs(parsed, keep, url, page)
    jobs = jobs.withColumn("id", F.concat(F.lit("job-"), F.substring(F.sha2(F.concat_ws("|", "source_id", F.coalesce("source_job_id", F.lit("")), "apply_url"), 256), 1, 24)))
    gated = gated_jobs(materialize(jobs), url_gate(F.col("source_url"), F.col("apply_url"), F.col("source_url"), F.col("apply_domains")))
    seen = Observation("collected")
    decided = lambda v: F.coalesce(F.sum((F.col("decision") == v).cast("long")), F.lit(0))
    gated = materialize(gated.observe(seen, F.count(F.lit(1)).alias("raw_jobs"), decided("TARGET_GENERALIST").alias("eligible_jobs"), decided("NEEDS_REVIEW").alias("review_jobs"), decided("OUT_OF_SCOPE").alias("excluded_jobs")))
    names = ["raw_jobs", "normalised_jobs", "eligible_jobs", "review_jobs", "excluded_jobs"]
    counts = lookup_join(parsed.select(*keep), page_counts(gated, keep), list(keep)).fillna(0, names)
    return Collected(gated, counts, dict(seen.get))


def analyse_changed(
    pages: DataFrame, state: str, run: int, analyse: Callable[[DataFrame], DataFrame], key: str = "url", html: str = "html", buckets: int = 64,
) -> DataFrame:
    """Analysis of every page, made anew only where the content changed since the run before.

    ``state`` is a folder of hash buckets of earlier analyses. Pages meet them by (key, content hash); the rest is handed to ``analyse``,
    which returns a row per page with ``key`` and ``content_hash``. Only buckets with a new, changed or vanished page are written again,
    under ``run``; the manifest, written last, says which run holds each bucket, so a run that stops halfway leaves the earlier state valid
    and may be repeated. Runs count from 0, ``key`` is unique.
    """

    spark = pages.sparkSession
    hashed = pages.withColumn("content_hash", F.sha2(F.coalesce(F.col(html), F.lit("")), 256)).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    held = spark.read.parquet(f"{state}/manifest/run={run - 1}").collect() if run else []  # one row per bucket
    if not held:
        fresh = analyse(hashed)
        kept = None
    else:
        schema = spark.read.parquet(*[r["path"] for r in held][:1]).schema
        old = spark.read.schema(schema).parquet(*[r["path"] for r in held])
        same = hashed.select(key, "content_hash")
        kept = old.join(same, [key, "content_hash"], "left_semi")
        fresh = analyse(hashed.join(old.select(key, "content_hash"), [key, "content_hash"], "left_anti")).select(*old.columns)
    fresh = materialize(fresh)
    touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
    if kept is not None:
        gone = old.join(same, [key, "content_hash"], "left_anti").select("bucket").distinct().collect()
        touched |= {r["bucket"] for r in gone}
    place = lambda b: f"{state}/run={run}/part={b}"
    rows = fresh if kept is None else fresh.unionByName(kept.filter(F.col("bucket").isin(sorted(touched))))
    if touched:
        rows.withColumn("part", F.col("bucket")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{state}/run={run}")
    left = {r["bucket"] for r in rows.select("bucket").distinct().collect()} if touched else set()
    paths = {r["bucket"]: r["path"] for r in held if r["bucket"] not in touched} | {b: place(b) for b in left}
    spark.createDataFrame(sorted(paths.items()), "bucket int, path string").write.mode("overwrite").parquet(f"{state}/manifest/run={run}")
    if not paths:
        return fresh
    return spark.read.schema(fresh.schema).parquet(*[paths[b] for b in sorted(paths)])
