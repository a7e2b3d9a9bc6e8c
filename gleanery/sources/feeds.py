"""Fetched feed pages: XML rows, completeness and parse health."""

from __future__ import annotations

import itertools
import re
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import defaults as d
from gleanery.functions.dates import feed_date
from gleanery.scale import dealt, lookup_join

# --- fixed values: element names of a feed row, in the order they are tried --------------------------------
FEED_FIELDS = {
    "title": ["title", "name", "jobTitle", "job_title"],
    "description": ["description", "summary", "content", "jobDescription", "descriptionHtml"],
    "location": ["location", "locations", "city", "workLocation", "jobLocation"],
    "requirements": ["requirements", "qualifications", "qualification", "education", "experience"],
    "published": ["pubDate", "published", "datePosted", "postedAt", "createdAt", "created"],
    "deadline": ["validThrough", "deadline", "closingDate", "applicationDeadline"],
    "id": ["id", "guid", "jobId", "job_id", "requisitionId", "shortcode"],
    "department": ["department", "team", "category"],
}
LINK_FIELDS = ["applyUrl", "apply_url", "applicationUrl", "url", "link", "hostedUrl"]
_LOCAL_NAME = re.compile(r"[^}:]*$")
ROW = T.StructType([T.StructField(f, T.StringType()) for f in [*FEED_FIELDS, "url"]])
FEED = T.StructType([T.StructField("valid_xml", T.BooleanType()), T.StructField("record_count", T.IntegerType()), T.StructField("rows", T.ArrayType(ROW))])


def _children(record) -> dict[str, list]:
    """Descendants of a record by local name in lower case, in document order."""

    named: dict[str, list] = {}
    for node in itertools.islice(record.iter(), 1, None):
        named.setdefault(_LOCAL_NAME.search(str(node.tag))[0].lower(), []).append(node)
    return named


def _text(node) -> str:
    return " ".join(" ".join(node.itertext()).split())


def _record(node, base: str) -> dict:
    """Column values of one record: the first element in the document with one of a column's names and a text wins."""

    named = _children(node)
    place = {id(n): i for i, n in enumerate(node.iter())}

    def first(names, read):
        nodes = sorted((n for name in {x.lower() for x in names} for n in named.get(name, ())), key=lambda n: place[id(n)])
        return next(filter(None, map(read, nodes)), None)

    href = first(LINK_FIELDS, lambda n: (n.get("href") or n.get("url") or _text(n)).strip())
    return {**{column: first(names, _text) for column, names in FEED_FIELDS.items()}, "url": href and urljoin(base, href)}


def _read_feed(xml: str | None, base: str | None) -> dict:
    """Records of one feed. A record without title or link still counts, so a changed schema shows."""

    try:
        root = ElementTree.fromstring(xml or "")
    except (ElementTree.ParseError, ValueError):
        return {"valid_xml": False, "record_count": 0, "rows": []}
    tagged = [n for n in root.iter() if _LOCAL_NAME.search(str(n.tag))[0].lower() in d.FEED_RECORD_TAGS]
    rows = [_record(n, base or "") for n in tagged or root]
    usable = [r for r in rows if r["title"] and r["url"]]
    return {"valid_xml": True, "record_count": len(tagged or usable), "rows": usable}


@F.pandas_udf(FEED)
def read_feed(bodies: pd.Series, bases: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read_feed(x, b) for x, b in zip(bodies, bases)], columns=["valid_xml", "record_count", "rows"])


def feed_rows(bodies: DataFrame, keep: list[str], body: str = "body", base: str = "base_url", tasks: int | None = None) -> DataFrame:
    """One row per usable record of each stored feed body."""

    parsed = dealt(bodies, tasks).withColumn("feed", read_feed(F.col(body), F.col(base)))
    long = parsed.select(*keep, F.posexplode("feed.rows").alias("row_no", "r"))
    return long.select(
        *keep, "row_no", F.coalesce("r.id", "r.url").alias("id"), "r.title", F.coalesce("r.description", F.lit("")).alias("description"),
        F.coalesce("r.requirements", F.lit("")).alias("requirements"), F.coalesce("r.location", F.lit(d.UNKNOWN)).alias("location"), "r.url",
        feed_date("r.published").alias("published_at"), feed_date("r.deadline").alias("deadline"), F.coalesce("r.department", F.lit("")).alias("department"))


def feed_counts(bodies: DataFrame, keep: list[str], body: str = "body", base: str = "base_url", tasks: int | None = None) -> DataFrame:
    """Record and usable-row counts per body."""

    parsed = dealt(bodies, tasks).withColumn("feed", read_feed(F.col(body), F.col(base)))
    return parsed.select(*keep, "feed.valid_xml", "feed.record_count", F.size("feed.rows").alias("usable_rows"))


def feed_items(rows: DataFrame) -> Column:
    """A feed row as the VARIANT item the shared mapper reads."""

    return F.to_variant_object(F.struct(
        "id", "title", "description", "requirements", "location", "url", F.col("published_at").cast("string").alias("publishedAt"),
        F.col("deadline").cast("string").alias("deadline"), "department"))


def paging_state(pages: DataFrame, source: str = "source_id") -> DataFrame:
    """Is each source's set of fetched pages whole?

    ``pages`` has one row per fetched page: (source, page, row_count, total, page_size, max_pages). A short or empty last
    page, or the announced total, ends a feed. An empty page before the total, or a missing page, is incomplete paging;
    reaching the page limit before the end is a truncated feed. Pages are whole numbers. Those of a source are counted as the
    bits of blocks of 64 pages, so a task holds a row per block, and a source of very many pages is spread by its blocks.
    """

    page = F.col("page").cast("bigint")
    most = [F.max(c).alias(c) for c in ("total", "page_size", "max_pages")]
    blocks = pages.withColumns({"_block": F.shiftright(page, 6), "_bit": F.expr("shiftleft(1L, cast(cast(page as bigint) & 63 as int))")}).groupBy(source, "_block").agg(
        F.sum("row_count").alias("row_count"), F.max("page").alias("last_page"), F.bit_or("_bit").alias("_bits"), F.max_by("row_count", "page").alias("last_rows"), *most)
    agg = blocks.groupBy(source).agg(
        F.sum("row_count").alias("row_count"), F.max("last_page").alias("last_page"), F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0)).alias("pages"),
        F.max_by("last_rows", "last_page").alias("last_rows"), *most)
    reached = F.col("total").isNotNull() & (F.col("row_count") >= F.col("total"))
    short = F.col("last_rows") < F.col("page_size")
    gap = F.col("pages") < F.col("last_page")
    error = (
        F.when(gap, "incomplete_pagination").when(reached, F.lit(None).cast("string"))
        .when(F.col("total").isNotNull() & (F.col("last_rows") == 0), "incomplete_pagination").when(F.col("total").isNull() & short, F.lit(None).cast("string"))
        .when(F.col("last_page") >= F.col("max_pages"), "truncated_feed").otherwise("incomplete_pagination")
    )
    return agg.withColumn("error", error).withColumn("complete", F.col("error").isNull())


def complete_rows(rows: DataFrame, state: DataFrame, source: str = "source_id") -> DataFrame:
    """Rows of whole feeds only: a part of a feed is never published."""

    return lookup_join(rows, state.filter("not complete").select(source).distinct(), source, "left_anti")


def parse_health(sources: DataFrame, rows: DataFrame, in_scope: Column, valid: Column, source: str = "source_id") -> DataFrame:
    """Completeness of one fetch by its rows (S31). Rows out of scope are no error; nothing usable among rows in scope is."""

    seen = rows.groupBy(source).agg(F.count("*").alias("raw_count"), F.count_if(in_scope).alias("in_scope"), F.count_if(in_scope & valid).alias("valid_rows"))
    joined = sources.join(seen, source, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    out = joined.select(*sources.columns, zero("raw_count"), zero("in_scope"), zero("valid_rows"))
    error = F.when(~F.col("recognised"), "incomplete_payload").when((F.col("in_scope") > 0) & (F.col("valid_rows") == 0), "invalid_items")
    return out.withColumn("error", error).withColumn("complete", F.col("error").isNull())
