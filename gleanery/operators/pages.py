"""Analysis of stored web pages.

``parse_pages`` reads each page once into a struct of text, links, JSON-LD blocks and table rows; everything after it
works on that struct, and the page source is dropped before any shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import defaults as d
from gleanery.functions import urls
from gleanery.functions.rules import first_reason, has_any, reason_list, words_pattern
from gleanery.functions.text import SPACE, let, name_key, nfkc, single_spaced
from gleanery.operators.gates import access_class
from gleanery.scale import collect_in_chunks, dealt, keep_first, lookup_join, materialize
from gleanery.sources.envelopes import first_field, is_type, jsonld_objects

_S = T.StringType()
PAGE = T.StructType([
    T.StructField("title", _S), T.StructField("text", _S), T.StructField("head_text", _S), T.StructField("meta_text", _S),
    T.StructField("links", T.ArrayType(T.StructType([
        T.StructField("tag", _S), T.StructField("href", _S), T.StructField("src", _S), T.StructField("type", _S), T.StructField("rel", _S),
        T.StructField("text", _S), T.StructField("around", _S), T.StructField("nav", T.BooleanType()), T.StructField("hidden", T.BooleanType())]))),
    T.StructField("json_ld", T.ArrayType(_S)),
    T.StructField("rows", T.ArrayType(T.StructType([
        T.StructField("cells", T.ArrayType(_S)), T.StructField("data_cells", T.IntegerType()), T.StructField("in_body", T.BooleanType()),
        T.StructField("hrefs", T.ArrayType(_S)), T.StructField("labels", T.ArrayType(_S)), T.StructField("hidden", T.BooleanType())]))),
])
_TEXTS = pa.list_(pa.string())
_ARROW_PAGE = pa.struct([
    *[(c, pa.string()) for c in ("title", "text", "head_text", "meta_text")],
    ("links", pa.list_(pa.struct([*[(c, pa.string()) for c in ("tag", "href", "src", "type", "rel", "text", "around")], ("nav", pa.bool_()), ("hidden", pa.bool_())]))),
    ("json_ld", _TEXTS),
    ("rows", pa.list_(pa.struct([("cells", _TEXTS), ("data_cells", pa.int32()), ("in_body", pa.bool_()), ("hrefs", _TEXTS), ("labels", _TEXTS), ("hidden", pa.bool_())]))),
])
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

#: Elements that a start tag ends when they are the innermost open one.
_IMPLIED_END = {"li": {"p", "li"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "tr": {"p", "td", "th", "tr"}, "option": {"option"},
                **dict.fromkeys(["p", "div", "ul", "ol", "table", "section", "h1", "h2", "h3"], {"p"})}


class _Page(HTMLParser):
    """One pass over a page: open elements form a stack that tells what is hidden or navigation."""

    def __init__(self, mark: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.mark = mark  # stands for a "&" that is no reference
        self.stack: list[dict] = []
        self.open: Counter[str] = Counter()  # open elements by tag
        self.text: list[str] = []  # shown text; an element's text is what was added since it opened
        self.title: list[str] = []
        self.described: list[str] = []
        self.metas: list[str] = []
        self.links: list[dict] = []
        self.blocks: list[str] = []
        self.rows: list[dict] = []

    def _plain(self, text):
        return text.replace(self.mark, "&") if self.mark else text

    def handle_starttag(self, tag, attrs):
        a = {k: self._plain(v or "") for k, v in attrs}
        while self.stack and self.stack[-1]["tag"] in _IMPLIED_END.get(tag, ()):
            self._close()
        up = self.stack[-1] if self.stack else {}
        marks = f"{a.get('class', '')} {a.get('id', '')}".lower()
        style = a.get("style", "").replace(" ", "").lower()
        shut = up.get("shut") or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        node = {
            "tag": tag, "mute": up.get("mute") or tag in d.HIDDEN_TAGS, "shut": bool(shut), "from": len(self.text), "link": None, "row": up.get("row"), "cell": None,
            "nav": up.get("nav") or tag in {"header", "nav", "footer"} or any(t in marks for t in d.NAVIGATION_TOKENS),
            "ld": tag == "script" and "ld+json" in a.get("type", "").lower(), "body": up.get("body") or tag == "tbody"}
        if tag == "meta":
            if a.get("name", "").lower() in {"description", "keywords"} and a.get("content", "").strip():
                self.described.append(a["content"].strip())
            self.metas.extend(v.strip() for v in (a.get(k) for k in ("content", "name", "property", "itemprop")) if v)
        if tag in {"a", "link", "script", "iframe"} and ("href" in a or "src" in a):
            node["link"] = {"tag": tag, "href": a.get("href"), "src": a.get("src"), "type": a.get("type"), "rel": a.get("rel", "").lower(),
                            "text": "", "around": "", "nav": bool(node["nav"]), "hidden": node["shut"]}
            self.links.append(node["link"])
            if node["row"] is not None and tag == "a" and "href" in a:
                node["row"]["hrefs"].append(a["href"])
        if tag == "tr":
            node["row"] = {"cells": [], "data_cells": 0, "in_body": bool(node["body"]), "hrefs": [], "labels": [], "hidden": node["shut"]}
            self.rows.append(node["row"])
        if tag in {"td", "th"}:
            node["cell"] = tag
        if tag not in _VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def _close(self):
        node = self.stack.pop()
        self.open[node["tag"]] -= 1
        up = self.stack[-1] if self.stack else None
        row = up["row"] if up is not None else None
        named = row is not None and (node["cell"] or node["tag"] == "a")
        if node["link"] is None and "around" not in node and not named:
            return  # nobody asks for its text
        words = " ".join(" ".join(self.text[node["from"]:]).split())
        if node["link"] is not None:
            node["link"]["text"] = words
            if up is not None:
                up.setdefault("around", []).append(node["link"])
        for link in node.get("around", []):
            link["around"] = words
        if named and node["cell"]:
            row["cells"].append(words)
            row["data_cells"] += node["cell"] == "td"
        elif named:
            row["labels"].append(words)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        while self.stack[-1]["tag"] != tag:
            self._close()
        self._close()

    def handle_data(self, data):
        data = self._plain(data)
        if self.stack and self.stack[-1]["ld"]:
            self.blocks.append(data)
        if self.stack and self.stack[-1]["mute"]:
            return
        if self.stack and self.stack[-1]["tag"] == "title":
            self.title.append(data)
        self.text.append(data)


_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);|([A-Za-z][A-Za-z0-9]*;))?")


def _open_references(html: str) -> tuple[str, str]:
    """The page with a mark it does not hold in place of every ``&`` that starts no closed reference, and that mark."""

    mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in html)
    closed = lambda m: m[1] in html5 if m[1] else len(m[0]) > 1
    return _REFERENCE.sub(lambda m: m[0] if closed(m) else mark + m[0][1:], html), mark


def _read_page(html: str | None, closed_only: bool = False) -> dict | None:
    if html is None:
        return None
    html, mark = _open_references(html) if closed_only else (html, "")
    page = _Page(mark)
    page.feed(html)
    page.close()
    while page.stack:
        page._close()
    flat = lambda parts: " ".join(" ".join(parts).split())
    return {"title": flat(page.title), "text": flat(page.text), "head_text": flat([*page.title, *page.described]), "meta_text": flat(page.metas),
            "links": page.links, "json_ld": page.blocks, "rows": page.rows}


def _parts(lengths: Sequence[int | None], size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Bounds of runs of pages that end once they hold ``size`` characters, so only one run at a time is in memory as parsed pages."""

    start = held = 0
    for i, length in enumerate(lengths, 1):
        held += (length or 0) + 64
        if held >= size or i == len(lengths):
            yield start, i
            start, held = i, 0


def parse_pages(pages: DataFrame, html: str = "html", name: str = "page", tasks: int | None = None, closed_only: bool = False) -> DataFrame:
    """Add the parsed page struct. Runs in Arrow batches, parsed in small parts; ``html`` is read whole. ``tasks`` deals the pages anew first.

    Browsers also read references without their semicolon (``&amp``); with ``closed_only`` those stay as written.
    """

    fields = {f.name: f.dataType for f in pages.schema.fields}
    kept = [c for c in pages.columns if c != name]
    schema = T.StructType([T.StructField(c, fields[c]) for c in kept] + [T.StructField(name, PAGE)])

    def read(batches):
        for batch in batches:
            texts = batch.column(html)
            for at, to in _parts(pc.utf8_length(texts).to_pylist()):
                part = batch.slice(at, to - at)
                read_pages = pa.array([_read_page(h, closed_only) for h in part.column(html).to_pylist()], _ARROW_PAGE)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], read_pages], [*kept, name])

    return dealt(pages, tasks).mapInArrow(read, schema)


def visible_text(page: str = "page") -> Column:
    """Title and description words, then the visible body (H1)."""

    p = F.col(page)
    return F.concat_ws(" ", F.nullif(p["head_text"], F.lit("")), p["text"])


def campus_signals(text: str | Column, cohort: str = d.COHORT) -> Column:
    """Signal codes of a page's visible text (H2, page-probe rules)."""

    tight = F.lower(F.regexp_replace(nfkc(text), SPACE, ""))
    return reason_list(
        (tight.rlike(f"{cohort}(?:届|级|校招|校园招聘)"), f"{cohort}_CAMPUS"), (tight.rlike("秋招|秋季校园招聘|秋季招聘|秋季校招"), "AUTUMN_RECRUITMENT"),
        (tight.rlike("校园招聘(?:已|现)?开放|校招(?:已|现)?启动|校园招聘正式启动"), "CAMPUS_RECRUITMENT_OPEN"))


def source_signals(html: str | Column, cohort: str = d.COHORT) -> Column:
    """Signal codes of a page's source (H2, vendor-probe rules)."""

    html = F.col(html) if isinstance(html, str) else html
    tight = F.lower(F.regexp_replace(html, SPACE, ""))
    return reason_list(
        (tight.rlike(f"{cohort}届|{cohort}校招|{cohort}校园招聘"), f"{cohort}_CAMPUS"), (tight.contains("秋招"), "AUTUMN_RECRUITMENT"),
        (tight.contains("校园招聘开放"), "CAMPUS_RECRUITMENT_OPEN"))


def is_challenge(text: str | Column) -> Column:
    """Visible text of a captcha or security page (H3)."""

    return has_any(text, d.CHALLENGE_MARKERS)


def page_links(pages: DataFrame, keep: list[str], url: str = "url", page: str = "page") -> DataFrame:
    """One row per link with its absolute address, in page order."""

    long = pages.select(*keep, F.col(url).alias("page_url"), F.posexplode(f"{page}.links").alias("link_no", "link"))
    target = F.coalesce(F.col("link.href"), F.when(F.col("link.tag").isin("script", "iframe"), F.col("link.src")))
    clean = F.when(~F.trim(target).rlike("^(javascript:|data:|mailto:)"), target)
    long = long.withColumn("link_url", urls.absolute_url(F.coalesce(clean, F.lit("")), F.col("page_url")))
    return long.filter(urls.is_web_url("link_url"))


def feed_links(links: DataFrame, keep: list[str], limit: int | None = None) -> DataFrame:
    """Feed addresses of each page by MIME type, rel or path (H4): all of them, or the first ``limit`` and their number in ``found``."""

    kind, path = urls.mime_type(F.coalesce("link.type", F.lit(""))), F.lower(urls.url_path("link_url"))
    hit = kind.isin(*d.FEED_MIME_TYPES) | (F.col("link.rel").contains("alternate") & kind.rlike("rss|atom")) | path.rlike(words_pattern(d.FEED_PATH_TOKENS))
    return _first_links(links.filter(F.col("link.tag").isin("link", "a") & F.col("link.href").isNotNull() & hit), keep, limit)


def sitemap_links(links: DataFrame, pages: DataFrame, keep: list[str], url: str = "url", limit: int | None = None) -> DataFrame:
    """Sitemap addresses named on the page, anchors first, then the two conventional ones (H5): all, or the first ``limit`` and their number."""

    named = links.filter(F.col("link.tag").isin("a", "link") & F.col("link.href").isNotNull() & F.lower(urls.url_path("link_url")).contains("sitemap"))
    named = named.select(*keep, F.when(F.col("link.tag") == "a", F.col("link_no")).otherwise(F.col("link_no") + 1_000_000).alias("link_no"), "link_url")
    root = F.concat(urls.url_scheme(url), F.lit("://"), urls.url_host(url))
    usual = pages.filter(urls.url_host(url) != "").select(*keep, F.posexplode(F.array(F.concat(root, F.lit("/sitemap.xml")), F.concat(root, F.lit("/sitemap_index.xml")))).alias("_i", "link_url"))
    both = named.unionByName(usual.select(*keep, (F.col("_i") + 2_000_000).alias("link_no"), "link_url"))
    return _first_links(both, keep, limit)


def _first_links(links: DataFrame, keep: list[str], limit: int | None) -> DataFrame:
    """Distinct addresses per page in page order. A page's links come from one row, so they are few."""

    first = links.groupBy(*keep, "link_url").agg(F.min("link_no").alias("link_no"))
    grouped = first.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("link_no", "link_url"))).alias("_l"))
    found = F.transform("_l", lambda x: x["link_url"])
    return grouped.select(*keep, (found if limit is None else F.slice(found, 1, limit)).alias("urls"), F.size("_l").alias("found"))


def sitemap_locations(xml: str | Column, limit: int | None = None) -> Column:
    """Addresses in a sitemap or sitemap index (H5), all or the first ``limit``."""

    xml = F.col(xml) if isinstance(xml, str) else xml
    found = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?loc\s*>(?:\s*<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>\s*)?</(?:\w+:)?loc\s*>"), F.lit(1)),
                        lambda x: F.replace(F.trim(x), F.lit("&amp;"), F.lit("&")))
    distinct = F.array_distinct(F.filter(found, lambda x: urls.is_web_url(x)))
    return distinct if limit is None else F.slice(distinct, 1, limit)


def job_postings(pages: DataFrame, keep: list[str], page: str = "page") -> DataFrame:
    """JSON-LD job postings, one row each (H6)."""

    long = pages.select(*keep, F.posexplode(jsonld_objects(F.col(f"{page}.json_ld"))).alias("item_no", "item"))
    return long.filter(is_type(F.col("item")))


def posting_completeness(item: Column) -> Column:
    """Filled share of the six fields a posting needs."""

    return sum((F.when(first_field(item, k).isNotNull(), 1).otherwise(0) for k in d.JSONLD_REQUIRED), F.lit(0)) / len(d.JSONLD_REQUIRED)


def vendor_matches(source: Column, meta: Column, url: Column, links: Column) -> Column:
    """Vendors whose signatures show up in page source, metas, address or links, in fixed order (H7)."""

    table = F.array(*[F.struct(F.lit(v).alias("vendor"), F.array(*[F.lit(s.lower()) for s in signs]).alias("signs")) for v, signs in d.VENDOR_SIGNATURES])
    host = urls.url_host(url)

    def scan(seen):
        # everything that does not depend on the vendor is in ``seen``, computed once per page
        def match(row):
            found = F.filter(row["signs"], lambda s: F.contains(seen["context"], s))
            link = F.try_element_at(F.filter(seen["links"], lambda u: F.exists(row["signs"], lambda s: F.contains(F.lower(u), s))), F.lit(1))
            sure = F.exists(row["signs"], lambda s: F.contains(seen["host"], s))
            return F.when(F.size(found) > 0, F.struct(row["vendor"].alias("vendor"), F.when(sure, "HIGH").otherwise("MEDIUM").alias("confidence"), found.alias("signals"),
                                                      F.coalesce(link, seen["url"]).alias("context_url")))

        return F.filter(F.transform(table, match), lambda m: m.isNotNull())

    context = F.lower(F.concat_ws(" ", F.replace(source, F.lit("\\/"), F.lit("/")), meta, host, urls.url_path(url), F.array_join(links, " ")))
    return let(F.struct(context.alias("context"), host.alias("host"), url.alias("url"), links.alias("links")), scan)


def _slug(url: Column, marker: str) -> Column:
    given = F.regexp_extract(urls.url_query(url), r"(?:^|&)for=([A-Za-z0-9_-]{1,100})(?:&|$)", 1)
    parts = F.filter(F.split(urls.url_path(url), "/"), lambda p: p != "")
    last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    named = F.when(urls.url_host(url).contains(marker), F.when(last.isin("campus", "position", "jobs", "careers"), before).otherwise(last))
    return F.coalesce(F.nullif(given, F.lit("")), named)


def workday_endpoint(url: Column) -> Column:
    """Listing endpoint of a Workday board when tenant and site are visible in its address."""

    host = urls.url_host(url)
    tenant = F.split_part(host, F.lit("."), F.lit(1))
    parts = F.filter(F.split(urls.url_path(url), "/"), lambda p: (p != "") & ~F.lower(p).isin("jobs", "job", "careers", "career") & ~p.rlike("(?i)^[a-z]{2}(?:-[A-Z]{2})?$"))
    site = F.try_element_at(parts, F.lit(1))
    ok = host.endswith(".myworkdayjobs.com") & (F.size(F.split(host, r"\.")) >= 4) & ~tenant.rlike(r"^wd\d+$") & site.rlike(r"^[A-Za-z0-9._~-]{1,120}$")
    return F.when(ok, F.concat(F.lit("https://"), host, F.lit("/wday/cxs/"), tenant, F.lit("/"), site, F.lit("/jobs")))


def candidate_endpoint(vendor: Column, url: Column) -> Column:
    """Likely listing endpoint of a vendor board, from its address alone (H8)."""

    host, origin = urls.url_host(url), F.regexp_extract(url, "^(https?://[^/?#]+)", 1)
    made = lambda before, slug, after="": F.when(slug.isNotNull(), F.concat(F.lit(before), slug, F.lit(after)))
    tenant = F.try_element_at(F.filter(F.split(urls.url_path(url), "/"), lambda p: p.rlike("^[A-Za-z0-9_-]{2,120}$")), F.lit(-1))
    account = _slug(url, "workable.com")
    breezy = F.coalesce(_slug(url, "breezy.hr"), F.nullif(F.regexp_extract(host, r"^([^.]+)\.breezy\.hr$", 1), F.lit("")))
    return (
        F.when(vendor == "GREENHOUSE", made("https://boards-api.greenhouse.io/v1/boards/", _slug(url, "greenhouse.io"), "/jobs?content=true"))
        .when(vendor == "LEVER", made("https://api.lever.co/v0/postings/", _slug(url, "lever.co"), "?mode=json"))
        .when(vendor == "ASHBY", made("https://api.ashbyhq.com/posting-api/job-board/", _slug(url, "ashbyhq.com")))
        .when(vendor == "WORKDAY", workday_endpoint(url)).when(vendor == "TEAMTAILOR", F.concat(origin, F.lit("/jobs.rss")))
        .when(vendor == "RECRUITEE", F.when(_slug(url, "recruitee.com").isNotNull(), F.concat(F.lit("https://"), host, F.lit("/api/offers"))))
        .when(vendor == "WORKABLE", F.when(host == "apply.workable.com", F.concat(origin, F.lit("/api/v3/accounts"), F.coalesce(F.concat(F.lit("/"), account, F.lit("/jobs")), F.lit("")))))
        .when(vendor == "FEISHU", F.concat(F.lit("https://"), host, F.lit("/api/v1/search/job/posts")))
        .when(vendor == "BEISEN", F.concat(origin, F.lit("/portal/registerSystemInfo")))
        .when(vendor == "SMARTRECRUITERS", made("https://api.smartrecruiters.com/v1/companies/", tenant, "/postings"))
        .when(vendor == "PERSONIO", F.concat(origin, F.lit("/xml"))).when(vendor == "BAMBOOHR", F.concat(origin, F.lit("/careers/list")))
        .when(vendor == "BREEZY", made("https://api.breezy.hr/v3/company/", breezy, "/positions")).when(vendor.isin("ORACLE", "ICIMS", "JSONLD", "STATIC_HTML"), url)
    )


def triage(vendors: Column, reachable: Column, blocked: Column, status: Column, feeds: Column, structured: Column, table_rows: Column, endpoints: Column) -> Column:
    """Next safe step for a page (H9)."""

    seen = (feeds > 0) | (structured > 0) | (table_rows > 0)
    known = F.arrays_overlap(vendors, F.array(*[F.lit(v) for v in d.CONNECTOR_VENDORS]))
    return (
        F.when(blocked | ~reachable | F.coalesce(status >= 400, F.lit(False)), "PUBLIC_ACCESS_UNAVAILABLE")
        .when(((endpoints > 0) & known) | seen, "CONNECTOR_CANDIDATE").when(F.size(vendors) > 0, "NEEDS_MANUAL_REVIEW").otherwise("MANUAL_IMPORT_ONLY")
    )


def review_reasons(vendors: Column, feeds: Column, structured: Column, table_rows: Column, endpoints: Column, signals: Column, completeness: Column) -> Column:
    """Why a page needs a person."""

    return reason_list(
        ((F.size(vendors) == 0) & (feeds == 0) & (structured == 0) & (table_rows == 0), "ats_not_detected_use_manual_or_structured_review"),
        ((F.size(vendors) > 0) & (endpoints == 0), "endpoint_not_inferred_requires_manual_contract_review"),
        (F.size(signals) == 0, "current_cohort_signal_not_found"), ((structured > 0) & (completeness < 0.5), "structured_fields_incomplete"))


def analyse_pages(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html", page: str = "page") -> DataFrame:
    """One analysis row per parsed page: vendors, endpoints, feeds, structured rows, signals, class and reasons."""

    pages = pages.withColumn("_objects", jsonld_objects(F.col(page)["json_ld"]))  # before the lambdas below, which can't hold its Python step
    p = F.col(page)
    rows = F.filter(p["rows"], lambda r: (F.size(r["cells"]) > 0) | (F.size(r["hrefs"]) > 0))
    in_body = F.filter(rows, lambda r: r["in_body"])
    postings = F.filter("_objects", lambda x: is_type(x))
    links = F.array_compact(F.array_distinct(F.transform(p["links"], lambda x: F.coalesce(x["href"], x["src"]))))
    feed_hit = lambda x: F.coalesce(
        x["href"].isNotNull() & x["tag"].isin("a", "link") & (urls.mime_type(F.coalesce(x["type"], F.lit(""))).isin(*d.FEED_MIME_TYPES) | F.lower(F.regexp_replace(x["href"], r"^https?://[^/]*|[?#].*$", "")).rlike(words_pattern(d.FEED_PATH_TOKENS))), F.lit(False))
    out = pages.select(
        *keep, F.col(url).alias("page_url"), vendor_matches(F.col(html), p["meta_text"], F.col(url), links).alias("matches"),
        source_signals(html).alias("signals"), F.size(F.filter(p["links"], feed_hit)).alias("feed_count"), F.size(postings).alias("structured_job_count"),
        F.size(F.when(F.size(in_body) > 0, in_body).otherwise(rows)).alias("table_row_count"), is_challenge(p["text"]).alias("blocked"),
        F.when(F.size(postings) > 0, F.aggregate(postings, F.lit(0.0), lambda acc, x: acc + posting_completeness(x), lambda acc: acc / F.size(postings))).otherwise(0.0).alias("_structured"),
        F.when(F.size(rows) > 0, F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + F.when(F.array_join(r["cells"], "") != "", 0.5).otherwise(0.0) + F.when(F.size(r["hrefs"]) > 0, 0.5).otherwise(0.0),
                                             lambda acc: acc / F.size(rows))).otherwise(0.0).alias("_table"),
    )
    names = F.transform("matches", lambda m: m["vendor"])
    names = F.concat(names, F.when(F.col("structured_job_count") > 0, F.array(F.lit("JSONLD"))).otherwise(F.array().cast("array<string>")))
    names = F.when((F.size(names) == 0) & (F.col("table_row_count") > 0), F.array(F.lit("STATIC_HTML"))).otherwise(names)
    first = F.try_element_at("matches", F.lit(1))
    endpoint = F.filter(F.transform("matches", lambda m: candidate_endpoint(m["vendor"], m["context_url"])), lambda e: e.isNotNull())
    out = out.withColumns({
        "vendors": names, "endpoints": endpoint, "field_completeness": F.round(F.greatest("_structured", "_table"), 4),
        "detected_ats": F.try_element_at(names, F.lit(1)), "confidence": F.coalesce(first["confidence"], F.when(F.size(names) > 0, F.lit("MEDIUM")), F.lit("NONE"))})
    hints = F.size("endpoints") + F.when(urls.url_host("page_url") != "", 2).otherwise(0)  # two conventional sitemap addresses per host
    zero = F.lit(None).cast("int")
    return out.withColumns({
        "classification": triage(F.col("vendors"), ~F.col("blocked"), F.col("blocked"), zero, F.col("feed_count"), F.col("structured_job_count"), F.col("table_row_count"), hints),
        "review_reasons": review_reasons(F.col("vendors"), F.col("feed_count"), F.col("structured_job_count"), F.col("table_row_count"), hints, F.col("signals"), F.col("field_completeness")),
    }).drop("_structured", "_table")


def recruitment_links(links: DataFrame, keep: list[str], limit: int = 8) -> DataFrame:
    """Best recruitment-looking links per page: same site or known vendor only."""

    host, base = urls.url_host("link_url"), urls.url_host("page_url")
    text, path = F.lower(F.col("link.text")), F.lower(F.concat_ws(" ", urls.url_path("link_url"), urls.url_query("link_url")))
    vendor_hosts = sorted({s.lower() for _, signs in d.VENDOR_SIGNATURES for s in signs if "." in s})
    near = (host == base) | host.endswith(F.concat(F.lit("."), base)) | base.endswith(F.concat(F.lit("."), host))
    known = F.arrays_overlap(urls.host_suffixes(host), F.array(*[F.lit(h) for h in vendor_hosts]))
    score = F.when(has_any(text, d.RECRUITMENT_TEXT_BONUS), 4).otherwise(0) + F.when(has_any(path, d.RECRUITMENT_PATH_BONUS), 2).otherwise(0)
    hit = (F.col("link.tag") == "a") & (has_any(text, d.RECRUITMENT_WORDS) | has_any(path, d.RECRUITMENT_WORDS)) & (near | known)
    best = links.filter(hit).groupBy(*keep, "link_url").agg(F.max(score).alias("score"))
    grouped = best.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("n"), "link_url"))).alias("_l"))
    return grouped.select(*keep, F.posexplode(F.slice("_l", 1, limit)).alias("place", "x")).select(*keep, "place", F.col("x.link_url").alias("link_url"), (-F.col("x.n")).alias("score"))


def is_job_title(title: Column) -> Column:
    """Plausible posting title: no page furniture, menu word, bare date or single letter."""

    text = F.substring(single_spaced(title), 1, 200)
    furniture = "|".join(d.FURNITURE_WORDS)
    return (
        ~text.isin(*d.TITLE_STOPWORDS) & ~F.lower(text).isin(*[w.lower() for w in d.LINK_STOPWORDS]) & F.length(text).between(2, 160)
        & ~text.rlike(r"^[\d\-/:. ]+$") & ~text.rlike(furniture)
    )


def is_recruitment_page(url: Column, text: Column) -> Column:
    return has_any(F.concat_ws(" ", urls.url_path(url), text), d.RECRUITMENT_PAGE_WORDS)


def table_jobs(pages: DataFrame, keep: list[str], url: str = "url", page: str = "page") -> DataFrame:
    """Visible table rows to job rows."""

    rows = F.col(f"{page}.rows")
    body = F.filter(rows, lambda r: r["in_body"])
    long = pages.select(*keep, F.col(url).alias("page_url"), F.posexplode(F.when(F.size(body) > 0, body).otherwise(rows)).alias("row_no", "r"))
    long = long.filter(~F.col("r.hidden") & (F.col("r.data_cells") > 0))
    usable = lambda x: (x != "") & ~x.isin(*d.TITLE_STOPWORDS) & (F.length(x) <= 160)
    title = F.try_element_at(F.concat(F.filter("r.labels", usable), F.filter("r.cells", usable)), F.lit(1))
    rest = F.slice("r.cells", 2, F.size("r.cells"))
    placed = F.try_element_at(F.filter(rest, lambda c: has_any(c, d.ROW_CITY_WORDS)), F.lit(1))
    second = F.try_element_at("r.cells", F.lit(2))
    plain = F.when((second != "") & (F.length(second) <= 80) & ~second.rlike(d.ROW_REQUIREMENT_WORDS), second)
    long = long.withColumn("title", title).filter(F.coalesce(is_job_title(F.col("title")), F.lit(False)))
    link = F.try_element_at("r.hrefs", F.lit(1))
    long = long.withColumn("href", urls.page_url(urls.absolute_url(F.coalesce(link, F.lit("")), F.col("page_url"))))
    row_id = F.concat(F.lit("row-"), F.col("row_no"), F.lit("-"), F.substring(F.sha2(F.array_join("r.cells", "|"), 256), 1, 12))
    return long.select(
        *keep, F.col("row_no"), "title", F.coalesce(placed, plain, F.lit(d.UNKNOWN)).alias("location"),
        F.coalesce("href", "page_url").alias("apply_url"), F.coalesce("href", row_id).alias("source_job_id"),
        F.array_join(F.filter("r.cells", lambda c: c != ""), " ").alias("description"), F.array_join(F.slice("r.cells", 3, F.size("r.cells")), " ").alias("requirements"))


def link_jobs(links: DataFrame, pages: DataFrame, keep: list[str], domains: str, url: str = "url", page: str = "page") -> DataFrame:
    """Job-looking links of pages that look like recruitment pages (H12), each address once per page."""

    wanted = pages.filter(is_recruitment_page(F.col(url), F.col(f"{page}.text"))).select(*keep, F.col(domains).alias("_domains"))
    rows = links.filter((F.col("link.tag") == "a") & ~F.col("link.nav") & ~F.col("link.hidden")).join(wanted, keep)
    rows = rows.withColumn("href", urls.page_url("link_url"))
    title = single_spaced("link.text")
    hint = has_any(urls.url_path("href"), d.JOB_LINK_PATH_WORDS) | has_any(title, d.JOB_LINK_TITLE_WORDS) | F.col("link.around").rlike("20\\d{2}[年./-]")
    rows = rows.filter(F.coalesce(is_job_title(title) & urls.host_under_any(urls.url_host("href"), "_domains") & hint, F.lit(False)))
    first = rows.groupBy(*keep, "href").agg(F.min(F.struct("link_no", title.alias("title"), F.col("link.around").alias("around"))).alias("x"))
    grouped = first.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("x.link_no", "href", "x.title", "x.around"))).alias("_l"))
    return grouped.select(*keep, F.explode("_l").alias("x")).select(*keep, F.col("x.title").alias("title"), F.col("x.href").alias("apply_url"), F.col("x.around").alias("description"))


def directory_companies(pages: DataFrame, keep: list[str], seq: str, page: str = "page") -> DataFrame:
    """Company rows of directory tables, first mention per name key."""

    long = pages.select(*keep, seq, F.posexplode(f"{page}.rows").alias("row_no", "r")).filter(F.size("r.cells") > 0)
    joined = F.array_join("r.cells", " ")
    header = has_any(joined, d.DIRECTORY_HEADER_WORDS) & (F.size("r.cells") <= 3)
    usable = F.filter("r.cells", lambda c: (c != "") & ~c.rlike(r"^\d{5,6}$") & (c.rlike(d.COMPANY_NAME_WORDS) | c.rlike("[㐀-鿿]")))
    name = F.coalesce(F.try_element_at(usable, F.lit(1)), F.trim(F.try_element_at("r.cells", F.lit(1))))
    code = F.nullif(F.regexp_extract(joined, r"(?<!\d)(\d{5,6})(?!\d)", 1), F.lit(""))
    long = long.filter(~header).select(*keep, seq, "row_no", name.alias("name"), code.alias("stock_code"))
    long = long.withColumn("normalized_name", name_key("name")).filter(F.length("normalized_name") >= 2)
    return keep_first(long, ["normalized_name"], [F.col(seq).asc(), F.col("row_no").asc()])


def changed_pages(pages: DataFrame, previous: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(pages to analyse again, addresses whose earlier analysis still holds), by content hash."""

    hashed = pages.withColumn("content_hash", F.sha2(html, 256))
    known = previous.select(url, "content_hash")
    return hashed.join(known, [url, "content_hash"], "left_anti"), hashed.select(url, "content_hash").join(known, [url, "content_hash"], "left_semi")


def company_rollup(analyses: DataFrame, company: str, order: Sequence[Column] | None = None, url: str = "page_url") -> DataFrame:
    """Pages of a company as one result (H15): class, vendors, signals and review reasons, which are closed sets, and the page that shows most.

    That page has the best class, then the most vendors, postings and table rows, then comes first in ``order``. Columns an analysis lacks
    are left out of the comparison. Sets of page parts meet as partial sets, so no list grows with a company's pages.
    """

    have = set(analyses.columns)
    sets = [c for c in ("vendors", "signals", "review_reasons") if c in have]
    analyses = materialize(analyses)  # read four times below, made once
    hit = F.col("classification") == "CONNECTOR_CANDIDATE"
    empty = F.array().cast("array<string>")
    named = lambda c: F.transform(F.coalesce(c, empty), lambda v: F.struct(F.lit(c).alias("kind"), v.alias("value")))
    rows = analyses.withColumn("_parts", F.array_distinct(F.flatten(F.array(*[named(c) for c in sets]))))
    values = rows.select(company, F.explode("_parts").alias("p")).groupBy(company, "p.kind").agg(F.array_sort(F.collect_set("p.value")).alias("v"))
    values = values.groupBy(company).agg(*[F.max(F.when(F.col("kind") == c, F.col("v"))).alias(c) for c in sets])
    shown = [F.col(c).desc_nulls_last() for c in ("structured_job_count", "table_row_count") if c in have]
    best = [hit.desc(), F.size("vendors").desc(), *shown, *(order or []), *([F.col(url).asc()] if url in have else [])]
    first = keep_first(analyses, [company], best)
    any_hit = analyses.groupBy(company).agg(F.bool_or(hit).alias("_any"), F.count("*").alias("pages"))
    out = lookup_join(any_hit, values, company)
    if url in have:
        out = lookup_join(out, first.select(company, F.col(url).alias("best_page_url"), *[F.col(c) for c in ("detected_ats", "confidence") if c in have]), company)
    out = out.withColumns({c: F.coalesce(c, empty) for c in sets})
    return out.withColumn("classification", F.when(F.col("_any"), "CONNECTOR_CANDIDATE").otherwise("NEEDS_MANUAL_REVIEW")).drop("_any")


def company_endpoints(analyses: DataFrame, company: str, order: Sequence[Column], chunk: int = 1000) -> DataFrame:
    """Distinct endpoints of a company's pages in order of their first page (H15), as chunks of at most ``chunk`` with a running number."""

    long = analyses.select(company, *[c.alias(f"_o{i}") for i, c in enumerate(order)], F.posexplode("endpoints").alias("_at", "endpoint"))
    keys = [f"_o{i}" for i in range(len(order))] + ["_at"]
    once = keep_first(long, [company, "endpoint"], [F.col(k).asc() for k in keys])
    return collect_in_chunks(once, [company], "endpoint", [F.col(k) for k in keys], chunk, "endpoints")


def probe_outcome(url: Column, status: Column, challenge: Column, signals: Column) -> Column:
    """Struct (directory_status, error_type) of one entry probe."""

    kind = access_class(status)
    error = first_reason([
        (F.coalesce(url, F.lit("")) == "", "missing_career_url"), ((urls.url_scheme(url) != "https") | (urls.url_host(url) == ""), "non_https_url"),
        (kind == "unreachable", "request_error"), ((kind == "access_blocked") | challenge, "access_blocked"), (kind != "ok", kind),
        (F.size(signals) == 0, "current_cohort_signal_not_found")], passed="")
    state = (
        F.when(error == "", "ACTIVE_CONFIRMED").when(error.isin("missing_career_url", "not_found", "current_cohort_signal_not_found"), "INACTIVE")
        .when(error.isin("non_https_url", "access_blocked"), "BLOCKED").otherwise("STALE")
    )
    return F.struct(state.alias("directory_status"), F.nullif(error, F.lit("")).alias("error_type"))
