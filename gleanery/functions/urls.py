"""URL parts, safety checks and domain matching."""

from __future__ import annotations

from urllib.parse import urljoin, urldefrag

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import defaults as d
from gleanery.functions.text import SPACE, bounded_text, lit_or_col, nfkc, single_spaced

# parse_url throws on odd input and rejects raw CJK paths, so the parts come from patterns
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:@]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def url_scheme(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(lit_or_col(url), SCHEME, 1))


def url_host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(lit_or_col(url), HOST, 1))


def url_path(url: str | Column) -> Column:
    return F.regexp_extract(lit_or_col(url), PATH, 1)


def url_query(url: str | Column) -> Column:
    return F.regexp_extract(lit_or_col(url), QUERY, 1)


def has_userinfo(url: str | Column) -> Column:
    return F.regexp_extract(lit_or_col(url), AUTHORITY, 1).contains("@")


def without_fragment(url: str | Column) -> Column:
    return F.regexp_replace(lit_or_col(url), "#.*$", "")


def is_web_url(url: str | Column, schemes: tuple[str, ...] = ("http", "https")) -> Column:
    """Allowed scheme, a host, and no user or password part."""

    url = lit_or_col(url)
    return F.coalesce(url_scheme(url).isin(*schemes) & (url_host(url) != "") & ~has_userinfo(url), F.lit(False))


def url_problem(url: str | Column, limit: int = 2048, schemes: tuple[str, ...] = ("http", "https")) -> Column:
    """Why a link is refused: ``blank``, ``too_long`` or ``not_web``; NULL if it is fine. A long link is never cut to another one."""

    text = F.trim(F.coalesce(lit_or_col(url), F.lit("")))
    return F.when(text == "", "blank").when(F.length(text) > limit, "too_long").when(~is_web_url(text, schemes), "not_web")


def safe_url(url: str | Column, limit: int = 2048) -> Column:
    text = F.nullif(single_spaced(url), F.lit(""))
    return F.when(url_problem(text, limit).isNull(), text)


def https_url(url: str | Column, limit: int = 2048) -> Column:
    text = F.trim(lit_or_col(url))
    return F.when(url_problem(text, limit, ("https",)).isNull(), text)


def page_url(url: str | Column) -> Column:
    """https URL with the fragment removed; script, mail and in-page links are NULL."""

    text = single_spaced(url)
    skipped = text.rlike("^(javascript:|data:|mailto:|tel:|#)")
    return F.when(~skipped & url_problem(text, 2000, ("https",)).isNull(), without_fragment(text))


def host_suffixes(host: str | Column) -> Column:
    """``a.b.c`` -> [``a.b.c``, ``b.c``, ``c``]: turns "is this host under that domain" into equality."""

    labels = F.split(lit_or_col(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def clean_domain(domain: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(lit_or_col(domain))), r"^[*.]+", ""), r"\.+$", "")


def host_under_any(host: str | Column, domains: str | Column) -> Column:
    """Exact domain or sub-domain of any listed domain, never a look-alike."""

    host = F.regexp_replace(F.lower(lit_or_col(host)), r"\.+$", "")
    allowed = F.filter(F.transform(lit_or_col(domains), lambda x: clean_domain(x)), lambda x: x != "")
    return F.coalesce((host != "") & F.arrays_overlap(host_suffixes(host), allowed), F.lit(False))


def is_official_url(url: str | Column, domain: str | Column | None = None) -> Column:
    url = lit_or_col(url)
    ok = F.coalesce(url_scheme(url).isin("http", "https") & (url_host(url) != ""), F.lit(False))
    return ok if domain is None else ok & host_under_any(url_host(url), F.array(lit_or_col(domain)))


def traffic_domain(host: str | Column) -> Column:
    """Registrable domain: last two labels, three under the listed two-level suffixes."""

    host = F.lower(lit_or_col(host))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    count = F.size(labels)
    return (
        F.when(count < 2, host)
        .when((count >= 3) & F.when(count >= 2, last(2)).isin(*d.TWO_LEVEL_SUFFIXES), F.when(count >= 3, last(3)))
        .otherwise(F.when(count >= 2, last(2)))
    )


def _with_scheme(text: Column) -> Column:
    return F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))


def normalized_domain(value: str | Column) -> Column:
    """Host without ``www.`` from a URL or a bare domain."""

    text = F.trim(nfkc(value))
    host = F.regexp_replace(url_host(_with_scheme(text)), r"\.+$", "")
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def homepage_values(value: str | Column) -> Column:
    text = F.trim(nfkc(value))
    parts = F.filter(F.transform(F.split(text, r"[;,；，、\n\r\t]+"), lambda x: F.trim(x)), lambda x: x != "")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>"))
        .when(F.size(parts) == 0, F.array(text))
        .otherwise(parts)
    )


def homepage_candidates(value: str | Column) -> Column:
    """Struct of safe homepage addresses and the reasons others were refused."""

    values = homepage_values(value)
    spaced = lambda x: x.rlike(SPACE)
    good = F.filter(
        F.transform(F.filter(values, lambda x: ~spaced(x)), lambda x: _with_scheme(x)), lambda x: is_web_url(x)
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.exists(values, lambda x: ~spaced(x) & ~is_web_url(_with_scheme(x))), F.lit("homepage_invalid_url")),
            F.when(F.exists(values, spaced), F.lit("homepage_contains_whitespace")),
            F.when(F.size(values) > 1, F.lit("homepage_multiple_addresses")),
            F.when(F.size(values) == 0, F.lit("homepage_missing")),
        )
    )
    return F.struct(F.array_distinct(good).alias("candidates"), reasons.alias("reasons"))


def stock_code(value: str | Column) -> Column:
    """Six-digit code, leading zeros kept; reads ``1.0``, ``SSE:002415`` and plain digits."""

    text = F.replace(F.trim(nfkc(lit_or_col(value).cast("string"))), F.lit(","), F.lit(""))
    number = text.try_cast("decimal(38,6)")
    whole = F.when(number == F.floor(number), F.regexp_replace(number.cast("decimal(38,0)").cast("string"), r"\D", ""))
    tagged = F.regexp_extract(text, r"^(?:[A-Za-z]{1,6}[:.]?)?(\d{1,6})$", 1)
    digits = F.coalesce(whole, F.nullif(tagged, F.lit("")))
    return F.when(F.length(digits).between(1, 6), F.lpad(digits, 6, "0"))


def entry_type_for_url(url: str | Column) -> Column:
    url = F.lower(F.coalesce(lit_or_col(url), F.lit("")))
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(url, w))
    return (
        F.when(any_of(d.ATS_URL_TOKENS), F.lit("OFFICIAL_ATS"))
        .when(any_of(d.CAMPAIGN_URL_TOKENS), F.lit("OFFICIAL_CAMPAIGN_PAGE"))
        .otherwise(F.lit("OFFICIAL_CAREER_SITE"))
    )


@F.pandas_udf(T.StringType())
def _join_urls(base: pd.Series, link: pd.Series) -> pd.Series:
    def join(b, l):
        if l is None:
            return None
        try:
            return urljoin(b or "", l)
        except ValueError:
            return None

    return pd.Series([join(b, l) for b, l in zip(base, link)], dtype=object)


def absolute_url(link: str | Column, base: str | Column) -> Column:
    """Resolve a link against its page. Absolute and root-relative links stay on the JVM."""

    link, base = F.trim(lit_or_col(link)), lit_or_col(base)
    full = link.rlike(r"^(?i)https?://")
    rooted = link.rlike(r"^/(?!/)") & ~link.rlike(r"/\.") & base.rlike("^https?://[^/?#]+")
    origin = F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    return (
        F.when(link == "", F.lit(None).cast("string"))
        .when(full, link)
        .when(rooted, F.concat(origin, link))
        .otherwise(_join_urls(base, F.when(~full & ~rooted & (link != ""), link)))
    )


def mime_type(value: str | Column) -> Column:
    return F.lower(F.trim(F.split_part(lit_or_col(value), F.lit(";"), F.lit(1))))


def note_url(url: str | Column) -> Column:
    """Canonical address of a community post."""

    post = F.regexp_extract(url_path(url), r"(?:search_result|explore)/([^/?]+)", 1)
    return F.when(post != "", F.concat(F.lit("https://www.xiaohongshu.com/explore/"), post))


def with_query(url: str | Column, **updates: Column | str | int) -> Column:
    """Set query parameters, keeping the others in place."""

    url = lit_or_col(url)
    base = F.regexp_extract(url, "^([^?#]*)", 1)
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    pairs = F.filter(F.split(url_query(url), "&"), lambda x: x != "")
    for key, value in updates.items():
        value = value if isinstance(value, Column) else F.lit(str(value))
        entry = F.concat(F.lit(f"{key}="), value)
        there = F.exists(pairs, lambda x: F.split_part(x, F.lit("="), F.lit(1)) == key)
        pairs = F.when(
            there,
            F.transform(pairs, lambda x: F.when(F.split_part(x, F.lit("="), F.lit(1)) == key, entry).otherwise(x)),
        ).otherwise(F.concat(pairs, F.array(entry)))
    return F.concat(base, F.lit("?"), F.array_join(pairs, "&"), fragment)


def is_sitemap_url(url: str | Column) -> Column:
    path = F.lower(url_path(url))
    return F.exists(F.array(*[F.lit(m) for m in d.SITEMAP_MARKERS]), lambda m: F.contains(path, m))


def is_feed_url(url: str | Column) -> Column:
    path = F.lower(url_path(url))
    return F.exists(F.array(*[F.lit(m) for m in d.FEED_MARKERS]), lambda m: F.contains(path, m))


def bounded_rank(text: str | Column, highest: int = 99) -> Column:
    digits = F.regexp_extract(single_spaced(text), r"(?<!\d)(\d{1,3})(?!\d)", 1)
    number = digits.try_cast("int")
    return F.when(number.between(1, highest), number)


def official_homepage(link: str | Column, base: str, own_hosts: list[str]) -> Column:
    """A homepage link; links back to the list's own hosts are not a company site."""

    url = absolute_url(single_spaced(link), F.lit(base))
    return F.when(is_web_url(url) & ~url_host(url).isin(*own_hosts), url)
