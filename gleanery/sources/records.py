"""Record mapping: feed rows of many shapes to one posting schema.

A feed shape is a ``FeedSpec``: field names to try, in order. ``map_feed`` turns VARIANT items joined with their
source row into postings; only the few feeds with rules of their own need more than a spec.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import defaults as d
from gleanery.functions import dates, rules, urls
from gleanery.functions.locations import LOCATION_TYPE, rename_location_fields
from gleanery.functions.text import let
from gleanery.sources.envelopes import ROWS, fields_of, first_field, first_variant, is_array, is_object, list_of, path, texts


@dataclass(frozen=True)
class FeedSpec:
    """Alias lists of one feed shape. ``place`` and ``demands`` may point at text, lists or objects."""

    apply: Sequence[str]
    title: Sequence[str]
    place: Sequence[str]
    description: Sequence[str]
    demands: Sequence[str]
    job_id: Sequence[str]
    published: Sequence[str]
    place_in: str | None = None
    listed_flag: str | None = None
    board_path: str | None = None
    place_parts: Sequence[str] = field(default=("name", "text", "displayName"))


# --- fixed values: field names of each feed shape --------------------------------------------------------
FEEDS: dict[str, FeedSpec] = {
    "greenhouse": FeedSpec(
        ["absolute_url", "url"], ["title", "name"], ["location"], ["content", "description"], ["requirements"],
        ["id", "job_id"], ["published_at", "publishedAt", "created_at", "createdAt"]),
    "lever": FeedSpec(
        ["hostedUrl", "applyUrl", "absolute_url", "url"], ["text", "title"], ["location", "workplaceType"],
        ["descriptionPlain", "description"], ["lists", "requirements"], ["id"], ["createdAt", "updatedAt"],
        place_in="categories"),
    "workday": FeedSpec(
        ["externalUrl", "externalPath", "applyUrl"], ["title"], ["locationsText", "location"],
        ["jobDescription", "description"], ["qualifications", "requirements"], ["jobReqId", "id", "bulletFields"],
        ["postedOn", "updatedOn"]),
    "feed": FeedSpec(
        ["url", "applyUrl", "hostedUrl"], ["title", "name"], ["location", "locations"],
        ["description", "summary", "descriptionHtml"], ["requirements", "qualifications"], ["id", "guid"],
        ["publishedAt", "datePosted", "createdAt"]),
    "ashby": FeedSpec(
        ["applyUrl", "jobUrl", "url"], ["title", "name"], ["location", "locations"],
        ["descriptionHtml", "description", "descriptionPlain"], ["requirements", "qualifications"],
        ["jobPostingId", "id", "slug"], ["publishedAt", "datePosted"], listed_flag="isListed"),
    "workable": FeedSpec(
        ["url", "application_url"], ["title", "job_title"], ["location", "city"], ["description", "descriptionPlain"],
        ["requirements", "education"], ["id", "shortcode"], ["published", "created_at"], board_path="shortcode"),
    "smartrecruiters": FeedSpec(
        ["ref", "url", "jobAdUrl", "applyUrl"], ["name", "title", "jobTitle"], ["location", "locations"],
        ["jobAd", "description", "jobDescription"], ["requirements", "qualifications"], ["id", "uuid", "refNumber"],
        ["releasedDate", "publishedAt", "datePosted"], place_parts=("city", "region", "country", "name")),
    "public_ats": FeedSpec(
        ["applyUrl", "applicationUrl", "url", "jobUrl", "absolute_url", "hostedUrl", "detailUrl", "externalUrl"],
        ["title", "name", "jobTitle", "jobName", "text"], ["location", "locations", "locationsText", "city"],
        ["description", "descriptionHtml", "descriptionPlain", "jobDescription", "content"],
        ["requirements", "qualifications", "education"], ["id", "uuid", "jobId", "job_id", "requisitionId", "slug"],
        ["publishedAt", "datePosted", "postedAt", "createdAt", "releasedDate"]),
    "beisen": FeedSpec(
        ["applyUrl", "url", "detailUrl"], ["jobName", "jobTitle", "title", "name"], ["cityName", "city", "location"],
        ["jobDescription", "description"], ["qualification", "requirements"], ["jobId", "id"],
        ["publishTime", "publishDate", "createdAt"]),
    "jsonld": FeedSpec(
        ["url", "sameAs"], ["title", "name"], ["jobLocation"], ["description", "responsibilities"],
        ["qualifications", "educationRequirements", "experienceRequirements"], ["identifier"], ["datePosted"]),
}
CONTEXT_FIELDS = [
    "title", "name", "job_title", "jobTitle", "description", "descriptionPlain", "descriptionHtml", "jobDescription",
    "locationsText", "location", "locations", "employmentType", "recruitmentType", "category", "department", "team",
    "bulletFields", "qualifications", "requirements", "categories", "publishedAt", "datePosted", "postedAt",
]
FEED_ID_FIELDS = ["id", "job_id", "jobId", "jobPostingId", "requisitionId", "requisition_id", "gh_jid"]
FEED_TITLE_FIELDS = ["title", "name", "job_title", "jobTitle"]
PLACE_FALLBACK = ["city", "state", "region", "country", "addressLocality", "addressRegion"]
ADDRESS_FIELDS = ["streetAddress", "addressLocality", "addressRegion", "addressCountry"]
# adapter name -> feed shape
ADAPTER_SHAPES = {
    "greenhouse": "greenhouse", "greenhouse_campus": "greenhouse", "lever": "lever", "lever_campus": "lever",
    "workday": "workday", "workday_campus": "workday", "ashby": "ashby", "ashby_campus": "ashby", "workable": "workable",
    "workable_campus": "workable", "smartrecruiters": "smartrecruiters", "smartrecruiters_campus": "smartrecruiters",
    "teamtailor": "feed", "recruitee": "feed", "successfactors": "feed", "personio": "feed", "rss": "feed",
    "atom": "feed", "xml": "feed", "feed": "feed", "bamboohr": "public_ats", "bamboohr_campus": "public_ats",
    "breezy": "public_ats", "breezy_campus": "public_ats", "oracle": "public_ats", "oracle_campus": "public_ats",
    "icims": "public_ats", "icims_campus": "public_ats", "beisen": "beisen", "beisen_campus": "beisen",
    "beisen_modern": "beisen", "beisen_bsglobal": "beisen", "beisen_legacy": "beisen", "beisen_campus_legacy": "beisen",
    "italent": "beisen", "wecruit": "beisen", "jsonld": "jsonld", "json_ld": "jsonld", "jobposting": "jsonld",
    "structured_html": "jsonld", "baidu": "baidu", "jd": "jd", "feishu": "feishu", "tencent": "tencent",
    "tencent_json": "tencent", "json": "generic", "json_api": "generic", "successfactors_json": "generic",
}
# target -> (aliases, default) for plain JSON feeds
GENERIC_FIELDS: dict[str, tuple[list[str], str | None]] = {
    "title": (["title", "job_title", "jobTitle"], ""),
    "role_category": (["role_category", "roleCategory", "category"], d.OTHER_ROLE),
    "company_industry": (["company_industry", "companyIndustry"], d.UNKNOWN),
    "company_type": (["company_type", "companyType"], d.UNKNOWN),
    "company_scale": (["company_scale", "companyScale"], d.UNKNOWN),
    "cohort": (["cohort", "graduationYear", "graduateYear"], d.UNKNOWN),
    "batch": (["batch", "recruitmentBatch"], d.UNKNOWN),
    "education": (["education", "educationRequirement", "degree"], d.UNKNOWN),
    "description": (["description", "jobDescription", "detail"], ""),
    "publish_date_source": (["publish_date_source", "publishDateSource"], "UNKNOWN"),
    "apply_url": (["apply_url", "applyUrl", "applicationUrl", "url", "jobUrl"], None),
    "campaign_id": (["campaign_id", "campaignId"], None),
    "campaign_name": (["campaign_name", "campaignName"], None),
}
GENERIC_DATES = {
    "publish_date": ["publish_date", "publishDate", "postedAt"],
    "deadline": ["deadline", "closingDate", "applicationDeadline"],
    "campaign_open_date": ["campaign_open_date", "campaignOpenDate", "openDate"],
    "campaign_deadline": ["campaign_deadline", "campaignDeadline"],
}
GENERIC_LISTS = {
    "major_tags": ["major_tags", "majorTags", "majors"],
    "skills": ["skills", "keywords", "tags"],
    "requirements": ["requirements", "qualifications", "requirementsText"],
}


def map_record(df: DataFrame, spec: Mapping[str, Sequence[str | Column]], keep: Sequence[str] = (),
               defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Target column -> ordered candidates (column names or expressions); the first non-blank one wins."""

    defaults = defaults or {}
    out = []
    for target, candidates in spec.items():
        tried = [F.col(c) if isinstance(c, str) else c for c in candidates]
        values = [F.when(F.trim(c.cast("string")) != "", c) for c in tried]
        if target in defaults:
            values.append(F.lit(defaults[target]))
        out.append(F.coalesce(*values).alias(target))
    return df.select(*keep, *out)


# --- pieces of an item -----------------------------------------------------------------------------------

def as_texts(value: Column) -> Column:
    """Text, list or object to an array of its texts."""

    word = lambda v: F.try_variant_get(v, "$", "string")
    got = F.coalesce(F.transform(list_of(value), word), F.transform(F.map_values(fields_of(value)), word), F.array(word(value)))
    return F.filter(got, lambda t: t.isNotNull())


def context_text(item: Column) -> Column:
    """All wording of an item that may carry cohort, batch, degree or scope (P5)."""

    return let(fields_of(item), lambda m: F.array_join(F.flatten(F.transform(texts(CONTEXT_FIELDS), lambda k: as_texts(F.try_element_at(m, k)))), " "))


def place_text(value: Column, parts: Sequence[str] = ("name", "text", "displayName")) -> Column:
    """Place of an item as text: an object gives its name or its address parts, a list is joined."""

    def of_object(v):
        joined = F.array_join(F.array_compact(F.array(*[F.nullif(F.trim(first_field(v, k)), F.lit("")) for k in PLACE_FALLBACK])), "、")
        return F.coalesce(first_field(v, *parts), F.nullif(joined, F.lit("")))

    def of_entry(v):
        text = F.try_variant_get(v, "$", "string")
        return F.trim(F.when(is_object(v), F.coalesce(first_field(v, "name", "text"), text)).otherwise(text))

    def read(v):
        listed = F.array_join(F.filter(F.transform(list_of(v), of_entry), lambda t: t != ""), "、")
        text = F.when(is_array(v), listed).when(is_object(v), of_object(v)).otherwise(F.try_variant_get(v, "$", "string"))
        return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(d.UNKNOWN))

    return let(value, read)


def address_text(value: Column) -> Column:
    """JSON-LD ``jobLocation`` to text: address parts joined, several places listed."""

    def one(v):
        address = F.coalesce(F.try_variant_get(v, "$.address", "variant"), v)
        address = F.when(is_object(address), address).otherwise(v)
        parts = F.array_compact(F.array(*[first_field(address, k) for k in ADDRESS_FIELDS]))
        return F.when(is_object(v), F.array_join(parts, " · ")).otherwise(F.try_variant_get(v, "$", "string"))

    places = F.when(is_array(value), F.try_variant_get(value, "$", ROWS)).otherwise(F.array(value))
    listed = F.array_join(F.filter(F.transform(F.filter(places, lambda v: v.isNotNull()), one), lambda t: t != ""), "、")
    return F.coalesce(F.nullif(listed, F.lit("")), F.lit(d.UNKNOWN))


def text_list(value: Column) -> Column:
    return let(value, lambda v: F.filter(F.transform(as_texts(v), lambda t: F.trim(t)), lambda t: t != ""))


def campaign_name(cohort: Column, batch: Column, fallback: Column | str = "校园招聘") -> Column:
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(cohort != d.UNKNOWN, F.concat(cohort, F.lit("届"), batch)).otherwise(fallback)


def _source_fields() -> list[Column]:
    """Columns every posting takes from its source row."""

    evidence = F.coalesce(F.col("evidence_urls"), F.array().cast("array<string>"))
    return [
        F.col("source_id"), F.col("company_id"), F.concat(F.col("company_name"), F.lit("官方校招来源")).alias("source_name"),
        F.col("source_level"), F.concat(F.array("source_url"), evidence).alias("source_evidence"),
    ]


def _posting(item_columns: dict[str, Column]) -> list[Column]:
    """All posting columns, unknowns and empties filled in."""

    texts = F.array().cast("array<string>")
    base: dict[str, Column] = {
        "source_job_id": F.lit(None).cast("string"), "company_name": F.col("company_name"), "title": F.lit(""),
        "city": F.lit(d.UNKNOWN), "locations": F.array().cast(f"array<{LOCATION_TYPE}>"), "role_category": F.lit(d.OTHER_ROLE),
        "company_industry": F.lit(d.UNKNOWN), "company_type": F.lit(d.UNKNOWN), "company_scale": F.lit(d.UNKNOWN),
        "cohort": F.lit(d.UNKNOWN), "batch": F.lit(d.UNKNOWN), "education": F.lit(d.UNKNOWN), "major_tags": texts,
        "skills": texts, "description": F.lit(""), "requirements": texts, "publish_date": F.lit(None).cast("date"),
        "publish_date_source": F.lit("UNKNOWN"), "deadline": F.lit(None).cast("date"), "apply_url": F.lit(None).cast("string"),
        "source_url": F.col("source_url"), "is_campus": F.lit(True), "campaign_id": F.lit(None).cast("string"),
        "campaign_name": F.lit(None).cast("string"), "campaign_open_date": F.lit(None).cast("date"),
        "campaign_deadline": F.lit(None).cast("date"), "campaign_official_url": F.col("source_url"),
    }
    base.update(item_columns)
    return [c.alias(n) for n, c in base.items()] + _source_fields()


def feed_rows_allowed(df: DataFrame, item: str = "item", context: Column | None = None) -> Column:
    """Combined feed filter for the shared shapes: allow-lists, then scope words in the item's wording."""

    it = F.col(item)
    ids = F.array_compact(F.array(*[first_field(it, k) for k in FEED_ID_FIELDS]))
    return rules.feed_row_allowed(ids, first_field(it, *FEED_TITLE_FIELDS), context_text(it) if context is None else context, _list("allowed_job_ids"),
                                  _list("allowed_title_markers"), _list("campus_markers"))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def map_feed(df: DataFrame, shape: str, item: str = "item", keep: Sequence[str] = ()) -> DataFrame:
    """Items of one shared shape to postings (P4). Rows without an apply URL come out with a NULL one: see ``split_rejects``.

    ``keep`` names columns to carry along.
    """

    spec, it = FEEDS[shape], F.col(item)
    holder = F.try_variant_get(it, path(spec.place_in), "variant") if spec.place_in else it
    if shape == "jsonld":
        place = address_text(F.try_variant_get(it, "$.jobLocation", "variant"))
    else:
        value = first_variant(holder, *spec.place[:1])
        rest = first_variant(it, *spec.place[1:]) if len(spec.place) > 1 else None
        value = F.coalesce(value, rest) if rest is not None else value
        place = place_text(value, spec.place_parts)
    link = first_field(it, *spec.apply)
    if spec.board_path:
        code = first_field(it, spec.board_path)
        board = F.concat(F.regexp_replace("source_url", "/+$", ""), F.lit("/j/"), code)
        link = F.coalesce(link, board)
    if shape == "jsonld":
        link = F.coalesce(link, F.col("source_url"))
    job_id = first_field(it, *spec.job_id)
    if shape == "workday":
        job_id = F.coalesce(first_field(it, "jobReqId", "id"), F.try_variant_get(it, "$.bulletFields[0]", "string"))
    if shape == "jsonld":
        identifier = F.try_variant_get(it, "$.identifier", "variant")
        job_id = F.when(is_object(identifier), first_field(identifier, "value")).otherwise(first_field(it, "identifier"))
    rows = df.withColumn("_context", context_text(it)).filter(feed_rows_allowed(df, item, F.col("_context")))
    if spec.listed_flag:
        rows = rows.filter(~F.try_variant_get(it, path(spec.listed_flag), "boolean").eqNullSafe(F.lit(False)))
    rows = rows.withColumn("_title", F.trim(F.coalesce(first_field(it, *spec.title), F.lit(""))))
    cohort, batch = rules.cohort("_context", F.col("current_cohort_signal")), rules.batch("_context")
    rows = rows.withColumn("_cohort", cohort).withColumn("_batch", batch)
    published = dates.official_date(first_field(it, *spec.published))
    return rows.select(*keep, *_posting({
        "source_job_id": F.trim(job_id), "title": F.col("_title"), "city": place,
        "role_category": rules.feed_role_category("_title"), "cohort": F.col("_cohort"), "batch": F.col("_batch"),
        "education": rules.education("_context"), "description": F.trim(F.coalesce(first_field(it, *spec.description), F.lit(""))),
        "requirements": text_list(first_variant(it, *spec.demands)), "publish_date": published,
        "publish_date_source": F.when(published.isNotNull(), F.lit("OFFICIAL")).otherwise(F.lit("UNKNOWN")),
        "deadline": dates.prefix_date(first_field(it, "deadline", "closingDate", "applicationDeadline")),
        "apply_url": urls.absolute_url(link, F.coalesce(F.col("endpoint"), F.col("source_url"))),
        "campaign_id": F.concat_ws(":", "company_id", "_cohort", "_batch"),
        "campaign_name": campaign_name(F.col("_cohort"), F.col("_batch")),
    }))


def map_generic(df: DataFrame, item: str = "item") -> DataFrame:
    """Plain JSON postings under their common field names (P2). Facts that are missing stay unknown."""

    it = F.col(item)
    columns = {t: F.coalesce(first_field(it, *keys), F.lit(default).cast("string")) for t, (keys, default) in GENERIC_FIELDS.items()}
    columns.update({t: first_field(it, *keys).try_cast("date") for t, keys in GENERIC_DATES.items()})
    columns.update({t: text_list(first_variant(it, *keys)) for t, keys in GENERIC_LISTS.items()})
    city = first_variant(it, "city", "location", "workCity")
    nested = is_array(city) | is_object(city)
    places = F.coalesce(first_variant(it, "locations", "jobLocations"), F.when(nested, city))
    listed = F.when(is_array(places), F.try_variant_get(places, "$", ROWS)).when(places.isNotNull(), F.array(places))
    source_url = F.coalesce(first_field(it, "source_url", "sourceUrl"), F.col("source_url"))
    columns.update({
        "source_job_id": first_field(it, "source_job_id", "sourceJobId", "job_id", "jobId", "id"),
        "company_name": F.coalesce(first_field(it, "company_name", "companyName"), F.col("company_name")),
        "city": F.coalesce(F.when(~nested, F.try_variant_get(city, "$", "string")), F.lit(d.UNKNOWN)),
        "locations": F.coalesce(rename_location_fields(listed), F.array().cast(f"array<{LOCATION_TYPE}>")),
        "source_url": source_url,
        "is_campus": F.coalesce(*[F.try_variant_get(it, path(k), "boolean") for k in ("is_campus", "isCampus", "campus")]),
        "campaign_official_url": F.coalesce(first_field(it, "campaign_official_url", "campaignOfficialUrl"), source_url),
    })
    return df.select(*_posting(columns))


def map_tencent(df: DataFrame, item: str = "item") -> DataFrame:
    """Tencent shape (P3): http links of its own site become https; an update time is never a publish date."""

    it = F.col(item)
    lines = F.array_compact(F.array(first_field(it, "Responsibility", "responsibility"), first_field(it, "Requirement", "requirement")))
    return df.select(*_posting({
        "source_job_id": first_field(it, "PostId", "postId", "id"),
        "title": F.coalesce(first_field(it, "RecruitPostName", "title"), F.lit("")),
        "city": F.coalesce(first_field(it, "LocationName", "location", "city"), F.lit(d.UNKNOWN)),
        "role_category": F.coalesce(first_field(it, "CategoryName", "category", "BGName"), F.lit(d.OTHER_ROLE)),
        "description": F.array_join(lines, "\n"),
        "apply_url": F.regexp_replace(first_field(it, "PostURL", "url", "applyUrl"), r"^http://careers\.tencent\.com/", "https://careers.tencent.com/"),
        "campaign_official_url": F.lit(None).cast("string"),
    }))


def _text(it: Column, *keys: str) -> Column:
    return F.trim(F.coalesce(first_field(it, *keys), F.lit("")))


def _own_site(df: DataFrame, it: Column, *, job_id, title, city, category, context, degree, description, demand, published, url,
              batch: Column | None = None, name: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Shared tail of the three first-party portals."""

    rows = df.withColumn("_cohort", rules.cohort(context, F.col("current_cohort_signal"))).withColumn("_batch", batch if batch is not None else F.lit(d.UNKNOWN))
    plain = F.when(F.col("_cohort") != d.UNKNOWN, F.concat("_cohort", F.lit("届校园招聘"))).otherwise(F.lit("校园招聘"))
    return rows.select(*_posting({
        "source_job_id": F.nullif(job_id, F.lit("")), "title": title, "city": city, "role_category": category,
        "cohort": F.col("_cohort"), "batch": F.col("_batch"), "education": rules.education(degree), "description": description,
        "requirements": F.filter(F.array(demand), lambda x: x != ""), "publish_date": published,
        "publish_date_source": F.when(published.isNotNull(), F.lit("OFFICIAL")).otherwise(F.lit("UNKNOWN")),
        "apply_url": url, "source_url": url, "campaign_id": F.concat_ws(":", "company_id", "_cohort", "_batch"),
        "campaign_name": name(F.col("_cohort"), F.col("_batch")) if name else plain, "campaign_official_url": F.col("source_url"),
    }))


def map_baidu(df: DataFrame, item: str = "item") -> DataFrame:
    it = F.col(item)
    post_type = _text(it, "postType")
    wording = F.concat_ws(" ", _text(it, "name"), _text(it, "workContent"), _text(it, "serviceCondition"), _text(it, "projectType"))
    recruit, project = F.upper(_text(it, "recruitType")), _text(it, "projectType")
    rows = df.filter(
        ~rules.has_any(wording, d.FEED_SOCIAL_WORDS) & recruit.isin("", "GRADUATE")
        & ((project == "") | project.contains("校招") | (_text(it, "projectTypeCode") == "1"))
    )
    by_title = rules.feed_role_category(F.concat_ws(" ", _text(it, "name"), post_type))
    by_body = rules.feed_role_category(_text(it, "workContent"))
    category = (
        F.when(by_title != d.OTHER_ROLE, by_title).when(by_body != d.OTHER_ROLE, by_body)
        .when(post_type.contains("技术"), "软件研发").when(post_type.contains("产品"), "产品").when(post_type.contains("运营"), "运营")
        .when(post_type.rlike("职能|综合"), "职能综合").otherwise(d.OTHER_ROLE)
    )
    job_id = _text(it, "postId", "jobId")
    return _own_site(
        rows, it, job_id=job_id, title=_text(it, "name"), city=F.coalesce(first_field(it, "workPlace"), F.lit(d.UNKNOWN)), category=category,
        context=F.concat_ws(" ", wording, "note"), degree=F.concat_ws(" ", _text(it, "education"), _text(it, "serviceCondition")),
        description=_text(it, "workContent"), demand=_text(it, "serviceCondition"),
        published=dates.prefix_date(first_field(it, "publishDate")),
        url=F.concat(F.lit("https://talent.baidu.com/jobs/detail/GRADUATE/"), job_id))


def jd_cities(it: Column) -> Column:
    """Distinct last parts of the nested city fields, else of the item's own city."""

    last = lambda c: F.replace(F.try_element_at(F.split(F.trim(c), "-"), F.lit(-1)), F.lit("市"), F.lit(""))
    nested = F.transform(F.try_variant_get(it, "$.requirementVoList", ROWS), lambda r: last(F.try_variant_get(r, "$.workCity", "string")))
    cities = F.array_distinct(F.filter(nested, lambda c: c != ""))
    own = last(first_field(it, "workCity", "workAddress"))
    text = F.when(F.coalesce(F.size(cities), F.lit(0)) > 0, F.array_join(cities, "、")).otherwise(own)
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(d.UNKNOWN))


def map_jd(df: DataFrame, item: str = "item") -> DataFrame:
    it = F.col(item)
    direction = _text(it, "jobDirection")
    wording = F.concat_ws(" ", _text(it, "positionName"), _text(it, "workContent"), _text(it, "qualification"), direction)
    by_title, by_direction = rules.feed_role_category(_text(it, "positionName")), rules.feed_role_category(direction)
    category = (
        F.when(by_title != d.OTHER_ROLE, by_title).when(by_direction != d.OTHER_ROLE, by_direction)
        .when(direction.rlike("采销|物流|供应链"), "供应链/采购/物流").when(direction.contains("管理培训"), "职能综合").otherwise(d.OTHER_ROLE)
    )
    job_id = _text(it, "publishId", "reqId")
    return _own_site(
        df.filter(~rules.has_any(wording, d.FEED_SOCIAL_WORDS)), it, job_id=job_id, title=_text(it, "positionName"), city=jd_cities(it),
        category=category, context=F.concat_ws(" ", wording, "note"), degree=_text(it, "qualification"),
        description=_text(it, "workContent"), demand=_text(it, "qualification"), published=dates.epoch_date(first_field(it, "publishTime")),
        url=F.concat(F.lit("https://campus.jd.com/#/newDetails?publishId="), job_id))


def map_feishu(df: DataFrame, item: str = "item") -> DataFrame:
    it = F.col(item)
    at = lambda *keys: F.trim(F.coalesce(F.try_variant_get(it, path(*keys), "string"), F.lit("")))
    kind, parent = at("recruit_type", "id"), at("recruit_type", "parent", "id")
    kind_name = F.coalesce(F.nullif(at("recruit_type", "name"), F.lit("")), at("recruit_type", "i18n_name"))
    head = F.concat_ws(" ", _text(it, "title"), kind_name)
    campus_kind = kind.isin("201", "2")
    flag = rules.feed_scope_flag(head, _list("campus_markers"), F.col("campus_only"), F.coalesce(F.col("website_path"), F.lit("")))
    rows = df.filter(
        ~rules.has_any(head, d.FEED_SOCIAL_WORDS) & ((kind == "") | campus_kind | (parent == "2"))
        & ((parent == "") | (parent == "2") | campus_kind) & F.coalesce(flag, F.lit(True))
    )
    names = F.transform(F.try_variant_get(it, "$.city_list", ROWS), lambda c: F.trim(F.try_variant_get(c, "$.name", "string")))
    city = F.coalesce(F.nullif(F.array_join(F.filter(names, lambda n: n != ""), "、"), F.lit("")), F.lit(d.UNKNOWN))
    context = F.concat_ws(" ", _text(it, "title"), _text(it, "description"), _text(it, "requirement"), at("recruit_type", "name"), "note")
    host = F.coalesce(F.nullif(F.col("ats_host"), F.lit("")), urls.url_host("source_url"))
    site = F.coalesce(F.nullif(F.col("website_path"), F.lit("")), F.lit("campus"))
    url = F.concat(F.lit("https://"), host, F.lit("/"), site, F.lit("/position/"), _text(it, "id"), F.lit("/detail"))
    shown = F.coalesce(F.nullif(at("recruit_type", "name"), F.lit("")), F.lit("校园招聘"))
    return _own_site(
        rows, it, job_id=_text(it, "id"), title=_text(it, "title"), city=city,
        category=rules.feed_role_category(F.concat_ws(" ", _text(it, "title"), at("job_function", "name"))), context=context, degree=context,
        description=F.coalesce(first_field(it, "description"), F.lit("")), demand=F.coalesce(first_field(it, "requirement"), F.lit("")),
        published=dates.epoch_date(first_field(it, "publish_time")), url=url, batch=rules.batch(context),
        name=lambda cohort, batch: campaign_name(cohort, batch, shown))


OWN_MAPPERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "generic": map_generic, "tencent": map_tencent, "baidu": map_baidu, "jd": map_jd, "feishu": map_feishu,
}


def map_items(items: DataFrame, adapters: Sequence[str] | None = None, adapter: str = "adapter",
              custom: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Route landed items by their source's adapter and union the mapped postings. ``custom`` adds a user's own mappers."""

    wanted = adapters or list(ADAPTER_SHAPES)
    shapes: dict[str, list[str]] = {}
    for name in wanted:
        shapes.setdefault(ADAPTER_SHAPES[name], []).append(name)
    name = F.lower(F.col(adapter))
    parts = []
    for shape, names in shapes.items():
        rows = items.filter(name.isin(*names))
        parts.append(OWN_MAPPERS[shape](rows) if shape in OWN_MAPPERS else map_feed(rows, shape))
    for key, mapper in (custom or {}).items():
        parts.append(mapper(items.filter(name == key)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def split_rejects(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid postings, rejected rows with a reason): rejected rows are a table, never lost."""

    reason = F.when(F.col("apply_url").isNull(), "missing_apply_url").when(F.coalesce(F.col("title"), F.lit("")) == "", "missing_title")
    tagged = postings.withColumn("reject_reason", reason)
    return tagged.filter("reject_reason is null").drop("reject_reason"), tagged.filter("reject_reason is not null")
