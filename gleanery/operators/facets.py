"""Faceted search, preference match, grouped views and personal views (F17 to F20, F24, F31, J10, J19, J22, A19 to A21, O*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import defaults as d
from gleanery.functions.dates import is_due_within, is_overdue, is_same_business_day, is_within_next_days
from gleanery.functions.rules import reason_list
from gleanery.operators.dedup import top_with_more, union_later_wins
from gleanery.scale import keep_first, lookup_join


def any_of(column: str | Column, values: Sequence | None) -> Column:
    """OR inside one dimension; an empty choice passes everything."""

    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.isin(*values), F.lit(False)) if values else F.lit(True)


def matches_choices(choices: Mapping[str, Sequence | None]) -> Column:
    """AND across dimensions."""

    keep = F.lit(True)
    for name, values in choices.items():
        keep = keep & any_of(name, values)
    return keep


def in_range(column: str, low=None, high=None) -> Column:
    """Range test where a missing value fails as soon as a bound is set."""

    c = F.col(column)
    keep = F.lit(True)
    if low is not None:
        keep = keep & F.coalesce(c >= F.lit(low), F.lit(False))
    if high is not None:
        keep = keep & F.coalesce(c <= F.lit(high), F.lit(False))
    return keep


def text_match(columns: Sequence[str], query: str | None) -> Column:
    query = (query or "").strip().lower()
    if not query:
        return F.lit(True)
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query))


def facet_filter(df: DataFrame, choices: Mapping[str, Sequence | None] | None = None, ranges: Mapping[str, tuple] | None = None,
                 query: str | None = None, search: Sequence[str] = (), extra: Column | None = None) -> DataFrame:
    """Text search, choices, ranges and any further predicate (F19). Plain columns reach the scan as filters."""

    keep = matches_choices(choices or {})
    for name, (low, high) in (ranges or {}).items():
        keep = keep & in_range(name, low, high)
    keep = keep & text_match(search, query)
    return df.filter(keep if extra is None else keep & extra)


def matches_location(locations: str | Column, scopes: Sequence[str] = (), provinces: Sequence[str] = (), city_codes: Sequence[str] = (),
                     cities: Sequence[str] = (), countries: Sequence[str] = (), nationwide: str = "全国|大陆|不限") -> Column:
    """All place conditions on the same location; a nationwide place passes any region."""

    if not (scopes or provinces or city_codes or cities or countries):
        return F.lit(True)
    locations = F.col(locations) if isinstance(locations, str) else locations
    bare = lambda c: F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "市$", "")
    names = [c.strip().removesuffix("市") for c in cities]

    def fits(x):
        wide = F.coalesce(x["display_name"].rlike(nationwide), F.lit(False)) | F.coalesce(x["raw"].rlike(nationwide), F.lit(False))
        wide = wide & ((x["scope"] == "MAINLAND_CHINA") if scopes else F.lit(True))
        tail = F.try_element_at(F.split(x["city_code"], "-"), F.lit(-1))
        named = bare(x["display_name"]).isin(*names) | bare(x["raw"]).isin(*names) | bare(tail).isin(*names) if names else F.lit(True)
        here = any_of(x["province_code"], provinces) & any_of(x["city_code"], city_codes) & named
        return any_of(x["scope"], scopes) & any_of(x["country_code"], countries) & (wide | here)

    return F.coalesce(F.exists(locations, fits), F.lit(False))


def segment(company_focus: Column, authority: Column, radar: Column, fallback: Column) -> Column:
    """Segment of a company: focus list, authority list, seed list, then industry."""

    return F.coalesce(F.nullif(F.trim(F.coalesce(company_focus, authority, radar, fallback)), F.lit("")), F.lit(""))


def with_company(df: DataFrame, companies: DataFrame, key: str = "company_id") -> DataFrame:
    """Company columns for search and segment."""

    return lookup_join(df, companies, key, "left")


def match_reasons(checks: Sequence[tuple[Column, str | Column]], limit: int = 3) -> Column:
    """First reasons why a row fits the preferences."""

    return F.slice(reason_list(*checks), 1, limit)


def entry_status(job_count: Column, entry_type: Column) -> Column:
    """SYNCED with postings, else ENTRY_LEAD or OFFICIAL by entry type."""

    return F.when(job_count > 0, "SYNCED").when(entry_type == "ENTRY_LEAD", "ENTRY_LEAD").otherwise("OFFICIAL")


def matches_entry_status(job_count: Column, entry_type: Column, wanted: str = "") -> Column:
    status = entry_status(job_count, entry_type)
    if wanted == "SYNCED":
        return job_count > 0
    if wanted == "ENTRY_ONLY":
        return job_count == 0
    if wanted == "ENTRY_LEAD":
        return status == "ENTRY_LEAD"
    if wanted == "OFFICIAL":
        return status.isin("SYNCED", "OFFICIAL")
    return F.lit(True)


def sort_keys(mode: str = "publish", title: str = "title", company: str = "company_name", publish: str = "publish_date",
              deadline: str = "deadline", first_seen: str = "first_seen_at", matched: Column | None = None, seq: str = "id") -> list[Column]:
    """Sort orders of the list (O5). A missing deadline sorts last, a missing publish date too."""

    tail = [F.col(seq).asc()]
    newest = F.col(publish).desc_nulls_last()
    if mode == "deadline":
        return [F.col(deadline).asc_nulls_last(), newest, *tail]
    if mode == "company":
        return [in_chinese_order(company), *tail]
    if mode == "match" and matched is not None:
        return [matched.cast("int").desc(), newest, *tail]
    if mode == "open":
        return [F.col(first_seen).desc_nulls_last(), *tail]
    return [newest, F.col(title).asc(), *tail]


def in_chinese_order(column: str) -> Column:
    """Sort key in Chinese collation."""

    return F.collate(F.col(column), "zh").asc()


def grouped_page(df: DataFrame, group: str, order: Sequence[Column], n: int = 5) -> DataFrame:
    """Each company's first postings with a more flag."""

    return top_with_more(df, [group], order, n)


def without_jobs(companies: DataFrame, jobs: DataFrame, key: str = "company_id") -> DataFrame:
    """Companies no posting belongs to."""

    return companies.join(jobs.select(key).distinct(), key, "left_anti")


def set_difference_count(base: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """True difference of key sets, as a count (U4)."""

    left = base.select(key).distinct()
    for other in others:
        left = left.join(other.select(key), key, "left_anti")
    return left.agg(F.count("*").alias("remaining"))


def shown_jobs(formal: DataFrame, provisional: DataFrame, seq: Sequence[str], key: str = "id", show_provisional: bool = True) -> DataFrame:
    """Formal postings, then provisional ones in place of the same id."""

    return union_later_wins([key], seq, formal, provisional) if show_provisional else formal


def local_jobs(states: DataFrame, jobs: DataFrame, columns: Sequence[str], key: str = "job_id") -> DataFrame:
    """Tracked rows with the current posting, or the stored snapshot when the posting is gone."""

    now = jobs.select(F.col("id").alias(key), F.lit(True).alias("_live"), *[F.col(c).alias(f"_j_{c}") for c in columns])
    joined = states.join(now, key, "left")
    live = F.col("_live").isNotNull()
    picked = {c: F.when(live, F.col(f"_j_{c}")).otherwise(F.col(c)).alias(c) for c in columns}
    rest = [c for c in states.columns if c not in columns]
    return joined.select(*rest, *picked.values(), live.alias("is_current"), F.when(live, "ACTIVE").otherwise("CLOSED").alias("job_status"))


def tracked_rows(states: DataFrame, query: str | None = None, stage: str | None = None, search: Sequence[str] = ("company_name", "title", "city")) -> DataFrame:
    """Progress list by text and stage."""

    return facet_filter(states, {"stage": [stage] if stage else None}, query=query, search=search)


def schedule_flags(events: DataFrame, now: Column, stamp: str = "scheduled_at", done: str = "completed") -> DataFrame:
    """Today, next seven days, overdue and open."""

    return (
        events.filter(F.col(stamp).isNotNull()).withColumn("is_today", is_same_business_day(stamp, now))
        .withColumn("in_week", is_within_next_days(stamp, now, 7)).withColumn("is_overdue", is_overdue(stamp, now) & ~F.col(done))
    )


def next_actions(events: DataFrame, n: int = 5, stamp: str = "scheduled_at", done: str = "completed", seq: str = "id") -> DataFrame:
    """Next open events by time."""

    return events.filter(F.col(stamp).isNotNull() & ~F.col(done)).orderBy(F.col(stamp).asc(), F.col(seq).asc()).limit(n)


def fixed_class_counts(df: DataFrame, column: str, classes: Sequence[str], count: str = "rows") -> DataFrame:
    """Counts for a fixed list of classes, zeros kept."""

    counted = df.filter(F.col(column).isin(*classes)).groupBy(column).agg(F.count("*").alias("_n"))
    listed = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], f"{column} string, class_no int")
    return F.broadcast(listed).join(counted, column, "left").select(column, "class_no", F.coalesce("_n", F.lit(0)).cast("bigint").alias(count))


def option_values(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Distinct non-blank values of a facet."""

    rows = df if where is None else df.filter(where)
    return rows.select(column).filter(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").distinct()


def city_options(jobs: DataFrame, locations: str = "locations", scope: str | None = None, country: str | None = None,
                 provinces: Sequence[str] = (), seq: str = "id") -> DataFrame:
    """City code and label choices, limited by what is already chosen (A20). The last label of a code is shown."""

    rows = jobs.select(seq, F.posexplode(locations).alias("_pos", "x")).select(seq, "_pos", "x.*")
    wide = F.concat_ws(" ", "display_name", "raw").contains("全国")
    keep = any_of("scope", [scope] if scope else None) & any_of("country_code", [country] if country else None) & any_of("province_code", provinces)
    rows = rows.filter(keep & ~wide & F.col("city_code").isNotNull() & (F.coalesce("display_name", F.lit("")) != ""))
    return keep_first(rows, ["city_code"], [F.col(seq).desc(), F.col("_pos").desc()]).select(F.col("city_code").alias("value"), F.col("display_name").alias("label"))


def overview(jobs: DataFrame, now: Column, last_visit: Column, matched: Column, first_seen: str = "first_seen_at", deadline: str = "deadline") -> DataFrame:
    """Counters above the list."""

    return jobs.agg(
        F.count_if(F.col(first_seen) > last_visit).alias("new_since_visit"), F.count_if(is_due_within(deadline, now)).alias("due_soon"),
        F.count_if(matched).alias("matched"), F.count("*").alias("shown"))


def tracked_count(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if(~F.col("stage").isin(*d.UNTRACKED_STAGES)).alias("active_tracked"))


def recent_leads(leads: DataFrame, n: int = 24, stamp: str = "published_at", title: str = "title") -> DataFrame:
    """Newest leads, then by title."""

    return leads.orderBy(F.col(stamp).desc_nulls_last(), F.col(title).asc()).limit(n)
