"""Dates, business days and freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery import defaults as d
from gleanery.functions.text import lit_or_col

MONTHS = "(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def epoch_date(value: str | Column) -> Column:
    """Epoch seconds or milliseconds (above 1e10) to a UTC date."""

    number = lit_or_col(value).cast("string").try_cast("double")
    seconds = F.when(number > 1e10, number / 1000).otherwise(number)
    return F.to_date(F.timestamp_seconds(seconds))


def _ymd(text: Column, pattern: str) -> Column:
    part = lambda i: F.regexp_extract(text, pattern, i)
    joined = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(text.rlike(pattern), F.to_date(F.try_to_timestamp(joined, F.lit("yyyy-MM-dd"))))


def prefix_date(text: str | Column) -> Column:
    """A 20xx date at the start of the text; anything else, or an impossible date, is NULL."""

    return _ymd(F.trim(lit_or_col(text).cast("string")), r"^(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})")


def date_in_text(text: str | Column) -> Column:
    """A year-month-day date anywhere in the text, dashed, slashed or with Chinese units."""

    return _ymd(lit_or_col(text).cast("string"), r"(\d{4})[年\-/](\d{1,2})[月\-/](\d{1,2})")


def feed_date(text: str | Column) -> Column:
    """ISO prefix, else an RFC-2822 date moved to UTC."""

    text = lit_or_col(text)
    pattern = r"(?i)(\d{1,2})\s+" + MONTHS[4:] + r"[a-z]*\s+(\d{4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?(?:\s+([+-]\d{4}|[A-Z]+))?"
    part = lambda i: F.regexp_extract(text, pattern, i)
    stamp = F.concat(
        part(3), F.lit("-"), F.initcap(F.lower(part(2))), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit(" "),
        F.lpad(F.coalesce(F.nullif(part(4), F.lit("")), F.lit("00")), 2, "0"), F.lit(":"),
        F.coalesce(F.nullif(part(5), F.lit("")), F.lit("00")), F.lit(":"),
        F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00")), F.lit(" "),
        F.when(part(7).rlike(r"^[+-]\d{4}$"), part(7)).otherwise(F.lit("+0000")),
    )
    parsed = F.when(text.rlike(pattern), F.try_to_timestamp(stamp, F.lit("yyyy-MMM-dd HH:mm:ss xx")))
    return F.coalesce(prefix_date(text), F.to_date(parsed))


def official_date(text: str | Column) -> Column:
    """Text date first, epoch date second: the order used for published dates."""

    return F.coalesce(prefix_date(text), epoch_date(text))


def business_date(stamp: str | Column, zone: str = d.BUSINESS_ZONE) -> Column:
    """Calendar date of a UTC time in the business zone."""

    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), lit_or_col(stamp).cast("timestamp_ntz")))


def business_date_of_text(text: str | Column, zone: str = d.BUSINESS_ZONE) -> Column:
    """Date-only text is already a business date; a timestamp is moved to the zone; other text keeps 10 characters."""

    text = lit_or_col(text)
    stamp = F.try_to_timestamp(text)
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
        .when(stamp.isNotNull(), F.date_format(business_date(stamp, zone), "yyyy-MM-dd"))
        .otherwise(F.substring(text, 1, 10))
    )


def days_from(value: str | Column, now: Column, zone: str = d.BUSINESS_ZONE) -> Column:
    """Calendar days from ``now`` to a UTC time, both read in the business zone."""

    return F.datediff(business_date(value, zone), business_date(now, zone))


def is_due_within(value: str | Column, now: Column, days: int = 7) -> Column:
    return F.coalesce(days_from(value, now).between(0, days), F.lit(False))


def is_overdue(value: str | Column, now: Column) -> Column:
    return F.coalesce(days_from(value, now) < 0, F.lit(False))


def is_within_next_days(value: str | Column, now: Column, days: int = 7) -> Column:
    """Within the next ``days`` x 24 hours, to the second."""

    gap = F.unix_micros(lit_or_col(value).cast("timestamp")) - F.unix_micros(now)
    return F.coalesce(gap.between(0, days * 86_400_000_000), F.lit(False))


def is_same_business_day(value: str | Column, now: Column) -> Column:
    return F.coalesce(days_from(value, now) == 0, F.lit(False))


def freshness_days(stamp: str | Column, now: Column) -> Column:
    micros = F.unix_micros(now) - F.unix_micros(lit_or_col(stamp).cast("timestamp"))
    return F.greatest(F.lit(0.0), micros / F.lit(86_400_000_000.0))


def catalog_version(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy.MM.dd.HHmm")


def display_date(text: str | Column, zone: str = d.BUSINESS_ZONE, empty: str = "未标注") -> Column:
    """Month/day for display; unreadable text keeps its first 10 characters, missing text shows a note."""

    text = lit_or_col(text)
    stamp = F.try_to_timestamp(text)
    return (
        F.when(text.isNull() | (text == ""), F.lit(empty))
        .when(stamp.isNotNull(), F.date_format(business_date(stamp, zone), "M/d"))
        .otherwise(F.substring(text, 1, 10))
    )


def display_datetime(text: str | Column, zone: str = d.BUSINESS_ZONE, empty: str = "未标注") -> Column:
    text = lit_or_col(text)
    stamp = F.try_to_timestamp(text)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), stamp.cast("timestamp_ntz"))
    return (
        F.when(text.isNull() | (text == ""), F.lit(empty))
        .when(stamp.isNotNull(), F.date_format(local, "M/d HH:mm"))
        .otherwise(F.replace(F.substring(text, 1, 16), F.lit("T"), F.lit(" ")))
    )
