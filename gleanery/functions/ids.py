"""Stable identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import clean_list, clean_text, lit_or_col, name_key, normalize_city


def short_hash(text: str | Column, length: int) -> Column:
    return F.substring(F.sha2(lit_or_col(text), 256), 1, length)


def candidate_id(name: str | Column) -> Column:
    return F.concat(F.lit("candidate-"), short_hash(name_key(name), 12))


def stock_candidate_id(code: Column, legal_name: Column, short_name: Column) -> Column:
    seed = F.concat_ws("|", F.coalesce(code, F.lit("")), name_key(F.coalesce(legal_name, F.lit(""))),
                       name_key(F.coalesce(short_name, F.lit(""))))
    return F.concat(F.lit("soes-"), short_hash(seed, 16))


def local_company_id(name: Column) -> Column:
    return F.concat(F.lit("local-"), short_hash(F.lower(F.trim(name)), 12))


def page_source_id(company_id: Column, url: Column) -> Column:
    return F.concat(company_id, F.lit("-"), short_hash(url, 12))


def stable_job_id(
    source_job_id: str | Column = "source_job_id",
    company_id: str | Column = "company_id",
    title: str | Column = "title",
    city: str | Column = "city",
    cohort: str | Column = "cohort",
    apply_url: str | Column = "apply_url",
) -> Column:
    """Company plus the source's own id; without one, a hash of five fields."""

    given, company = lit_or_col(source_job_id), lit_or_col(company_id)
    seed = F.lower(
        F.concat_ws("|", company, lit_or_col(title), normalize_city(city), lit_or_col(cohort),
                    F.regexp_replace(lit_or_col(apply_url), "/+$", ""))
    )
    tail = F.when(F.coalesce(given, F.lit("")) != "", F.trim(given)).otherwise(short_hash(seed, 16))
    return F.concat(company, F.lit(":"), tail)


def content_hash(
    title: str | Column = "title",
    description: str | Column = "description",
    requirements: str | Column = "requirements",
    deadline: str | Column = "deadline",
) -> Column:
    """Hash of the fields whose change counts as a changed posting."""

    lines = F.concat(
        F.array(F.coalesce(lit_or_col(title), F.lit("")), clean_text(F.coalesce(lit_or_col(description), F.lit("")))),
        clean_list(requirements),
        F.array(F.coalesce(lit_or_col(deadline).cast("string"), F.lit(""))),
    )
    return F.sha2(F.array_join(lines, "\n"), 256)


def detail_shard(job_id: str | Column, shards: int = 64) -> Column:
    """File-layout shard from the first two bytes of the id. Uneven by design: never shuffle by it."""

    head = F.conv(F.substring(F.hex(F.encode(lit_or_col(job_id), "utf-8")), 1, 4), 16, 10).cast("long")
    return F.lpad((head % shards).cast("string"), 2, "0")
