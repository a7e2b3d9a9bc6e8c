"""Reading snapshots, registries, state and lists."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import defaults as d
from gleanery.functions import ids, urls
from gleanery.functions.dates import date_in_text
from gleanery.functions.rules import reason_list
from gleanery.functions.text import SPACE, blank_to_null, bounded_text, clean_list, clean_text, name_key, nfkc
from gleanery.operators.gates import GateFailed, dense_rank_check, exact_or_mixed
from gleanery.scale import keep_first, materialize
from gleanery.sources import envelopes

CORRUPT = "_corrupt_record"


# --- names -------------------------------------------------------------------------------------------

def snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def _renamed(kind: T.DataType, rename) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(rename(f.name), _renamed(f.dataType, rename), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_renamed(kind.elementType, rename), kind.containsNull)
    return kind


def rename_fields(df: DataFrame, style: str = "camel") -> DataFrame:
    """Rename every field, nested ones too, to camelCase or snake_case: a schema rewrite, no row is touched."""

    rename = camel if style == "camel" else snake
    return df.select(*[F.col(f"`{f.name}`").cast(_renamed(f.dataType, rename)).alias(rename(f.name)) for f in df.schema.fields])


# --- scans -------------------------------------------------------------------------------------------

def read_json_rows(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects) of a JSON snapshot; unreadable rows become ``invalid_raw`` reports."""

    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    # parsed once for both results; Spark also needs parsed rows at hand to answer on the corrupt-record column alone
    rows = materialize(spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multi_line).json(path))
    required = [f.name for f in schema.fields if not f.nullable]
    bad = F.col(CORRUPT).isNotNull()
    for name in required:
        bad = bad | F.col(name).isNull()
    good = rows.filter(~bad).drop(CORRUPT)
    rejects = rows.filter(bad).select(F.lit("invalid_raw").alias("reason"), F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*schema.names))).alias("record"))
    return good, rejects


def read_registry(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Registry rows with camelCase names folded to snake_case (S2). Columns come from the schema, none are inferred."""

    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    both = T.StructType([f for s in schema.fields for f in {s.name: s, camel(s.name): T.StructField(camel(s.name), s.dataType)}.values()])
    with_case = spark.read.schema(both).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return with_case.select(*[F.coalesce(F.col(s.name), F.col(camel(s.name))).alias(s.name) for s in schema.fields])


def key_violations(df: DataFrame, key: str, checks: Mapping[str, Column] | None = None) -> DataFrame:
    """Blank or repeated keys and failed row checks, one row each with the reason (S3)."""

    blank = F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == ""
    row_reasons = reason_list((blank, "blank_key"), *[(~F.coalesce(ok, F.lit(False)), name) for name, ok in (checks or {}).items()])
    rows = df.select(key, F.explode(row_reasons).alias("violation"))
    repeated = df.filter(~blank).groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key, F.lit("duplicate_key").alias("violation"))
    return rows.unionByName(repeated)


def focus_violations(focus: DataFrame) -> DataFrame:
    """Rules of the focus list: unique company, priority 0 to 2, a segment (S3)."""

    return key_violations(focus, "company_id", {"priority_range": F.col("priority").isin(0, 1, 2), "empty_segment": F.trim("segment") != ""})


def require_ranked_list(rows: DataFrame, expected: int = 100, rank: str = "rank", name: str = "name", required: Sequence[str] = ("name", "province", "segment")) -> DataFrame:
    """The list itself if it is exactly ranks 1..expected with unique names; otherwise raise."""

    check = dense_rank_check(rows, rank, expected, name_key(name), required).select("valid", "reasons").first()
    if not check["valid"]:
        raise GateFailed("authority_list:" + ",".join(check["reasons"]))
    return rows


def require_pinned_seed(rows: DataFrame, key: str, pinned: Mapping[str, str], actual: Mapping[str, str], record_count: int, vocabulary: Mapping[str, Sequence[str]]) -> DataFrame:
    """A pinned seed: version fields as pinned, count as announced, unique keys, closed word lists."""

    for name, value in pinned.items():
        if actual.get(name) != value:
            raise GateFailed(f"seed_{name}_mismatch")
    if rows.count() != record_count:
        raise GateFailed("seed_record_count_mismatch")
    bad = key_violations(rows, key, {f"{c}_vocabulary": F.col(c).isin(*words) for c, words in vocabulary.items()}).limit(1).collect()
    if bad:
        raise GateFailed("seed_" + bad[0]["violation"])
    return rows


def _exists(spark: SparkSession, path: str) -> bool:
    """Is there anything to read? Asked through Spark, so any shared file system works."""

    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_state(spark: SparkSession, path: str | None, schema: T.StructType | str) -> DataFrame:
    """Earlier state, or an empty table when there is none yet."""

    if path and _exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_observations(spark: SparkSession, path: str | None, schema: T.StructType | str) -> DataFrame | None:
    """Entry observations: None when there is no state file, while an empty state is authoritative."""

    return spark.read.schema(schema).parquet(path) if path and _exists(spark, path) else None


# --- allow-list sanitizers -----------------------------------------------------------------------------

def _limited(columns: dict[str, Column], limits: Mapping[str, int]) -> list[Column]:
    """Text columns as they are, or to their limits; with limits, ``cut`` names the columns that were shortened."""

    out = [F.substring(c, 1, limits[n]).alias(n) if n in limits else c.alias(n) for n, c in columns.items()]
    if limits:
        long = [F.when(F.length(columns[n]) > size, F.lit(n)) for n, size in limits.items() if n in columns]
        out.append(F.array_compact(F.array(*long)).cast("array<string>").alias("cut"))
    return out


def sanitize_inbox(rows: DataFrame, imported_at: Column, limits: Mapping[str, int] = MappingProxyType({})) -> DataFrame:
    """Allow-listed inbox columns; rows without title, company or https link are dropped (P20).

    Texts are whole unless ``limits`` gives a column's length; then ``cut`` names the columns that lost text.
    """

    have = set(rows.columns)
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have], F.lit(None).cast("string"))
    apply = urls.https_url(pick("applyUrl", "url", "jobUrl"))
    out = rows.select(
        *_limited({
            "id": clean_text(F.coalesce(pick("id", "jobId"), apply)), "title": clean_text(pick("title", "jobTitle")), "company_name": clean_text(pick("companyName", "company")),
            "city": F.coalesce(F.nullif(clean_text(pick("city", "location")), F.lit("")), F.lit(d.UNKNOWN)), "description": clean_text(F.coalesce(pick("description"), F.lit(""))),
        }, limits),
        clean_list(F.coalesce(*[F.col(n) for n in ("requirements", "qualifications") if n in have], F.array().cast("array<string>"))).alias("requirements"),
        apply.alias("apply_url"), urls.https_url(F.coalesce(pick("sourceUrl", "careerUrl"), apply)).alias("source_url"),
        imported_at.alias("imported_at"), F.lit("USER_IMPORTED_LOCAL_INBOX").alias("source"), *(["seq"] if "seq" in have else []))
    return out.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("company_name", F.lit("")) != "") & F.col("apply_url").isNotNull() & F.col("source_url").isNotNull())


def inbox_postings(inbox: DataFrame) -> DataFrame:
    """Inbox rows as raw postings of a local, never verified source."""

    company = ids.local_company_id(F.col("company_name"))
    return inbox.select(
        F.concat(company, F.lit("-inbox")).alias("source_id"), F.col("id").alias("source_job_id"), company.alias("company_id"), "company_name", "title", "city",
        "description", "requirements", "apply_url", "source_url", F.lit("B").alias("source_level"), F.lit("TARGET").alias("source_status"),
        urls.url_host("apply_url").alias("apply_domain"), F.lit(True).alias("is_campus"))


def sanitize_leads(rows: DataFrame, fields: Sequence[str] = tuple(d.PUBLIC_LEAD_FIELDS), platform: str = d.LEAD_PLATFORM) -> DataFrame:
    """Only public lead columns; rows without id, title or link, or of another platform, are dropped."""

    kept = rows.select(*[c for c in fields if c in rows.columns])
    full = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    same = F.coalesce(F.col("sourcePlatform") == platform, F.lit(True)) if "sourcePlatform" in kept.columns else F.lit(True)
    return kept.filter(full("id") & full("title") & full("sourceUrl") & same)


def sanitize_observations(rows: DataFrame) -> DataFrame:
    """Typed, bounded and enum-checked observation columns; anything else is dropped (P22). ``company_id`` is the map key."""

    text = {"company_name": 200, "cohort": 32, "evidence_text": 320, "checked_at": 80, "last_checked_at": 80, "first_confirmed_at": 80, "error_type": 96, "last_error_type": 96, "content_type": 96}
    numbers = {"status_code": (100, 599), "bytes": (0, 100_000_000), "consecutive_failures": (0, 100)}
    have, out = set(rows.columns), [bounded_text("company_id", 160).alias("company_id")]
    out += [bounded_text(c, n).alias(c) for c, n in text.items() if c in have]
    out += [urls.safe_url(c).alias(c) for c in ("career_url", "evidence_url") if c in have]
    for c, words in (("directory_status", d.DIRECTORY_STATUSES), ("entry_type", d.ENTRY_TYPES)):
        if c in have:
            value = bounded_text(c, 40)
            out.append(F.when(value.isin(*words), value).alias(c))
    if "signals" in have:
        items = F.transform(F.slice("signals", 1, 32), lambda s: F.substring(F.trim(F.regexp_replace(s, SPACE, " ")), 1, 120))
        out.append(F.array_distinct(F.filter(items, lambda s: s != "")).alias("signals"))
    out += [F.col(c).cast("boolean").alias(c) for c in ("reachable", "blocked", "public") if c in have]
    for c, (low, high) in numbers.items():
        if c in have:
            number = F.col(c).cast("string").try_cast("int")
            out.append(F.when(number.between(low, high), number).alias(c))
    return rows.select(*out).filter("company_id is not null")


def upsert_inbox(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace earlier ones by id."""

    both = existing.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, ["id"], [F.col("_batch").desc(), F.col("imported_at").desc(), F.col("title").asc()]).drop("_batch")


def load_inbox(rows: DataFrame, imported_at: Column) -> DataFrame:
    """Sanitized inbox, first row per id (S16). ``rows`` carries its arrival order in ``seq``."""

    return keep_first(sanitize_inbox(rows, imported_at), ["id"], [F.col("seq").asc()])


# --- workbook and printed lists -----------------------------------------------------------------------

def header_columns(sheet: DataFrame, headers: Mapping[str, Sequence[str]] = d.WORKBOOK_HEADERS, fallback: Mapping[str, str] = d.WORKBOOK_FALLBACK_COLUMNS,
                   row: str = "row_no", head_rows: int = 3) -> dict[str, str]:
    """Field -> column by the aliases found in the first rows, else the fixed layout."""

    columns = [c for c in sheet.columns if c != row]
    head = sheet.filter(F.col(row) <= head_rows).orderBy(row).limit(head_rows).collect()  # at most three rows
    found: dict[str, str] = {}
    for field, names in headers.items():
        hit = next((c for r in head for c in columns if str(r[c] or "").strip() in names), None)
        found[field] = hit or fallback[field]
    return found


def workbook_rows(sheet: DataFrame, row: str = "row_no", head_rows: int = 3) -> DataFrame:
    """Typed rows below the header, blank rows dropped."""

    at = header_columns(sheet, row=row, head_rows=head_rows)
    get = lambda f: F.trim(nfkc(F.coalesce(F.col(at[f]).cast("string"), F.lit("")))) if at[f] in sheet.columns else F.lit("")
    cells = [c for c in sheet.columns if c != row]
    full = sheet.filter((F.col(row) > head_rows) & (F.trim(F.concat_ws("", *cells)) != ""))
    return full.select(
        row, urls.stock_code(get("stock_code")).alias("stock_code"), get("short_name").alias("short_name"), date_in_text(get("equity_as_of")).alias("equity_as_of"),
        get("equity_nature").alias("equity_nature"), get("legal_name").alias("legal_name"), F.nullif(get("homepage"), F.lit("")).alias("homepage_observed"),
        get("business").alias("business"), F.nullif(get("listing_state"), F.lit("")).alias("listing_state"))


def workbook_candidates(rows: DataFrame, row: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """(candidates, review queue): exact value kept, mixed value to review, others left out."""

    tagged = rows.withColumn("_kind", exact_or_mixed(F.col("equity_nature")))
    home = urls.homepage_candidates(F.col("homepage_observed"))
    reasons = F.array_distinct(F.concat(F.col("_home.reasons"), reason_list(
        (F.col("stock_code").isNull(), "stock_code_missing_or_invalid"), (F.col("legal_name") == "", "legal_name_missing"))))
    unnamed = F.lit("未命名企业")
    good = tagged.filter("_kind = 'exact'").withColumn("_home", home).select(
        row, ids.stock_candidate_id(F.col("stock_code"), F.col("legal_name"), F.col("short_name")).alias("candidate_id"), "stock_code",
        F.coalesce(F.nullif("short_name", F.lit("")), unnamed).alias("short_name"),
        F.coalesce(F.nullif("legal_name", F.lit("")), F.nullif("short_name", F.lit("")), unnamed).alias("legal_name"), "equity_nature", "equity_as_of", "listing_state",
        "homepage_observed", F.col("_home.candidates").alias("homepage_candidates"), reasons.alias("review_reasons"))
    good = good.withColumn("review_status", F.when(F.size("review_reasons") > 0, "NEEDS_REVIEW").otherwise("DISCOVERED"))
    review = tagged.filter("_kind = 'mixed'").select(row, "stock_code", "short_name", "legal_name", "equity_nature", F.lit("mixed_equity_nature_manual_review").alias("reason"))
    return good, review


def two_column_list(rows: DataFrame, seq: Sequence[str], base_url: str, own_hosts: Sequence[str], expected: int = 99) -> DataFrame:
    """A list printed as two (rank, name, link) blocks per row to one row per rank (S19). A row with a homepage wins.

    Input columns: rank_left, name_left, link_left, rank_right, name_right, link_right and the order columns.
    """

    long = rows.select(*seq, F.expr("stack(2, 0, rank_left, name_left, link_left, 1, rank_right, name_right, link_right) as (side, rank_text, name, homepage_observed)"))
    long = long.withColumn("rank", urls.bounded_rank("rank_text", expected)).withColumn("name", blank_to_null("name"))
    long = long.filter("rank is not null and name is not null").filter(~F.col("name").isin("企业(集团)名称", "企业集团名称"))
    long = long.withColumn("homepage", urls.official_homepage("homepage_observed", base_url, list(own_hosts)))
    kept = keep_first(long, ["rank"], [F.col("homepage").isNull().cast("int").asc(), *[F.col(c).asc() for c in seq], F.col("side").asc()])
    return kept.select(F.concat(F.lit("sasac-central-"), F.lpad(F.col("rank").cast("string"), 3, "0")).alias("group_id"), "rank", "name", "homepage", "homepage_observed",
                       F.col("homepage").isNull().alias("homepage_review_required"))


def directory_candidates(rows: DataFrame, authority: str, source_url: str, seq: Sequence[str]) -> DataFrame:
    """Directory names to candidate rows, first mention per name key (P31). ``rows`` has name, stock_codes and market."""

    named = rows.withColumn("normalized_name", name_key("name")).filter(F.length("normalized_name") >= 2)
    first = keep_first(named, ["normalized_name"], [F.col(c).asc() for c in seq])
    return first.select(
        ids.candidate_id("name").alias("candidate_id"), F.trim("name").alias("name"), "normalized_name", F.array(F.lit(authority)).alias("authority_ids"),
        F.array(F.lit(source_url)).alias("source_urls"), "stock_codes", F.col("market").alias("listing_market"), F.lit("DISCOVERED").alias("discovery_status"), *seq)


def directory_rows(bodies: DataFrame, body: str, keep: Sequence[str]) -> DataFrame:
    """Companies in stored directory payloads (P31): objects of known lists at any depth, their name, stock codes and market by alias.

    Rows without a name are left out; ``keep`` and ``row_no`` tell where a row came from.
    """

    items = bodies.select(*keep, F.posexplode(envelopes.all_directory_rows(F.try_parse_json(F.col(body)))).alias("row_no", "_item"))
    code = urls.stock_code(envelopes.first_field(F.col("_item"), *d.COMPANY_CODE_KEYS))
    rows = items.select(
        *keep, "row_no", envelopes.first_field(F.col("_item"), *d.COMPANY_NAME_KEYS).alias("name"), F.array_compact(F.array(code)).alias("stock_codes"),
        envelopes.first_field(F.col("_item"), *d.COMPANY_MARKET_KEYS).alias("market"))
    return rows.filter("name is not null")
