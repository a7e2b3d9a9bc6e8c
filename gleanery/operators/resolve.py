"""Entity resolution across registries.

A key shared by many rows on both sides never pairs them: the registry is first reduced to one row per key, holding
the smallest and largest id. "One company or several" only needs these two.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import defaults as d
from gleanery.functions.text import name_key, text_key
from gleanery.functions.urls import normalized_domain, stock_code
from gleanery.scale import bit_set, dealt, keep_first, lookup_join, materialize


def exploded_keys(df: DataFrame, row: Sequence[str], keys: dict[str, Column]) -> DataFrame:
    """(row, key_type, key) for every non-blank key. ``keys`` maps a type to an array column."""

    typed = F.array(*[F.struct(F.lit(t).alias("key_type"), k.alias("items")) for t, k in keys.items()])
    long = df.select(*row, F.explode(typed).alias("t")).select(*row, "t.key_type", F.explode("t.items").alias("key"))
    return long.filter(F.coalesce(F.col("key"), F.lit("")) != "").distinct()


def key_index(companies: DataFrame, keys: Column, company: str = "company_id", seq: str = "seq", prefer: str = "first") -> DataFrame:
    """One company per key: the first or the last one that lists it."""

    long = companies.select(company, seq, F.explode(keys).alias("key")).filter(F.coalesce(F.col("key"), F.lit("")) != "")
    order = F.col(seq).asc() if prefer == "first" else F.col(seq).desc()
    return keep_first(long, ["key"], [order, F.col(company).asc()]).select("key", F.col(company).alias("matched_company_id"))


def match_by_names(rows: DataFrame, row: str, keys: Column, index: DataFrame, companies: DataFrame | None = None,
                   canonical: str | None = None, company: str = "company_id") -> DataFrame:
    """Row -> company: explicit id first, else its name keys; one match counts, several are a conflict."""

    long = rows.select(row, F.explode(F.array_distinct(keys)).alias("key")).filter("key != ''")
    hits = lookup_join(long, index, "key", "inner")
    by_name = hits.groupBy(row).agg(F.min("matched_company_id").alias("_low"), F.max("matched_company_id").alias("_high"))
    out = rows.join(by_name, row, "left")
    low, high = F.col("_low"), F.col("_high")
    given = F.lit(None).cast("string")
    if canonical and companies is not None:
        known = companies.select(F.col(company).alias(canonical)).distinct().withColumn("_given", F.col(canonical))
        out = lookup_join(out, known, canonical, "left")
        given = F.col("_given")
    return (
        out.withColumn("matched_company_id", F.coalesce(given, F.when(low == high, low)))
        .withColumn("conflict", F.coalesce(given.isNull() & (low != high), F.lit(False)))
        .drop("_low", "_high", "_given")
    )


def authority_candidates(matched: DataFrame, rank: str = "rank", prefix: str = "candidate-isc-") -> DataFrame:
    """Candidate ids: the matched company's, else one from the rank. A later row with the same id gets its rank as suffix."""

    padded = F.lpad(F.col(rank).cast("string"), 3, "0")
    rows = matched.withColumn("candidate_id", F.coalesce(F.col("matched_company_id"), F.concat(F.lit(prefix), padded)))
    firsts = rows.groupBy("candidate_id").agg(F.min(rank).alias("_first"))
    rows = lookup_join(rows, firsts, "candidate_id", "left")
    again = F.col(rank) > F.col("_first")
    status = F.when(F.col("matched_company_id").isNotNull(), "MATCHED_REGISTRY").otherwise("DISCOVERED")
    return (
        rows.withColumn("discovery_status", status).withColumn("duplicate_candidate", again)
        .withColumn("candidate_id", F.when(again, F.concat(F.col("candidate_id"), F.lit("-"), padded)).otherwise(F.col("candidate_id")))
        .withColumn("matched_company_id", F.when(F.col("matched_company_id").isNotNull(), F.col("candidate_id")))
        .drop("_first")
    )


def authority_summary(candidates: DataFrame) -> DataFrame:
    """Counts of one authority merge."""

    found = F.col("matched_company_id").isNotNull()
    return candidates.agg(
        F.count("*").alias("authority_company_count"), F.count_if(found).alias("matched_registry_count"),
        F.count_if(~found).alias("new_candidate_count"),
        (F.count_if("conflict") + F.count_if("duplicate_candidate")).alias("conflict_count"),
    )


def match_first_key(rows: DataFrame, row: str, keys: Sequence[Column], index: DataFrame) -> DataFrame:
    """Row -> company by the first key, in the given order, that is listed."""

    typed = F.array(*[F.struct(F.lit(i).alias("n"), k.alias("key")) for i, k in enumerate(keys)])
    long = rows.select(row, F.explode(typed).alias("t")).select(row, "t.n", "t.key").filter("key != ''")
    hits = lookup_join(long, index, "key", "inner")
    best = hits.groupBy(row).agg(F.min(F.struct("n", "matched_company_id"))["matched_company_id"].alias("matched_company_id"))
    return rows.join(best, row, "left")


def match_identity(candidates: DataFrame, companies: DataFrame, candidate: str = "candidate_id", company: str = "company_id",
                   candidate_keys: dict[str, Column] | None = None, company_keys: dict[str, Column] | None = None) -> DataFrame:
    """Code, then exact name or alias, then domain; keys that point to different companies refuse the match."""

    left = exploded_keys(candidates, [candidate], candidate_keys or candidate_key_columns())
    right = exploded_keys(companies, [company], company_keys or company_key_columns())
    index = right.groupBy("key_type", "key").agg(F.min(company).alias("_low"), F.max(company).alias("_high"))
    hits = lookup_join(left, index, ["key_type", "key"], "inner")
    order = F.when(F.col("key_type") == "STOCK_CODE", 0).when(F.col("key_type") == "LEGAL_NAME_OR_ALIAS", 1).otherwise(2)
    found = hits.groupBy(candidate).agg(
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min(F.struct(order.alias("n"), "key_type"))["key_type"].alias("_method"))
    one = F.col("_low") == F.col("_high")
    return candidates.join(found, candidate, "left").select(
        *candidates.columns,
        F.when(one, F.col("_low")).alias("matched_company_id"),
        F.when(one, F.col("_method")).when(~one, F.lit("CONFLICT")).alias("match_method"),
    )


def identity_members(companies: DataFrame, company: str = "company_id", keys: dict[str, Column] | None = None) -> DataFrame:
    """Companies behind each key, for the review of conflicts: join a conflicting row's keys to it."""

    return exploded_keys(companies, [company], keys or company_key_columns())


def candidate_key_columns() -> dict[str, Column]:
    return {
        "STOCK_CODE": F.array(stock_code("stock_code")),
        "LEGAL_NAME_OR_ALIAS": F.array(name_key("legal_name"), name_key("short_name")),
        "OFFICIAL_DOMAIN": F.array(normalized_domain("homepage")),
    }


def company_key_columns() -> dict[str, Column]:
    from gleanery.functions.text import name_keys

    return {
        "STOCK_CODE": F.col("stock_codes"),
        "LEGAL_NAME_OR_ALIAS": name_keys(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))),
        "OFFICIAL_DOMAIN": F.array(normalized_domain("homepage")),
    }


def longest_alias(texts: DataFrame, row: str, text: str, aliases: DataFrame, company: str = "company_id", alias: str = "alias", seq: str = "seq",
                  tasks: int | None = None) -> DataFrame:
    """Longest alias found inside each text (J16, W12); ties go to the alias listed first.

    Rolling hashes give every position of a text the hash of any window from there. Aliases fall into tiers of 2^k to 2^(k+1) - 1
    characters. For each tier a fixed-size bit set of the aliases' first 2^k characters rules out nearly all positions, and a second one
    of whole aliases the windows that are none; only the rest, copies of aliases but for a few, leave the row and meet the aliases in an
    equi-join, which decides. Neither aliases nor texts are compared pair by pair, and a task holds one text at a time.
    """

    known = aliases.withColumn("key", text_key(alias)).filter(F.length("key") >= 2)
    known = materialize(keep_first(known.select("key", company, seq), ["key"], [F.col(seq).asc(), F.col(company).asc()]).withColumn("_len", F.length("key")))
    sizes = sorted(r["_len"] for r in known.select("_len").distinct().collect())  # no more than the longest alias has characters
    if not sizes:
        return texts.withColumns({"matched_alias": F.lit(None).cast("string"), "matched_company_id": F.lit(None).cast(aliases.schema[company].dataType)})
    index = WindowIndex.of(sizes)
    marks = known.select(_alias_marks(index)("key").alias("_m"))
    heads, whole = (bit_set(marks.select(F.col("_m")[i].alias("m")), "m", ALIAS_BITS) for i in (0, 1))
    spark = texts.sparkSession
    sets = spark.sparkContext.broadcast((heads, whole))
    found = dealt(texts.select(row, text), tasks).select(row, F.explode(_alias_windows(index, sets)(text_key(text))).alias("key"))
    hits = lookup_join(found, known, "key", "inner")
    best = keep_first(hits, [row], [F.col("_len").desc(), F.col(seq).asc()])
    return texts.join(best.select(row, F.col("key").alias("matched_alias"), F.col(company).alias("matched_company_id")), row, "left")


@dataclass(frozen=True)
class WindowIndex:
    """Hashes of all windows of a text. ``tiers``: a power of two and the alias sizes from it up to its double."""

    tiers: list[tuple[int, list[int]]]

    @classmethod
    def of(cls, sizes: list[int]) -> WindowIndex:
        heads = sorted({1 << (n.bit_length() - 1) for n in sizes})
        return cls([(h, [n for n in sizes if h <= n < 2 * h]) for h in heads])

    def sums(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of characters times powers of the base, and the powers that undo a start (all modulo 2^64)."""
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(chars * _powers(HASH_BASE, len(chars)), out=sums[1:])
        return sums, _powers(HASH_UNDO, len(chars) + 1)

    def marks(self, sums: np.ndarray, undo: np.ndarray, at: np.ndarray | None, size: int) -> np.ndarray:
        """Bits of the windows of ``size`` characters that begin at ``at``, or anywhere."""
        if at is None:
            n = max(0, len(sums) - size)
            mixed = sums[size:] - sums[:n]
            mixed *= undo[:n]
        else:
            mixed = (sums[at + size] - sums[at]) * undo[at]
        mixed += np.uint64(size)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed >>= np.uint64(64 - ALIAS_BITS.bit_length() + 1)
        return mixed.view(np.int64)


HASH_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
HASH_UNDO = pow(HASH_BASE, -1, 1 << 64)
ALIAS_BITS = 1 << 23


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def _alias_marks(index: WindowIndex):
    @F.pandas_udf("array<long>")
    def marks(keys: pd.Series) -> pd.Series:
        def of(key):
            sums, undo = index.sums(key)
            return [int(index.marks(sums, undo, np.zeros(1, np.int64), n)[0]) for n in (1 << (len(key).bit_length() - 1), len(key))]

        return keys.map(of)

    return marks


def _alias_windows(index: WindowIndex, sets):
    @F.pandas_udf("array<string>")
    def windows(texts: pd.Series) -> pd.Series:
        heads, whole = (np.frombuffer(b, np.uint8) for b in sets.value)
        has = lambda bits, marks: (bits[marks >> 3] >> (marks & 7).astype(np.uint8) & 1).astype(bool)

        def of(text):
            if not text:
                return []
            sums, undo = index.sums(text)
            out: set[str] = set()
            for head, sizes in index.tiers:
                at = np.flatnonzero(has(heads, index.marks(sums, undo, None, head)))
                for n in sizes if len(at) else ():
                    fits = at[at + n <= len(text)]
                    out.update(text[i: i + n] for i in fits[has(whole, index.marks(sums, undo, fits, n))].tolist())
            return list(out)

        return texts.map(of)

    return windows


def central_group_labels(candidates: DataFrame, groups: DataFrame, companies: DataFrame, candidate: str = "candidate_id") -> DataFrame:
    """Ownership class: a group by exact name, a subsidiary only with an explicit parent and evidence."""

    from gleanery.functions.text import name_keys

    keys = name_keys(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    index = key_index(groups.withColumn("seq", F.col("rank")), keys, "group_id", prefer="last").withColumnRenamed("matched_company_id", "_group")
    parents = companies.select(
        F.col("company_id").alias("matched_company_id"), F.col("parent_group_id").alias("_parent"), F.col("ownership_class").alias("_class"),
        (F.coalesce(F.size("ownership_evidence_urls"), F.lit(0)) > 0).alias("_proven"))
    rows = lookup_join(candidates.withColumn("key", name_key("legal_name")), index, "key", "left").drop("key")
    rows = lookup_join(rows, parents, "matched_company_id", "left")
    child = F.col("_parent").isNotNull() & F.coalesce(F.col("_proven"), F.lit(False))
    local = F.upper(F.coalesce(F.col("_class"), F.lit(""))) == "LOCAL_STATE_OWNED"
    ownership = (
        F.when(child & local, "LOCAL_STATE_OWNED").when(child, "CENTRAL_SUBSIDIARY")
        .when(F.col("_group").isNotNull(), "CENTRAL_GROUP").otherwise("UNCLASSIFIED_STATE_OWNED")
    )
    display = F.when(ownership.isin("CENTRAL_GROUP", "CENTRAL_SUBSIDIARY"), "央企").when(ownership == "LOCAL_STATE_OWNED", "地方国企").otherwise(d.UNKNOWN)
    return (
        rows.withColumn("ownership_class", ownership).withColumn("parent_group_id", F.when(child, F.col("_parent")).otherwise(F.col("_group")))
        .withColumn("display_type", display).drop("_group", "_parent", "_class", "_proven")
    )


def official_url(companies: DataFrame, sources: DataFrame, company: str = "company_id", seq: str = "seq") -> DataFrame:
    """Address of a company: a verified source's, else its career page, else any source's."""

    kept = keep_first(sources.filter("source_url is not null"), [company], [(F.col("status") == "VERIFIED").cast("int").desc(), F.col(seq).asc()])
    found = kept.select(company, F.col("source_url").alias("_url"), (F.col("status") == "VERIFIED").alias("_verified"))
    joined = lookup_join(companies, found, company, "left")
    verified = F.coalesce(F.col("_verified"), F.lit(False))
    return joined.withColumn("official_url", F.when(verified, F.col("_url")).otherwise(F.coalesce("career_url", "_url"))).withColumn(
        "official_url_verified", verified).drop("_url", "_verified")


def extend_pool(registry: DataFrame, found: DataFrame, company: str = "company_id") -> DataFrame:
    """Registry plus rows that matched nothing in it."""

    new = found.filter("matched_company_id is null").join(registry.select(company), company, "left_anti")
    return registry.unionByName(new.drop("matched_company_id"), allowMissingColumns=True)


def merge_summary(rows: DataFrame) -> DataFrame:
    """Counts of one workbook import with identity matches (A13). Real match values are counted."""

    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    anomaly = F.arrays_overlap("review_reasons", F.array(F.lit("homepage_multiple_addresses"), F.lit("homepage_contains_whitespace")))
    return rows.agg(
        F.count("*").alias("state_owned_count"), F.count_if(F.col("homepage_observed").isNotNull()).alias("website_count"),
        F.count_if(has("homepage_candidates")).alias("valid_website_count"),
        F.count_if(F.col("homepage_observed").isNull()).alias("missing_website_count"),
        F.count_if(F.col("listing_state") == d.NORMAL_LISTING).alias("normal_listing_count"),
        F.min("equity_as_of").alias("first_equity_date"), F.max("equity_as_of").alias("last_equity_date"),
        F.count_if(anomaly).alias("website_anomaly_count"), F.count_if(F.col("matched_company_id").isNotNull()).alias("matched_registry_count"),
        F.count_if(F.col("match_method") == "CONFLICT").alias("identity_conflict_count"),
    )
