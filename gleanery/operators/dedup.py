"""Choosing and ordering rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.scale import keep_first, lookup_join, rank_rows, top_per_group


def latest_per_key(df: DataFrame, keys: Sequence[str], stamp: str, seq: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Newest row per key; a tie keeps the row that arrived first."""

    return keep_first(df, keys, [F.col(stamp).desc_nulls_last(), *[F.col(c).asc() for c in seq]], tasks)


def first_per_key(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """First arrival per key."""

    return keep_first(df, keys, [F.col(c).asc() for c in seq])


def raw_key(*parts: str) -> Column:
    """Case-folded key of a raw posting: id, title and link."""

    return F.lower(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))


def spread_sample(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First, middle and last row of every group; groups of up to three are kept whole."""

    ranked = rank_rows(df, order, group, "sample_pos", "group_size")
    place = F.col("sample_pos") - 1
    size = F.col("group_size")
    return ranked.filter((size <= 3) | place.isin(0) | (place == F.floor(size / 2)) | (place == size - 1))


def bounded_samples(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 40) -> DataFrame:
    """At most ``n`` rows per class, in arrival order."""

    return top_per_group(df, group, order, n, "sample_no")


def top_with_more(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 5) -> DataFrame:
    """Top ``n`` rows per group and whether the group has more (W6). One row past ``n`` is enough to know."""

    head = top_per_group(df, group, order, n + 1, "pos")
    more = F.max("pos").over(Window.partitionBy(*group)) > n
    return head.withColumn("has_more", more).filter(F.col("pos") <= n)


def order_groups_by_head(df: DataFrame, group: Sequence[str], order: Sequence[Column], head: str) -> DataFrame:
    """Give every row the value its group's first row has, the sort key of grouped views."""

    heads = keep_first(df, group, order).select(*group, F.col(head).alias(f"group_{head}"))
    return lookup_join(df, heads, list(group), "left")


def earliest(df: DataFrame, key: Sequence[str], stamp: str, name: str) -> DataFrame:
    """First time each key was seen."""

    return df.groupBy(*key).agg(F.min(stamp).alias(name))


def best_per_key(df: DataFrame, keys: Sequence[str], preferred: Column, seq: Sequence[str]) -> DataFrame:
    """A preferred row beats the others; among equals the first wins."""

    return keep_first(df, keys, [preferred.cast("int").desc_nulls_last(), *[F.col(c).asc() for c in seq]])


def longest_per_key(df: DataFrame, keys: Sequence[str], text: str, seq: Sequence[str]) -> DataFrame:
    """Row with the longest text per key."""

    return keep_first(df, keys, [F.length(text).desc(), *[F.col(c).asc() for c in seq]])


def union_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name, missing columns NULL."""

    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def union_later_wins(keys: Sequence[str], seq: Sequence[str], *frames: DataFrame) -> DataFrame:
    """Union where a later frame replaces the rows of an earlier one by key."""

    marked = union_rows(*[f.withColumn("_batch", F.lit(i)) for i, f in enumerate(frames)])
    return keep_first(marked, keys, [F.col("_batch").desc(), *[F.col(c).desc() for c in seq]]).drop("_batch")


def ordered_union(*arrays: Column) -> Column:
    """Distinct items of several arrays, first order kept."""

    return F.array_distinct(F.filter(F.concat(*arrays), lambda x: F.trim(x) != ""))


def merge_values(df: DataFrame, keys: Sequence[str], arrays: Sequence[str], seq: str) -> DataFrame:
    """Distinct array items of merged duplicates in long form: (keys, field, value, first place).

    Copies are reduced before the shuffle, and a key with many values stays many rows.
    """

    fields = F.array(*[F.struct(F.lit(a).alias("field"), F.col(a).alias("items")) for a in arrays])
    long = df.select(*keys, seq, F.explode(fields).alias("f")).select(*keys, seq, "f.field", F.posexplode("f.items").alias("pos", "value"))
    return long.groupBy(*keys, "field", "value").agg(F.min(F.struct(seq, "pos")).alias("first_at"))


def merge_scalars(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seq: str) -> DataFrame:
    """First non-NULL value of each column over the copies of a key."""

    return df.groupBy(*keys).agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct(seq, c)))[c].alias(c) for c in columns])
