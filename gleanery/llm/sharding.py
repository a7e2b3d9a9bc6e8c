"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard bids for every key: with u, a number in (0, 1) drawn from the 64-bit hash of (salt, key, shard), shard s of weight w bids
w / -ln(u), and the highest bid wins (ties: the smaller shard). A shard's bids know nothing of the other shards, so a new shard takes only
the keys that it outbids everyone for, its share of the weights, and a shard that leaves gives up only its own keys. Keys are hashed as
text, so an id keeps its shard when its column's type changes.

``slot`` numbers the rows of a shard from 0 without gaps, in the order of (hash of the key, key, checksum of the text, size): the same rows
get the same slots however they are partitioned. Only narrow columns are sorted, by ranges that split rows of one key, too.

A null key is a key of its own. Equal keys share a shard, whatever their texts. A null text is empty; its checksum is that of no bytes.
Texts of any length are hashed whole. Equal rows take neighbouring slots. An empty table gives an empty result. Input columns named
like a new column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import stored
from gleanery.scale import rank_rows

SHARDS, SALT = 8, "shard"
NEW = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def bid(key: Column, shard: int, weight: float, salt: str = SALT) -> Column:
    """The shard's bid for the key: higher wins."""
    if not weight > 0:
        raise ValueError("a shard's weight must be above 0")
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(salt), key, F.lit(shard)), 11)
    return F.lit(float(weight)) / -F.log((drawn + F.lit(0.5)) / F.lit(float(1 << 53)))


def winner(bids: Sequence[tuple[int, Column]]) -> Column:
    """The shard of the highest bid; each bid comes with its shard's number."""
    best = F.greatest(*[F.struct(b.alias("bid"), F.lit(-s).alias("s")) for s, b in bids]) if len(bids) > 1 else F.struct(F.lit(-bids[0][0]).alias("s"))
    return (-best["s"]).cast("int")


def assign_shards(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown: Sequence[float] | None = None, key_col: str = "doc_id", text_col: str = "text",
    carry: Sequence[str] | None = None, salt: str = SALT,
) -> DataFrame:
    """Rows with ``shard``, ``slot``, ``size`` (bytes of the text and one), ``text_crc32``, ``law`` ('key') and ``grown_shard``: the shard
    under the weights ``grown``, by default one more shard of the last one's weight.

    ``carry`` names the input columns to keep (default all); leaving the text out keeps it out of the shuffle.
    """
    if not weights:
        raise ValueError("at least one shard is needed")
    grown = [*weights, weights[-1]] if grown is None else list(grown)
    names = [c for c in (docs.columns if carry is None else carry) if c not in NEW]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = docs[key_col].cast("string")
    row = docs.select(
        *[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[key_col].alias("_key"), F.xxhash64(F.lit(salt), key).alias("_h"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        winner([(s, bid(key, s, w, salt)) for s, w in enumerate(weights)]).alias("shard"),
        winner([(s, bid(key, s, w, salt)) for s, w in enumerate(grown)]).alias("grown_shard"),
    )
    row = stored(row.withColumn("_row", F.monotonically_increasing_id()), "shards")  # the number splits equal rows over ranges
    order = [F.col(c).asc_nulls_first() for c in ("_h", "_key", "text_crc32", "size", "_row")]
    placed = rank_rows(row, order, ["shard"], "_rank")
    return placed.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard (shard=N) of Parquet files, each file a stretch of slots in order."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return placed.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
