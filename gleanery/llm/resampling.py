"""Importance resampling towards a target's distribution, without replacement.

Features are the words and the pairs of neighbouring words of a text, hashed into ``BUCKETS`` buckets by CRC-32. Two histograms, of all
documents (S features) and of the target texts (T), give each bucket its gain, floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))). Gains are
one array of B numbers, the only thing tasks need; a document's weight is the floored mean of its features' gains, looked up for whole
batches. With Gumbel noise drawn from the id added to the weights, the highest scores are a draw in proportion to exp(weight).

The cutoff is found by weighted medians of medians: each partition of the scored rows reports the median of the keys still open in it and
their number, on both sides of the current pivot. The median of the medians, weighted by those numbers, is the next pivot; at least a
quarter of the open keys is ruled out each time, whatever their order. When at most ``FINISH`` keys are open they are fetched and the
cutoff is read off. Only medians (one row per partition) and those last keys come to the driver, and only winners are sorted, by ranges.

Rows of fewer than ``min_words`` words are never drawn. Keys are (score descending, id ascending, nulls last, row number), so the draw has
exactly its size among ties and repeated rows too. A null text has no words and weight 0; a null id draws the noise of an empty one.
Texts of any length are read whole. An empty table gives an empty result; an empty target leaves the corpus' own counts to decide. Input
columns named like a new column are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import stored, text_of
from gleanery.llm.runs import WORD_CHARS, Words, lengths_of, word_runs
from gleanery.scale import rank_rows

BUCKETS, MIN_WORDS, PERCENT, SEED, FINISH = 10_000, 20, 25, "7", 8192
NEW = ["n_words", "n_features", "weight", "score", "rank"]
MAX_TABLE = 64  # second words of more bytes are hashed on their own


def _shift_tables() -> np.ndarray:
    """For n = 0 to MAX_TABLE, what n more bytes do to a CRC-32 before them, by its four bytes."""
    step = np.zeros(256, np.uint32)
    for b in range(256):
        x = b
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        step[b] = x
    tables = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(MAX_TABLE):
        tables.append((tables[-1] >> np.uint32(8)) ^ step[tables[-1] & np.uint32(255)])
    return np.stack(tables)


SHIFT = _shift_tables()


def features(part: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, CRC-32) of every word and of every pair of neighbouring words of a row, joined by a space."""
    coded = part.words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    kinds = coded.dictionary.to_pylist()
    alone = np.fromiter((zlib.crc32(w) for w in kinds), np.uint32, len(kinds))
    lead = np.fromiter((zlib.crc32(b" ", c) for c in alone.tolist()), np.uint32, len(kinds))
    size = lengths_of(coded.dictionary)
    rows = part.rows
    first = np.flatnonzero(rows[1:] == rows[:-1])
    before, second = lead[codes[first]], codes[first + 1]
    length = size[second]
    at = np.minimum(length, MAX_TABLE)
    pairs = alone[second].copy()
    for k in range(4):
        pairs ^= SHIFT[at, k, (before >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(length > MAX_TABLE).tolist():
        pairs[i] = zlib.crc32(kinds[second[i]], int(before[i]))
    return np.concatenate([rows, rows[first]]), np.concatenate([alone[codes], pairs])


def histogram(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (column ``text``) fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in word_runs(batch.column(0), WORD_CHARS):
                total += np.bincount(features(part)[1] % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # one row per bucket
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    b, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + b) / ((x + 1) * (t + b)))) for x, y in zip(corpus.astype(float), target.astype(float))], np.int64)


def noise(id_col: Column, seed: str = SEED) -> Column:
    """floor of 1000 times a standard Gumbel number that the id decides."""
    digits = F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0))))


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Rows with ``n_words``, ``n_features``, ``weight`` and ``score``."""
    names = [c for c in docs.columns if c not in NEW]
    text = text_of(docs, text_col)
    gain = gains(histogram(docs.select(text.alias("text")), buckets), histogram(target.select(text_of(target, target_col).alias("text")), buckets))
    plain = docs.select(text.alias("_text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, count, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for part in word_runs(batch.column(0), WORD_CHARS):
                span = slice(part.first, part.first + len(part.per_row))
                rows, crc = features(part)
                words[span] = part.per_row
                count[span] = np.bincount(rows, minlength=len(part.per_row))
                np.add.at(total[span], rows, gain[crc % np.uint32(buckets)])
            mean = total // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(x) for x in (words, count, mean)]], [*batch.schema.names[1:], "n_words", "n_features", "weight"])

    schema = T.StructType([*plain.schema.fields[1:], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    weighed = plain.mapInArrow(run, schema)
    out = weighed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_words", "n_features", "weight")
    return out.withColumn("score", F.col("weight") + noise(F.col(id_col), seed))


Key = tuple[int, object, int]  # score, id, row number


def _order(key: Key) -> tuple:
    return (-key[0], key[1] is None, key[1] if key[1] is not None else 0, key[2])


def _upto(keys: pa.Table, key: Key) -> pa.Array:
    """Which keys come before the given one, or are it."""
    score, name, row = key
    if name is None:
        before, same = pc.is_valid(keys["id"]), pc.is_null(keys["id"])
    else:
        value = pa.scalar(name, keys.schema.field("id").type)
        before, same = pc.fill_null(pc.less(keys["id"], value), False), pc.fill_null(pc.equal(keys["id"], value), False)
    tied = pc.or_(before, pc.and_(same, pc.less_equal(keys["row"], row)))
    return pc.or_(pc.greater(keys["score"], score), pc.and_(pc.equal(keys["score"], score), tied))


def _median(keys: pa.Table) -> tuple[int, list]:
    if not keys.num_rows:
        return 0, [None, None, None]
    place = pc.sort_indices(keys, sort_keys=[("score", "descending"), ("id", "ascending"), ("row", "ascending")], null_placement="at_end")[(keys.num_rows - 1) // 2].as_py()
    return keys.num_rows, [keys[c][place].as_py() for c in ("score", "id", "row")]


def partition_medians(low: Key | None, high: Key | None, pivot: Key | None):
    """Of the keys after ``low`` and up to ``high``: number and median of those up to the pivot (side 0), and of those after it (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_keys = []
        for batch in batches:
            part = pa.Table.from_batches([batch])
            if low is not None:
                part = part.filter(pc.invert(_upto(part, low)))
            if high is not None:
                part = part.filter(_upto(part, high))
            open_keys.append(part)
        if not open_keys:
            return
        keys = pa.concat_tables(open_keys).combine_chunks()
        upto = _upto(keys, pivot) if pivot is not None else None
        sides = [(1, keys)] if pivot is None else [(0, keys.filter(upto)), (1, keys.filter(pc.invert(upto)))]
        found = [(side, *_median(rows)) for side, rows in sides]
        kinds = keys.schema
        yield pa.RecordBatch.from_arrays([
            pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2][0] for f in found], pa.int64()),
            pa.array([f[2][1] for f in found], kinds.field("id").type), pa.array([f[2][2] for f in found], pa.int64()),
        ], ["side", "n", "score", "id", "row"])

    return run


def weighted_median(medians: list[tuple[int, Key]]) -> Key:
    medians = sorted(medians, key=lambda m: _order(m[1]))
    half, seen = sum(n for n, _ in medians) / 2, 0
    for n, key in medians:
        seen += n
        if seen >= half:
            return key
    raise ValueError("no medians")


def cutoff_key(keys: DataFrame, take: int, finish: int = FINISH) -> Key:
    """The ``take``-th key of (score, id, row) in the order of the draw; ``keys`` must be stored, with ``take`` >= 1 rows or more.

    Lower medians keep the pivot before the last open key, so every round rules out at least one.
    """
    id_type = keys.schema["id"].dataType
    schema = T.StructType([T.StructField("side", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("score", T.LongType()), T.StructField("id", id_type), T.StructField("row", T.LongType())])
    low = high = pivot = None
    while True:
        open_keys = keys
        if low is not None:
            open_keys = open_keys.filter(F.col("score") <= low[0])
        if high is not None:
            open_keys = open_keys.filter(F.col("score") >= high[0])
        found = open_keys.mapInArrow(partition_medians(low, high, pivot), schema).collect()  # two rows per partition
        sides: list[list[tuple[int, Key]]] = [[], []]
        for r in found:
            if r["n"]:
                sides[r["side"]].append((r["n"], (r["score"], r["id"], r["row"])))
        upto = sum(n for n, _ in sides[0])
        if pivot is not None and upto >= take:
            high, left = pivot, sides[0]
        else:
            low, take, left = pivot, take - upto, sides[1]
        if sum(n for n, _ in left) <= finish:
            break
        pivot = weighted_median(left)
    last = keys
    if low is not None:
        last = last.filter(F.col("score") <= low[0])
    if high is not None:
        last = last.filter(F.col("score") >= high[0])
    last = last.filter(_between(low, high)).collect()  # at most ``finish`` keys
    return sorted(((r["score"], r["id"], r["row"]) for r in last), key=_order)[take - 1]


def _reached(key: Key) -> Column:
    """Rows that come before the key in the order of the draw, or are it."""
    score, name, row = key
    before = F.col("id").isNotNull() if name is None else F.coalesce(F.col("id") < F.lit(name), F.lit(False))
    return (F.col("score") > score) | ((F.col("score") == score) & (before | (F.col("id").eqNullSafe(F.lit(name)) & (F.col("row") <= row))))


def _between(low: Key | None, high: Key | None) -> Column:
    inside = F.lit(True)
    if low is not None:
        inside = inside & ~_reached(low)
    return inside if high is None else inside & _reached(high)


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_col: str = "doc_id", finish: int = FINISH) -> DataFrame:
    """All rows of a weighed table with ``rank``: 1, 2, 3... for the drawn ones by falling score, null for the rest."""
    names = [c for c in scored.columns if c != "rank"]
    rows = scored.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], "score", F.col(id_col).alias("id"), (F.col("n_words") >= min_words).alias("able"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    take = percent * rows.filter("able").count() // 100
    columns = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    if not take:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    won = F.col("able")
    if percent < 100:
        won = won & _reached(cutoff_key(rows.filter("able").select("score", "id", "row"), take, finish))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    winners = rank_rows(rows.filter(won), order, (), "rank")
    return winners.select(*columns, F.col("rank").cast("long").alias("rank")).unionByName(rows.filter(~won).select(*columns, F.lit(None).cast("long").alias("rank")))


def digest(drawn: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return drawn.select(id_col, "n_features", "weight", "score", "rank")
