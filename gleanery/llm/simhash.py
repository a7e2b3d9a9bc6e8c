"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A text's 64-bit fingerprint is cut into three segments (23, 23 and 18 bits, the last padded to 23). The binary Golay code [23,12] is
perfect: every 23-bit word lies within 3 bits of one codeword. If two words differ in at most 2 bits, the codeword next to the word
half way between them lies within 4 bits of both; a word has one codeword within 4 bits, or six. So a segment decoded to all its
codewords within 4 bits gives at most six 12-bit indices, and segments at most 2 bits apart share one of them.

With at most 4 differing bits in all, either each segment has at most 2, and the pair shares a triple of indices, or one segment has 3 or
more, and of the two others one is equal and one differs in at most 1 bit, so the pair shares that segment's bits together with an
index of the other. Both kinds are the join keys (36 and 35 bits). Pairs that meet under a key are verified on all bits.

Only distinct fingerprints take part: copies meet by grouping. Members of a key are compared inside one task in vectorised steps and
leave as a spanning forest, never as all pairs. A key with more than ``block`` distinct fingerprints is dealt out as pairs of blocks.

Null and empty texts have no words: fingerprint zero, linked like any other. Ties need no rule: labels are minima. Repeated rows stay
rows and share their component. Extra columns pass through; those named like a new column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import stored, text_of, utf8_rows
from gleanery.llm.graph import components

SHINGLE, MAX_BITS, SEED, BLOCK = 4, 4, 42, 4096
WIDTH, GENERATOR, CHECK_BITS = 23, 0b110001110101, 11


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    at = starts.tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a: b - 1], SEED) for a, b in zip(at, at[shingle:])], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i: i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    docs = docs.select(*[docs[c] for c in docs.columns if c != name or c == text_col])
    fields = docs.schema.fields
    hidden = "_simhash_text"
    while hidden in docs.columns:
        hidden += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in utf8_rows(batch.column(len(fields)))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(fields))], pa.array(fps.view(np.int64))], [f"c{i}" for i in range(len(fields) + 1)])

    safe = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate([*fields, T.StructField(name, T.LongType())])])
    return docs.withColumn(hidden, text_of(docs, text_col)).mapInArrow(run, safe).toDF(*[f.name for f in fields], name)


def _remainder(x: np.ndarray) -> np.ndarray:
    """x modulo the generator polynomial, for 23-bit x."""
    x = x.astype(np.uint32, copy=True)
    for bit in range(WIDTH - 1, CHECK_BITS - 1, -1):
        x ^= ((x >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - CHECK_BITS))
    return x


class Golay:
    """Codeword indices within 4 bits of a word, by syndrome."""

    def __init__(self) -> None:
        patterns = np.array([sum(1 << b for b in bits) for w in range(5) for bits in combinations(range(WIDTH), w)], np.uint32)
        syndromes = _remainder(patterns)
        self.errors = np.zeros((1 << CHECK_BITS, 6), np.uint32)
        self.valid = np.zeros((1 << CHECK_BITS, 6), bool)
        order = np.argsort(syndromes, kind="stable")
        s, p = syndromes[order], patterns[order]
        place = np.arange(len(s)) - np.searchsorted(s, s)
        self.errors[s, place], self.valid[s, place] = p, True

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = _remainder(words)
        return ((words[:, None].astype(np.uint32) ^ self.errors[s]) >> np.uint32(CHECK_BITS)).astype(np.uint64), self.valid[s]


def fuzzy_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every join key of each fingerprint."""
    mask, keys, rows = np.uint64((1 << WIDTH) - 1), [], []
    segments = [fps & mask, (fps >> np.uint64(WIDTH)) & mask, fps >> np.uint64(2 * WIDTH)]
    near = [golay.indices(s) for s in segments]
    (a, va), (b, vb), (c, vc) = near
    triple = (a[:, :, None, None] << np.uint64(24)) | (b[:, None, :, None] << np.uint64(12)) | c[:, None, None, :]
    ok = va[:, :, None, None] & vb[:, None, :, None] & vc[:, None, None, :]
    keys.append(triple[ok])
    rows.append(np.nonzero(ok)[0])
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)), start=1):
        idx, valid = near[j]
        key = np.uint64(tag << 36) | (segments[i][:, None] << np.uint64(12)) | idx
        keys.append(key[valid])
        rows.append(np.nonzero(valid)[0])
    return np.concatenate(keys), np.concatenate(rows)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 2048):
            part = fps[i: i + 2048]
            keys, rows = fuzzy_keys(part, golay)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part[rows].view(np.int64))], ["key", "fp"])


def forest(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among rows sorted by key that share the key and differ in at most ``max_bits`` bits."""
    n = len(keys)
    label, live, step = np.arange(n), np.arange(n), 1
    while True:
        live = live[live + step < n]
        live = live[keys[live] == keys[live + step]]
        if not len(live):
            break
        hit = live[np.bitwise_count(fps[live] ^ fps[live + step]) <= max_bits]
        _merge(label, hit, hit + step)
        step += 1
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        if not len(i):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _link_rows(block: int, max_bits: int):
    """Streams rows sorted by key: forest links (block -1) of keys with up to ``block`` members; the members of larger keys, numbered by block."""

    def out(a: np.ndarray, b: np.ndarray, blocks: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(blocks, pa.int64())], ["a", "b", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        big, place = None, 0  # key being passed on as too large, and how many of it went

        def close(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = forest(k, f.view(np.uint64), max_bits)
            return out(a.view(np.int64), b.view(np.int64), np.full(len(a), -1))

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
            if big is not None:
                n = int(np.searchsorted(k, big, side="right"))
                if n:
                    yield out(k[:n], f[:n], (place + np.arange(n)) // block)
                    place, k, f = place + n, k[n:], f[n:]
                if len(k):
                    big = None
            if not len(k):
                held_k, held_f = k, f
                continue
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(k)]]))
            if sizes[-1] > block:  # the last group, still open, is too large already
                cut, big, place = int(starts[-1]), k[-1], int(sizes[-1])
                yield out(k[cut:], f[cut:], np.arange(place) // block)
                held_k, held_f = k[:0], f[:0]
            else:
                cut = int(starts[-1])
                held_k, held_f = k[cut:], f[cut:]
            inner = sizes[: len(starts) - 1]
            for g in np.flatnonzero(inner > block):
                a = int(starts[g])
                m = int(inner[g])
                yield out(k[a: a + m], f[a: a + m], np.arange(m) // block)
            keep = np.repeat((inner > 1) & (inner <= block), inner)
            if keep.any():
                yield close(k[:cut][keep], f[:cut][keep])
        if len(held_k) > 1:
            yield close(held_k, held_f)

    return run


def _block_links(max_bits: int):
    """Rows sorted by (key, lo, hi, block): links between the two blocks of each pair."""

    def cross(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([a, b]).view(np.uint64)
        label, n = np.arange(len(both)), len(a)
        other = np.arange(n, len(both))
        for i in range(n):
            hit = other[np.bitwise_count(both[n:] ^ both[i]) <= max_bits]
            _merge(label, np.full(len(hit), i), hit)
        moved = np.flatnonzero(label != np.arange(len(both)))
        return both[moved].view(np.int64), both[label[moved]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(lo: int, hi: int, blocks: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            if lo == hi:
                a, b = forest(np.zeros(len(f), np.int64), f.view(np.uint64), max_bits)
                a, b = a.view(np.int64), b.view(np.int64)
            else:
                a, b = cross(f[blocks == lo], f[blocks == hi])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]  # key, lo, hi, block, fp
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            start = 0
            for end in change.tolist():
                yield close(cols[1][start], cols[2][start], cols[3][start:end], cols[4][start:end])
                start = end
            held = [c[start:] for c in cols]
        if held is not None and len(held[0]):
            yield close(held[1][0], held[2][0], held[3], held[4])

    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of a spanning forest for each group of distinct fingerprints (column fp) at most ``max_bits`` (4 or fewer) apart."""
    if max_bits > 4:
        raise ValueError("the codes find pairs that differ in at most 4 bits")
    keys = distinct.mapInArrow(_key_rows, "key long, fp long")
    sorted_keys = keys.repartition("key").sortWithinPartitions("key", "fp")
    found = stored(sorted_keys.mapInArrow(_link_rows(block, max_bits), "a long, b long, block long"), "links")
    links = found.filter("block = -1").select("a", "b").distinct()
    large = found.filter("block >= 0").select(F.col("a").alias("key"), F.col("b").alias("fp"), "block")
    if large.isEmpty():
        return links
    last = large.groupBy("key").agg(F.max("block").alias("last"))
    pairs = (
        large.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        .select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp")
    )
    dealt = pairs.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "block", "fp")
    return links.union(dealt.mapInArrow(_block_links(max_bits), "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id among all rows whose fingerprints can be reached over links."""
    fps = stored(with_fingerprint(docs.select(id_col, text_col), text_col, shingle).select(F.col(id_col).alias("id"), "fp"), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(fingerprint_links(least.select("fp"), max_bits, block))
    placed = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(ids, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
