"""Repeated byte strings across texts by common-prefix intervals of an enhanced suffix array.

Dealing out: each start of a ``length``-byte string belongs to the 64-byte gram of smallest hash inside that string (the leftmost of equal
ones). Equal strings hold the same gram at the same place, so all starts that can match meet under the gram's hash, and a text becomes a
row of segments, each with the starts of one gram. Grams are counted first: a gram met once is dropped, and of a gram whose segments are
all equal every start repeats, before any text moves. Segments of other grams are split by the gram's offset in the string into PARTS; the
strings of a part share a core of about 288 bytes around the gram, whose hash names the task they go to, so a gram that a third of all texts
hold is spread by its surroundings. Of equal segments a batch of texts sends one, with their number. The task builds a suffix array over the different segments of whole
cores (ranks by prefix doubling) and its common prefixes. Texts move packed, and equal texts of an Arrow batch move as one row with all
their ids, so a hot text costs a task one row for each batch that holds it.

Intervals: a run of the array with common prefixes of ``length`` or more is a node of the interval tree; all its starts repeat. A node whose
occurrences follow different bytes (or start a text) can't be extended to the left: a stack scan splits it into its maximal repeats,
each with all its occurrences, as far as the segments reach. A segment reaches ``length`` bytes past its last start, so the length told for a group is a lower bound there.

A core with more than ``max_bytes`` of different segments is scanned in place order instead: its segments line up at the gram, and at each
place windows are grouped by a rolling hash of 128 bits. That takes 1 KB of memory for each different context of one core.

Null text is empty. Texts shorter than ``length`` bytes keep everything. Repeated rows are occurrences like any other. Strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import mix64, stored, text_of, utf8_rows

LENGTH, GRAM, PARTS, CHUNK, SHARD, MAX_BYTES = 400, 64, 3, 1 << 20, 1 << 19, 1 << 20
PLACE_BITS = 21


def text_key(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 64 bytes at each place, by doubling."""
    h, step, factor = data.astype(np.uint64), 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while step < GRAM:
            h = h[:-step] * factor + h[step:]
            factor, step = factor * factor, step * 2
    return mix64(h)


def segments(data: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(gram hash, its place, first start, last start) of each run of starts that share their gram."""
    n = len(data) - length + 1
    window = length - GRAM + 1
    raw = np.frombuffer(data, np.uint8)
    low = np.uint64((1 << PLACE_BITS) - 1)
    for at in range(0, max(0, n), CHUNK):
        part = raw[at: min(len(raw), at + CHUNK + length - 1)]
        h = gram_hashes(part)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least, step = key, 1
        while step * 2 <= window:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < window:
            least = np.minimum(least[: len(key) - window + 1], least[window - step: len(key) - step + 1])
        place = (least & low).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
        signed = h.view(np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(signed[place[a]]), at + int(place[a]), at + a, at + b - 1


def parts_of(data: bytes, place: int, a: int, b: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(core hash, first start, last start) of the parts of a segment whose gram is at ``place``."""
    span = (length - GRAM) // PARTS + 1
    for part in range((place - b) // span, (place - a) // span + 1):
        low, high = part * span, min((part + 1) * span - 1, length - GRAM)
        core = xxhash.xxh3_64_intdigest(data[place - low: place - high + length], part) - (1 << 63)
        yield core, max(a, place - high), min(b, place - low)


def _texts_of(batch: pa.RecordBatch) -> dict[tuple[int, int], tuple[bytes, list[int]]]:
    """The different texts of a batch by key, each with its row numbers; the text is the last column."""
    out: dict[tuple[int, int], tuple[bytes, list[int]]] = {}
    for i, data in enumerate(utf8_rows(batch.column(batch.num_columns - 1))):
        out.setdefault(text_key(data), (data, []))[1].append(i)
    return out


def _occurrences(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["gram", "hash", "k1", "k2", "place", "a", "b", "n"], [pa.int64()] * 8
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for key, (data, members) in _texts_of(batch).items():
                if len(data) >= length:
                    rows += [(gram, xxhash.xxh3_64_intdigest(data[a: b + length]) - (1 << 63), *key, place, a, b, len(members)) for gram, place, a, b in segments(data, length)]
                if len(rows) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each different text of a batch: the ids that have it, its key, the compressed text."""
    pack = zstandard.ZstdCompressor().compress
    for batch in batches:
        if not batch.num_rows:
            continue
        found = _texts_of(batch)
        members = [m for _, m in found.values()]
        ids = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([len(m) for m in members])]), pa.int32()), batch.column(0).take(pa.array([i for m in members for i in m], pa.int64()))
        )
        keys = [pa.array([k[i] for k in found], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([ids, *keys, pa.array([pack(d) for d, _ in found.values()], pa.binary())], ["ids", "k1", "k2", "packed"])


def _known(k1: int, k2: int, a: int, b: int) -> tuple:
    return k1 ^ (a * 0x9E3779B97F4A7C15 & (1 << 63) - 1), 0, 0, 0, k1, k2, a, b, 0, 0, None


def _cut_out(length: int):
    """The parts of the wanted segments of each text, with the byte before (-1 at the start of the text).

    Of equal ones a batch sends one with their number ``n``; where that is over 1 each also gives a row of its own with n = 0, a run that is
    known to repeat and whose ``core`` only spreads it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kinds = [pa.int64()] * 10 + [pa.binary()]
        names = ["core", "g1", "g2", "n", "k1", "k2", "a", "b", "left", "gram_at", "data"]
        for batch in batches:
            met: dict[tuple[int, int, int], list] = {}
            rows: list[tuple] = []
            size = 0
            for k1, k2, n, segs, packed in zip(*(c.to_pylist() for c in batch.columns)):
                data = unpack(packed)
                for s in segs:
                    for core, a, b in parts_of(data, s["place"], s["a"], s["b"], length):
                        part = data[a: b + length]
                        first = met.setdefault((core, *text_key(part)), [0, k1, k2, a, b, data[a - 1] if a else -1, s["place"] - a, part])
                        if first[0] == 1:
                            rows.append(_known(*first[1:5]))
                        if first[0] or n > 1:
                            rows.append(_known(k1, k2, a, b))
                        size += 0 if first[0] else len(part)
                        first[0] += n
                if size > 1 << 22 or len(rows) > 1 << 16:
                    rows += [(*kind, *first) for kind, first in met.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    met, rows, size = {}, [], 0
            rows += [(*kind, *first) for kind, first in met.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


class SuffixArray:
    """Sorted starts of ``length``-byte strings in a few segments, with ranks by 8, 16, ... bytes for common prefixes."""

    def __init__(self, parts: list[bytes], length: int) -> None:
        self.length = length
        sizes = np.array([len(p) for p in parts])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(parts) + bytes(length + 8), np.uint8)
        n = int(begin[-1])
        self.ends = np.repeat(begin[1:], sizes)
        word = np.zeros(n, np.uint64)
        for i in range(8):
            word = (word << np.uint64(8)) | self.data[i: i + n].astype(np.uint64)
        self.ranks, step = [self._rank(word)], 8
        while step * 2 <= length:
            last = np.concatenate([self.ranks[-1], np.zeros(step, np.uint64)])
            self.ranks.append(self._rank((last[:n] << np.uint64(32)) | last[step: n + step]))
            step *= 2
        counts = sizes - length + 1
        self.owner = np.repeat(np.arange(len(parts)), counts)
        self.starts = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, counts)])
        top = self.ranks[-1]
        key = (top[self.starts] << np.uint64(32)) | top[self.starts + length - step]
        order = np.argsort(key, kind="stable")
        self.order, sorted_key = order, key[order]
        # places where the common prefix with the suffix before is shorter than ``length``
        self.breaks = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1], [True]]))

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        return np.unique(key, return_inverse=True)[1].astype(np.uint64)

    def common_prefix(self, i: int, j: int) -> int:
        """Bytes that the suffixes at i and j share within their segments."""
        most, at = int(min(self.ends[i] - i, self.ends[j] - j)), 0
        for level in range(len(self.ranks) - 1, -1, -1):
            step, r = 8 << level, self.ranks[level]
            while at + step <= most and r[i + at] == r[j + at]:
                at += step
        while at < most and self.data[i + at] == self.data[j + at]:
            at += 1
        return at


def _sorted_suffixes(array: SuffixArray, members: np.ndarray) -> list[int]:
    return sorted((int(array.starts[m]) for m in members), key=lambda s: array.data[s: array.ends[s]].tobytes())


def interval_groups(array: SuffixArray, members: np.ndarray, left: np.ndarray) -> list[tuple[int, list[int]]]:
    """(length, starts) of the left-diverse common-prefix intervals of one run, by a stack scan over its suffixes in order."""
    starts = _sorted_suffixes(array, members)
    before = {int(array.starts[m]): int(left[m]) for m in members}
    out: list[tuple[int, list[int]]] = []
    stack: list[list] = []  # [common prefix, first place]
    prefixes = [array.common_prefix(a, b) for a, b in zip(starts, starts[1:])] + [0]
    for i, lcp in enumerate(prefixes):
        first = i
        while stack and stack[-1][0] > lcp:
            depth, first = stack.pop()
            inside = starts[first: i + 1]
            lefts = {before[s] for s in inside}
            if len(lefts) > 1 or -1 in lefts:
                out.append((depth, inside))
        if lcp >= array.length and (not stack or stack[-1][0] < lcp):
            stack.append([lcp, first])
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def scan_shard(rows: list[tuple], length: int, groups: bool) -> tuple[list[tuple], list[tuple]]:
    """Repeated runs of starts (k1, k2, a, b) of segments that occur once, and groups (group, length, k1, k2, start)."""
    array = SuffixArray([r[7] for r in rows], length)
    repeated = np.zeros(len(array.starts), bool)
    sizes = np.diff(array.breaks)
    many = np.repeat(sizes > 1, sizes)
    repeated[array.order[many]] = True
    base = np.array([r[3] for r in rows])
    at = np.concatenate([[0], np.cumsum([len(r[7]) for r in rows])])
    found: list[tuple] = []
    bounds = np.concatenate([[0], np.cumsum([len(r[7]) - length + 1 for r in rows])])
    for i, r in enumerate(rows):
        if r[0] == 1:
            found += [(r[1], r[2], r[3] + a, r[3] + b) for a, b in _runs(repeated[bounds[i]: bounds[i + 1]])]
    out: list[tuple] = []
    if groups:
        inner = array.starts - at[array.owner]
        first = np.array([r[5] for r in rows])[array.owner]
        left = np.where(inner > 0, array.data[np.maximum(array.starts - 1, 0)], first)
        for a, b in zip(array.breaks[:-1][sizes > 1].tolist(), array.breaks[1:][sizes > 1].tolist()):
            members = array.order[a:b]
            lefts = left[members]
            if lefts.min() == lefts.max() and lefts[0] >= 0:
                continue
            owner = {int(array.starts[m]): int(array.owner[m]) for m in members}
            for size, starts in interval_groups(array, members, left):
                text = array.data[starts[0]: starts[0] + size].tobytes()
                name = xxhash.xxh3_128_hexdigest(text)
                out += [(name, size, rows[owner[s]][1], rows[owner[s]][2], int(base[owner[s]] + s - at[owner[s]])) for s in starts]
    return found, out


def scan_aligned(rows: list[tuple], gram_at: list[int], length: int) -> list[tuple]:
    """The same runs for a core with very many different segments, place by place with rolling hashes."""
    reach = length - GRAM
    lo = np.array([-g for g in gram_at])
    hi = np.array([len(r[7]) - length - g for r, g in zip(rows, gram_at)])
    table = np.zeros((len(rows), reach + length), np.uint8)
    for i, (r, g) in enumerate(zip(rows, gram_at)):
        table[i, reach - g: reach - g + len(r[7])] = np.frombuffer(r[7], np.uint8)
    flags = np.zeros((len(rows), reach + 1), bool)
    factors = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
    with np.errstate(over="ignore"):
        tops = []
        for f in factors:
            p = np.uint64(1)
            for _ in range(length - 1):
                p = p * f
            tops.append(p)
        sums = []
        for f in factors:
            s = np.zeros(len(rows), np.uint64)
            for j in range(length):
                s = s * f + table[:, j]
            sums.append(s)
        for o in range(reach + 1):
            live = np.flatnonzero((lo <= o - reach) & (o - reach <= hi))
            if len(live) > 1:
                pair = np.empty(len(live), dtype=[("x", np.uint64), ("y", np.uint64)])
                pair["x"], pair["y"] = sums[0][live], sums[1][live]
                order = np.lexsort((pair["y"], pair["x"]))
                same = pair[order][1:] == pair[order][:-1]
                flags[live[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]], o] = True
            if o < reach:
                sums = [(s - table[:, o] * t) * f + table[:, o + length] for s, t, f in zip(sums, tops, factors)]
    out = []
    for i, r in enumerate(rows):
        if r[0] == 1:
            shift = r[3] + gram_at[i] - reach
            out += [(r[1], r[2], shift + a, shift + b) for a, b in _runs(flags[i])]
    return out


def _scan(length: int, groups: bool, max_bytes: int):
    """Rows sorted by (core, g1, g2): equal segments repeat as a whole, different ones of whole cores are gathered into shards of about SHARD bytes."""

    def batch_of(found: list[tuple], grouped: list[tuple]) -> pa.RecordBatch:
        both = [(None, 0, *f) for f in found] + [(g, n, k1, k2, s, s) for g, n, k1, k2, s in grouped]
        cols = list(zip(*both)) if both else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), *[pa.int64()] * 5])], ["group", "size", "k1", "k2", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        current: list[tuple] = []  # the different segments of one core
        whole: list[tuple] = []
        held, size, core = 0, 0, None
        kind, first, data, met = None, (), None, 0

        def end_kind() -> None:
            nonlocal size, kind
            if kind is not None:
                current.append((met, *first, data))
                size += len(data)
                kind = None

        def end_core() -> Iterator[pa.RecordBatch]:
            nonlocal shard, current, held, size
            end_kind()
            if len(current) > 1:
                if size > max_bytes:
                    yield batch_of(scan_aligned(current, [r[6] for r in current], length), [])
                else:
                    shard += current
                    held += size
            current, size = [], 0

        for batch in batches:
            for c, g1, g2, n, k1, k2, a, b, left, gram_at, part in zip(*(x.to_pylist() for x in batch.columns)):
                if n == 0:
                    whole.append((k1, k2, a, b))
                    continue
                if c != core:
                    yield from end_core()
                    core = c
                    if held >= SHARD:
                        yield batch_of(*scan_shard(shard, length, groups))
                        shard, held = [], 0
                if (g1, g2) != kind:
                    end_kind()
                    kind, first, data, met = (g1, g2), (k1, k2, a, b, left, gram_at), part, n
                else:  # the same segment from another batch, which has told its runs unless it is the only one there
                    whole += [x for x, single in ((first[:4], met == 1), ((k1, k2, a, b), n == 1)) if single]
                    met += n
            if whole:
                yield batch_of(whole, [])
                whole = []
        yield from end_core()
        if shard:
            yield batch_of(*scan_shard(shard, length, groups))

    return run


def _found(docs: DataFrame, text_col: str, length: int, groups: bool, max_bytes: int) -> DataFrame:
    """(group, size, k1, k2, a, b) as in ``repeats``; copies of a text may give a row more than once."""
    if length <= GRAM:
        raise ValueError(f"the length must exceed {GRAM} bytes")
    texts = docs.select(F.lit(0).alias("id"), text_of(docs, text_col).alias("text")).filter(F.octet_length("text") >= length)
    seen = stored(texts.mapInArrow(_occurrences(length), "gram long, hash long, k1 long, k2 long, place long, a long, b long, n long"), "segments")
    counted = seen.groupBy("gram").agg(F.sum("n").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    grams = stored(counted.filter("n > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed")), "grams")
    hits = stored(seen.select("gram", "k1", "k2", "place", "a", "b").join(grams, "gram"), "hits")
    plain = hits.filter("not mixed").select(F.lit(None).cast("string").alias("group"), F.lit(0).cast("long").alias("size"), "k1", "k2", "a", "b")
    wanted = hits.filter("mixed").groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "a", "b")).alias("segs"))  # at most a text's segments
    packed = texts.mapInArrow(_packed, "ids array<int>, k1 long, k2 long, packed binary")
    cut = packed.select("k1", "k2", F.size("ids").cast("long").alias("n"), "packed").join(wanted, ["k1", "k2"]).select("k1", "k2", "n", "segs", "packed")
    cut = cut.mapInArrow(_cut_out(length), "core long, g1 long, g2 long, n long, k1 long, k2 long, a long, b long, left long, gram_at long, data binary")
    scanned = cut.repartition("core").sortWithinPartitions("core", "g1", "g2")
    return plain.union(scanned.mapInArrow(_scan(length, groups, max_bytes), "group string, size long, k1 long, k2 long, a long, b long"))


def repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, groups: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(group, size, k1, k2, a, b): rows without a group are runs a..b of repeated starts of the text with that key; with
    ``groups``, rows with one are the occurrences of maximal repeats that the suffix arrays found (start a)."""
    return _found(docs, text_col, length, groups, max_bytes).distinct()


def _keep(length: int):
    """Rows (ids, packed text, spans) to one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            for packed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = unpack(packed)
                merged: list[list[int]] = []
                for s in sorted((s["a"], s["b"] + length) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((len(text), sum(b - a for a, b in merged), kept.hexdigest(), [x for m in merged for x in m]))
            cols = list(zip(*out)) if out else [()] * 4
            row = pa.array(np.repeat(np.arange(len(out)), batch.column(0).value_lengths().to_numpy(zero_copy_only=False)))
            values = [pa.array(c, k).take(row) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), *values], ["id", "n_bytes", "n_removed", "kept_sha256", "removed"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, kept_sha256, removed): ``removed`` lists first and end (exclusive) of the maximal removed runs, in bytes.

    Ids may be of any type, null or repeated; each row of ``docs`` gives one row. Other columns, whatever their names, are left alone. An
    empty table gives no rows.
    """
    spans = _found(docs, text_col, length, False, max_bytes).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # at most a text's segments
    plain = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    rows = plain.mapInArrow(_packed, f"ids array<{kind}>, k1 long, k2 long, packed binary").join(spans, ["k1", "k2"], "left").select("ids", "packed", "spans")
    return rows.mapInArrow(_keep(length), f"id {kind}, n_bytes long, n_removed long, kept_sha256 string, removed array<long>").withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", (F.size("removed") / 2).cast("long").alias("n_spans"), "kept_sha256")


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """Plain reference: n_bytes, n_removed, n_spans, kept_sha256 of each text."""
    data = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            count[d[i: i + length]] = count.get(d[i: i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i: i + length]] > 1:
                gone[i: i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out
