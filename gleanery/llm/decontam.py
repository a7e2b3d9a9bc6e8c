"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows of the test items.

Normalising lower-cases A-Z and turns every ASCII byte that is neither a letter nor a digit into a word break; bytes of other
characters are word bytes. A window is ``n`` consecutive item words; an item with fewer words, but at least one, is one window. The
patterns are the windows with a space on each side, so the automaton can only match whole words, and each text is scanned once,
whatever the number of items. A match ends at a place in the normalised text; the words before it give the word index, and the words'
places in the original text give the offsets.

Item sets are cut into automata of at most ``max_patterns`` windows (by hash of the window), each of which is one bounded broadcast;
texts are then scanned once for each. Nothing is dropped when the set of items outgrows one automaton.

Null texts have no words. Null or empty items give no window; repeated items share windows and are all reported. Extra columns of the
documents pass through; one whose name a new column takes is replaced.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import stored, text_of, utf8_rows

WINDOW = 10
MAX_PATTERNS = 20_000  # windows in one automaton, about 100 MB in a worker

#: Byte table of the normaliser: A-Z lower-cased, other ASCII outside 0-9a-z a space, the rest as it is.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    # split on the space only: other ASCII blanks are spaces by now
    return [w for w in text.translate(TABLE).split(b" ") if w]


def windows_of(text: bytes, n: int) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i: i + n]) for i in range(max(1, len(words) - n + 1))}


def item_windows(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct windows with the ids of their items as strings: (window binary, items array<string>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out_id, out_w = batch.column(0).to_pylist(), [], []
            for item, text in zip(ids, utf8_rows(batch.column(1))):
                for w in windows_of(text, n):
                    out_id.append(item)
                    out_w.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(out_w, pa.binary()), pa.array(out_id, pa.string())], ["window", "item"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), text_of(items, text_col).alias("text"))
    found = rows.mapInArrow(run, "window binary, item string").filter("item is not null")
    return found.groupBy("window").agg(F.collect_set("item").alias("items"))


class Scanner:
    """One automaton; ``spans`` gives the matched word spans of a text and the items behind them."""

    def __init__(self, patterns: list[tuple[bytes, list[str]]]) -> None:
        self.auto = ahocorasick.Automaton()
        for window, items in patterns:
            self.auto.add_word(" " + window.decode("latin-1") + " ", (len(window) + 1, window.count(b" ") + 1, items))
        self.auto.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans (first, end exclusive) that match, in text order, and the items."""
        text = " " + b" ".join(words).decode("latin-1") + " "
        hits = list(self.auto.iter(text))
        if not hits:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        ends = np.searchsorted(spaces, [e for e, _ in hits])  # the closing space of word k-1 is space k
        found: set[str] = set()
        for _, (_, _, items) in hits:
            found.update(items)
        return [(int(e) - k, int(e)) for e, (_, (_, k, _)) in zip(ends, hits)], found


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _word_offsets(text: bytes, words: list[bytes]) -> list[tuple[int, int]]:
    """Byte offsets of each word in the original text."""
    clean, at, out = text.translate(TABLE), 0, []
    for w in words:
        at = clean.index(w, at) if clean[at: at + len(w)] != w else at
        out.append((at, at + len(w)))
        at += len(w)
        while at < len(clean) and clean[at] == 32:
            at += 1
    return out


def find_contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW,
    max_patterns: int = MAX_PATTERNS, prefix: str = "", offsets: bool = True,
) -> DataFrame:
    """Documents with ``n_words``, ``n_hit``, ``items`` (sorted as strings) and, with ``offsets``, the hit runs as code point
    offsets in the original text (``hit_spans``: first, end exclusive). ``prefix`` is put before the new column names."""
    spark = docs.sparkSession
    windows = stored(item_windows(items, item_id, item_text, n), "windows")
    total = windows.count()
    parts = max(1, -(-total // max_patterns))
    new = [T.StructField(prefix + "n_words", T.LongType(), False), T.StructField(prefix + "hit_runs", T.ArrayType(T.LongType(), False), False),
           T.StructField(prefix + "items", T.ArrayType(T.StringType(), False), False), T.StructField(prefix + "hit_spans", T.ArrayType(T.LongType(), False), False)]
    fresh = {f.name for f in new} | {prefix + "n_hit"}
    docs = docs.select(*[docs[c] for c in docs.columns if c not in fresh or c == text_col])
    out, names = docs, docs.columns
    hidden = "_decontam_text"
    while hidden in names:
        hidden += "_"
    for part in range(parts):
        mine = windows if parts == 1 else windows.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        patterns = [(bytes(r.window), sorted(r["items"])) for r in mine.collect()]  # at most about max_patterns rows
        shared = spark.sparkContext.broadcast(pickle.dumps(patterns))
        first, last = part == 0, part == parts - 1
        keep = names if first else [*names, *[f.name for f in new]]
        schema = T.StructType([*docs.schema.fields, *new])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last, width=len(keep)) -> Iterator[pa.RecordBatch]:
            given = pickle.loads(shared.value)
            scanner = Scanner(given) if given else None
            for batch in batches:
                before = None if first else [batch.column(len(names) + i).to_pylist() for i in range(4)]
                n_words, runs, found, spans = [], [], [], []
                for i, text in enumerate(utf8_rows(batch.column(width))):
                    words = words_of(text)
                    hit, ids = scanner.scan(words) if scanner and words else ([], set())
                    if before:
                        old = before[1][i]
                        hit = hit + list(zip(old[::2], old[1::2]))
                        ids |= set(before[2][i])
                    hit = _union(hit)
                    n_words.append(len(words))
                    runs.append([x for s in hit for x in s])
                    found.append(sorted(ids))
                    spans.append(_code_points(text, words, hit) if hit and last and offsets else [])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(j) for j in range(len(names))], pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())),
                     pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))], [f"c{j}" for j in range(len(names) + 4)])

        ready = out.withColumn(hidden, text_of(out, text_col))
        safe = T.StructType([T.StructField(f"c{j}", f.dataType, f.nullable) for j, f in enumerate(schema.fields)])
        out = ready.mapInArrow(run, safe).toDF(*[f.name for f in schema.fields])
    pairs = F.col(prefix + "hit_runs")
    size = F.aggregate(F.transform(pairs, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn(prefix + "n_hit", size)


def _code_points(text: bytes, words: list[bytes], hit: list[tuple[int, int]]) -> list[int]:
    at = _word_offsets(text, words)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])  # code points that begin before a byte
    return [int(x) for a, b in hit for x in (points[at[a][0]], points[at[b - 1][1]])]


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, then the hit runs as code point offsets in the original text."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "hit_spans",
    )


def brute_force(text: str | None, items: list[tuple[object, str | None]], n: int = WINDOW) -> tuple[int, int, int, str]:
    """Plain reference: (n_words, n_hit, n_items, items_sha256)."""
    words = words_of((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        for w in windows_of((body or "").encode(), n):
            parts = w.split(b" ")
            for i in range(len(words) - len(parts) + 1):
                if words[i: i + len(parts)] == parts:
                    hit.update(range(i, i + len(parts)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
