"""Quality rules and line labelling: a linear-chain conditional random field marks each line content or boilerplate.

A line is described by one value of each of a few shape features (length, symbols, capitals, bars, repeated words, repeated line, ending,
place). The field has a weight for each value and label, for each pair of neighbouring labels and for the first label; it is fitted by gradient
steps on the likelihood over a bounded sample of documents with a quality label (the ``max_docs`` smallest by hash of the id, leaving out texts
of over ``max_lines`` lines), whose lines take the document's label, save that a line seen before in its text is boilerplate. Viterbi
decoding labels whole texts; a text is kept if the base rules pass and content lines hold at least ``min_share`` of its line characters.

Lines without a word have no label and no weight. Null and empty texts have no words and fail the base rules. Without labelled documents
every line is content. Ties in decoding go to content. Repeated rows are judged each; input columns named like a new column are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import text_of, utf8_rows

MAX_DOCS, MAX_LINES, STEPS, RATE, L2, MIN_SHARE, MIN_WORDS = 4000, 300, 120, 0.3, 1e-3, 0.5, 50
SYMBOLS = b"#*$%&|<>"
#: Number of values of each feature of a line.
VALUES = [7, 5, 3, 4, 5, 2, 4, 3]
OFFSETS = np.concatenate([[0], np.cumsum(VALUES)[:-1]]).tolist()
_DELETE = bytes(SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))


def _level(x: float, bounds: tuple[float, ...]) -> int:
    return sum(x > b for b in bounds)


def line_features(line: bytes, words: list[bytes], repeated: bool, place: int) -> list[int]:
    n = len(words)
    symbols = (len(line) - len(line.translate(None, _DELETE))) / n
    loud = line.count(b"!") / n
    upper, lower = line.upper(), line.lower()
    capitals = 0 if upper == lower else 2 if upper == line else 1 if sum(w[:1].isupper() for w in words) * 2 > n else 0
    distinct = len(set(words)) / n
    last = line.rstrip()[-1:]
    values = [
        _level(n, (2, 5, 10, 20, 40, 80)), _level(symbols, (0, 0.1, 0.5, 1.5)), capitals, _level(loud, (0, 0.2, 1)),
        _level(distinct, (0.2, 0.4, 0.6, 0.8)), int(repeated), 0 if last == b"." else 1 if last in (b"!", b"?", b",") else 2 if last.isalnum() else 3, place,
    ]
    return [o + v for o, v in zip(OFFSETS, values)]


def describe(text: bytes) -> tuple[list[list[int]], list[int], list[int]]:
    """(features, characters, line number) of each line with a word."""
    feats, sizes, numbers, seen = [], [], [], set()
    lines = text.split(b"\n")
    for i, line in enumerate(lines):
        words = line.split()
        if not words:
            continue
        place = 0 if not feats else 1
        feats.append(line_features(line, words, line in seen, place))
        seen.add(line)
        sizes.append(len(line.translate(None, _CONTINUED)))
        numbers.append(i)
    if len(feats) > 1:
        feats[-1][-1] = OFFSETS[-1] + 2
    return feats, sizes, numbers


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    many = count[window] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k: k + len(many)] |= many
    return int(hit.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words, seen, dup = text.split(), set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    chars = len(b"".join(words).translate(None, _CONTINUED))
    return len(words), chars, len(text) - len(text.translate(None, _DELETE)), dup, repeat_words(words)


class Field:
    """Weights of a two-label chain: 1 content, 0 boilerplate."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> None:
        self.emit, self.move, self.first = emit, move, first

    def decode(self, feats: list[list[int]]) -> list[int]:
        if not feats:
            return []
        scores = self.emit[np.array(feats)].sum(axis=1).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0][0] + self.first[0], scores[0][1] + self.first[1]
        back = []
        for s0, s1 in scores[1:]:
            from0, from1 = b + m10 >= a + m00, b + m11 >= a + m01
            back.append((from0, from1))
            a, b = s0 + (b + m10 if from0 else a + m00), s1 + (b + m11 if from1 else a + m01)
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def fit_field(docs: list[tuple[list[list[int]], list[int]]], steps: int = STEPS, rate: float = RATE, l2: float = L2) -> Field:
    """Gradient ascent (Adam) on the mean log-likelihood per line of (features, labels) sequences."""
    n, most = len(docs), max(len(f) for f, _ in docs)
    x = np.zeros((n, most, len(VALUES)), np.int64)
    y, live = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for i, (f, labels) in enumerate(docs):
        x[i, : len(f)], y[i, : len(f)], live[i, : len(f)] = f, labels, True
    weights = np.zeros((sum(VALUES) + 3, 2))  # emissions, then moves (from 0, from 1), then first labels
    m, v, total = np.zeros_like(weights), np.zeros_like(weights), live.sum()
    seen = np.zeros_like(weights)
    np.add.at(seen, (x[live].ravel(), np.repeat(y[live], len(VALUES))), 1.0)
    both = live[:, 1:]
    np.add.at(seen, (sum(VALUES) + y[:, :-1][both], y[:, 1:][both]), 1.0)
    np.add.at(seen, (np.full(n, sum(VALUES) + 2), y[:, 0]), 1.0)
    for step in range(1, steps + 1):
        emit, move, first = weights[: sum(VALUES)], weights[sum(VALUES): -1], weights[-1]
        local = emit[x].sum(axis=2)
        fwd, bwd = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fwd[:, 0] = local[:, 0] + first
        for t in range(1, most):
            ahead = np.logaddexp(fwd[:, t - 1, :1] + move[0], fwd[:, t - 1, 1:] + move[1]) + local[:, t]
            fwd[:, t] = np.where(live[:, t, None], ahead, fwd[:, t - 1])
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        for t in range(most - 2, -1, -1):
            after = local[:, t + 1] + bwd[:, t + 1]
            behind = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
            bwd[:, t] = np.where(live[:, t + 1, None], behind, 0.0)
        share = np.exp(fwd + bwd - z[:, None, None])
        expected = np.zeros_like(weights)
        for label in (0, 1):
            expected[: sum(VALUES), label] = np.bincount(x[live].ravel(), np.repeat(share[..., label][live], len(VALUES)), sum(VALUES))
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(fwd[:, :-1, a] + move[a, b] + local[:, 1:, b] + bwd[:, 1:, b] - z[:, None])
                expected[sum(VALUES) + a, b] = pair[both].sum()
        expected[-1] = share[:, 0].sum(axis=0)
        slope = (seen - expected) / total - l2 * weights
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        weights = weights + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(weights[: sum(VALUES)], weights[sum(VALUES): -1], weights[-1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Field | None:
    """Field fitted on the sample; a document with several label rows takes the lowest."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_docs)  # ids and labels only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, y, [x for f in describe(t)[0] for x in f]) for i, y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_rows(batch.column(2)))]
            rows = [r for r in rows if 0 < len(r[2]) <= max_lines * len(VALUES)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["id", "y", "feats"])

    texts = docs.select(docs[id_col].cast("long").alias("_id"), text_of(docs, text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_y", "_text")
    got = sorted((r.id, r.y, list(r.feats)) for r in texts.mapInArrow(run, "id long, y long, feats array<long>").collect())  # at most max_docs documents of max_lines lines
    sequences = []
    for _, y, flat in got:
        feats = [flat[i: i + len(VALUES)] for i in range(0, len(flat), len(VALUES))]
        sequences.append((feats, [int(y == 1 and f[5] == OFFSETS[5]) for f in feats]))
    return fit_field(sequences) if sequences else None


NEW = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("content_share", T.DoubleType()), ("boilerplate_lines", T.ArrayType(T.LongType()))]


def judge(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``content_share`` and ``boilerplate_lines`` (numbers of the lines marked boilerplate, from 0)."""
    docs = docs.select(*[docs[c] for c in docs.columns if c not in dict(NEW)])
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field))  # a few dozen weights
    fields = [T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)] + [T.StructField(n, k) for n, k in NEW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in batches:
            rows = []
            for text in utf8_rows(batch.column(len(names))):
                feats, sizes, numbers = describe(text)
                marks = model.decode(feats) if model else [1] * len(feats)
                content = sum(s for s, mark in zip(sizes, marks) if mark)
                rows.append((*base_counts(text), content / sum(sizes) if sizes else 0.0, [n for n, mark in zip(numbers, marks) if not mark]))
            cols = list(zip(*rows)) if rows else [()] * len(NEW)
            kinds = [*[pa.int64()] * 5, pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *[pa.array(c, k) for c, k in zip(cols, kinds)]], [f.name for f in fields])

    ready = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], text_of(docs, text_col).alias("_text"))
    return ready.mapInArrow(run, T.StructType(fields)).toDF(*names, *dict(NEW))


def digest(judged: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *[n for n, _ in NEW[:5]], failed.alias("base_failed"), (~failed & (F.col("content_share") >= min_share)).alias("kept"), "content_share")
