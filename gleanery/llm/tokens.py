"""Token counts by count-only Viterbi over a unigram vocabulary.

The text becomes one mark and then itself with each space turned into a mark (U+2581); an empty or null text has no tokens. One Aho-Corasick
automaton gives all pieces that end at a place; the place keeps the best sum of scores and the number of pieces on the way, so neither
pieces nor paths are built. Tie rules are those of the public unigram tokenizer: candidates of a place come by their start, and only a
strictly better one replaces the best, so the longest piece wins; a character that is no piece by itself costs the smallest score less
10 and counts as its UTF-8 bytes if the vocabulary has byte pieces, else a run of such characters counts once.

If no piece holds a mark after another character, no piece spans the place before a run of marks: best paths decompose there, and each
different stretch is decoded once per worker. With such pieces whole texts are decoded.

The vocabulary is a parameter: a file of pieces with scores, read where the query starts and sent to the tasks (its size is the file's, whatever the corpus).
Repeated rows are counted each; input columns named like a new column are replaced.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleanery.llm.common import text_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK, PENALTY, HELD = "▁", 10.0, 300_000
_STRETCH = re.compile(f"{MARK}+[^{MARK}]*")


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, float]  # piece -> score; scores are whole numbers or sums of them are rounded alike everywhere
    has_bytes: bool

    @staticmethod
    def load(path: str = VOCABULARY) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        return Vocabulary(plain, sum(model.is_byte(i) for i in ids) == 256)


class Counter:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min(vocabulary.pieces.values()) - PENALTY
        self.has_bytes = vocabulary.has_bytes
        self.splits = not any(MARK in p.lstrip(MARK) for p in vocabulary.pieces)
        self.held: dict[str, tuple[int, float, int]] = {}

    def decode(self, text: str) -> tuple[int, float, int]:
        """(pieces, score, unknown characters) of the best path."""
        n = len(text)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        in_run = [False] * (n + 1)
        matches = self.auto.iter(text)
        pending = next(matches, None)
        for end in range(1, n + 1):
            best, single = None, False
            while pending is not None and pending[0] == end - 1:  # longest first
                length, gain = pending[1]
                single |= length == 1
                value = score[end - length] + gain
                if best is None or value > best:
                    best, start = value, end - length
                pending = next(matches, None)
            bad = False
            if not single:
                value = score[end - 1] + self.unknown
                if best is None or value > best:
                    best, start, bad = value, end - 1, True
            score[end], unknown[end], in_run[end] = best, unknown[start] + bad, bad
            if not bad:
                count[end] = count[start] + 1
            elif self.has_bytes:
                count[end] = count[start] + len(text[end - 1].encode())
            else:
                count[end] = count[start] + (not in_run[start])
        return count[n], score[n], unknown[n]

    def count(self, text: str) -> tuple[int, float, int]:
        if not text:
            return 0, 0.0, 0
        marked = MARK + text.replace(" ", MARK)
        if not self.splits:
            return self.decode(marked)
        held, pieces, score, unknown = self.held, 0, 0.0, 0
        for stretch in _STRETCH.findall(marked):
            got = held.get(stretch)
            if got is None:
                got = self.decode(stretch)
                if len(held) >= HELD:
                    held.clear()
                if len(stretch) <= 64:
                    held[stretch] = got
            pieces += got[0]
            score += got[1]
            unknown += got[2]
        return pieces, score, unknown


NEW = [("n_tokens", T.LongType()), ("token_score", T.DoubleType()), ("n_unknown", T.LongType())]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``token_score`` (of the best path) and ``n_unknown`` (characters outside the vocabulary)."""
    docs = docs.select(*[docs[c] for c in docs.columns if c not in dict(NEW)])
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(vocabulary))
    fields = [T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)] + [T.StructField(n, k) for n, k in NEW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pickle.loads(shared.value))
        for batch in batches:
            got = [counter.count(t) for t in batch.column(len(names)).to_pylist()]
            cols = list(zip(*got)) if got else [()] * 3
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.float64(), pa.int64()))]], [f.name for f in fields])

    ready = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], text_of(docs, text_col).alias("_text"))
    return ready.mapInArrow(run, T.StructType(fields)).toDF(*names, *dict(NEW))
