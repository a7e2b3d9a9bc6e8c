"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by the workers that score.

Tokens are the words (A-Z lower-cased, split at ASCII blanks) and one end per text; the first word's context is a begin mark, which is no
token. p(w | v) = max(c(vw) - D(c), 0) / c(v) + g(v) p(w), with p(w) the same over continuation counts (different words before w) and
1 / (V + 1) below it, so an unknown word has mass too. D1, D2, D3+ come from the counts of counts of each order.

Counting: a task counts the pairs of a few hundred thousand tokens at a time and deals sorted blocks of pairs by shards of the first word's hash; pairs
of very frequent first words (found on a sample, for balance only) are dealt by the pair's hash. A shard's task adds up its blocks,
writes the sorted pair hashes and counts, and passes on per-word sums: occurrences, followers seen once, twice and more, and different
words before. These are dealt and written alike. The number of shards follows the bytes of text, so no task or file grows with the corpus.

Scoring: each worker maps the files (only the pages it touches are read) and looks up the distinct, sorted hashes of a piece of text at once.
Words and pairs are known by 64-bit hashes. Null text is empty: one token, the end. Rows without an id may teach. Nothing to learn from
gives V = 0 and every word the probability 1. Repeated rows count as often as they occur; input columns named like a new column are replaced.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import filesystem, fresh_dir, local_path, mix64, stored, text_of, utf8_rows

SHARD_BYTES, MIN_SHARDS, PIECE, SAMPLE = 8 << 20, 16, 200_000, 0.01


class Hashes(dict):
    """Signed 64-bit hash of a word."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(xxhash.xxh64_digest(word, 0), "little", signed=True)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 400_000:
            self.clear()
        return np.array([self[w] for w in words], np.int64)


BEGIN, END = Hashes()[b" begin"], Hashes()[b" end"]  # no word holds a blank
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(first.view(np.uint64)) * _ODD + second.view(np.uint64)).view(np.int64)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 == 2, F.lit(False))


def shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    """Number of the shard by the leading bits; shards in order hold hashes in (signed) order."""
    return (h >> np.int64(64 - bits)) + (1 << (bits - 1))


def pair_shard(first: np.ndarray, keys: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    return shard_of(np.where(np.isin(first, hot), keys, first), bits)


def _pieces(column: pa.Array, hashes: Hashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token hashes, tokens per text) of about PIECE tokens at a time; a text's tokens end with END."""
    parts, lengths, size = [], [], 0
    for text in utf8_rows(column):
        part = hashes.of([*text.lower().split(), b" end"])
        parts.append(part)
        lengths.append(len(part))
        size += len(part)
        if size >= PIECE:
            yield np.concatenate(parts), np.array(lengths)
            parts, lengths, size = [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(lengths)


def _contexts(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = BEGIN
    return before


def _pack(*columns: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.stack([c.astype(np.int64) for c in columns])).tobytes()


def _unpack(blobs: list[bytes], width: int) -> list[np.ndarray]:
    parts = [np.frombuffer(b, np.int64).reshape(width, -1) for b in blobs]
    return list(np.concatenate(parts, axis=1)) if parts else [np.zeros(0, np.int64)] * width


def _deal(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A block per shard; rows must be sorted by shard."""
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(shard[a]), _pack(*(c[a:b] for c in columns))


def _pair_blocks(hot: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for tokens, lengths in _pieces(batch.column(0), hashes):
                before = _contexts(tokens, lengths)
                keys, at, n = np.unique(pair_keys(before, tokens), return_index=True, return_counts=True)
                first, second = before[at], tokens[at]
                shard = pair_shard(first, keys, hot, bits)
                order = np.lexsort((first, shard))
                rows = list(_deal(shard[order], first[order], second[order], n[order]))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "block"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks of each shard; rows come sorted by shard."""
    current, blobs = None, []
    for batch in batches:
        for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if shard != current:
                if blobs:
                    yield current, blobs
                current, blobs = shard, []
            blobs.append(block)
    if blobs:
        yield current, blobs


def _save(folder: str, name: str, array: np.ndarray) -> None:
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    data = io.BytesIO()
    np.save(data, array)
    part = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(part) as out:
        out.write(data.getbuffer())
    store.move(part, f"{root}/{name}")


def _sums(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    if not len(keys):
        return [keys, *columns]
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return [k[at], *(np.add.reduceat(c[order], at) for c in columns)]


def _write_pairs(folder: str, bits: int):
    """Writes each shard of pairs; passes on (shard, block) of word sums, and its counts of counts under shard -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blobs in _grouped(batches):
            first, second, n = _unpack(blobs, 3)
            keys = pair_keys(first, second)
            order = np.argsort(keys, kind="stable")
            keys, first, second, n = keys[order], first[order], second[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, first, second, n = keys[at], first[at], second[at], np.add.reduceat(n, at)
            _save(folder, f"pair-key-{shard}.npy", keys)
            _save(folder, f"pair-n-{shard}.npy", np.minimum(n, 2**32 - 1).astype(np.uint32))
            before, *sums = _sums(first, n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
            after, different = _sums(second, np.ones(len(n), np.int64))
            none = np.zeros(len(after), np.int64)
            rows = list(_deal(shard_of(before, bits), before, *sums, np.zeros(len(before), np.int64)))
            rows += _deal(shard_of(after, bits), after, none, none, none, none, different)
            rows.append((-1, _pack(*(np.array([int((n == k).sum())]) for k in (1, 2, 3, 4)), np.array([len(n)]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "block"])

    return run


FACTS = ["words", "tokens", "m1", "m2", "m3", "m4", "types", "n1", "n2", "n3", "n4", "docs"]


def _write_words(folder: str):
    """Writes each shard of words (hash; occurrences, followers once, twice, more, words before); gives facts to add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blobs in _grouped(batches):
            facts = dict.fromkeys(FACTS, 0)
            if shard == -1:
                facts |= dict(zip(["n1", "n2", "n3", "n4", "types"], (int(c.sum()) for c in _unpack(blobs, 5))))
            else:
                words, *sums = _sums(*_unpack(blobs, 6))
                _save(folder, f"word-key-{shard}.npy", words)
                _save(folder, f"word-n-{shard}.npy", np.stack(sums, axis=1))
                token = (words != BEGIN) & (words != END)
                facts |= {"words": int((token & (sums[0] > 0)).sum()), "tokens": int(sums[0][token].sum()), "docs": int(sums[0][words == BEGIN].sum())}
                facts |= {f"m{k}": int((sums[4] == k).sum()) for k in (1, 2, 3, 4)}
            yield pa.RecordBatch.from_pydict({k: [facts[k]] for k in FACTS})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D(0), D1, D2, D3+; 0.75 of a count where the counts of counts can't tell."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else None
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.0] if y is not None else [0.0] * 3
    return np.array([0.0, *(d if 0 < d < k else 0.75 for k, d in zip((1, 2, 3), raw))])


def train(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> str:
    """Model folder of the texts of ``docs``."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "lm")
    texts = docs.select(text_of(docs, text_col).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(MIN_SHARDS, -(-total // shard_bytes)).bit_length()
    # first words worth dealing by pair: a share of tokens above a quarter of a shard's, on a sample (for balance, not for results)
    words = texts.sample(SAMPLE, seed=7).select(F.explode(F.split(F.lower("text"), "[ \t-\r]+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    some = words.agg(F.sum("n")).first()[0] or 0
    often = words.filter(F.col("n") >= max(8, some / (4 << bits))).orderBy(F.desc("n"), "w").limit(8 << bits).collect()
    hot = np.array(sorted({BEGIN, *(Hashes()[r.w.encode()] for r in often)}), np.int64)
    n = 1 << bits
    blocks = texts.mapInArrow(_pair_blocks(hot, bits), "shard long, block binary")
    sums = blocks.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_write_pairs(folder, bits), "shard long, block binary")
    facts = sums.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_write_words(folder), ", ".join(f"{c} long" for c in FACTS))
    got = stored(facts, "facts").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FACTS]).first().asDict()
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/model.json") as out:
        out.write(json.dumps(got | {"bits": bits, "hot": hot.tolist()}).encode())
    if local_path(folder) is None:  # workers can't map a remote file: each executor fetches the files once
        spark.sparkContext.addFile(folder, recursive=True)
    return folder


class Model:
    def __init__(self, folder: str) -> None:
        self.root = local_path(folder) or SparkFiles.get(folder.rstrip("/").rpartition("/")[2])
        with open(f"{self.root}/model.json") as f:
            m = self.facts = json.load(f)
        self.bits, self.hot, self.docs = m["bits"], np.array(m["hot"], np.int64), m["docs"]
        self.vocabulary, self.tokens = m["words"] + (self.docs > 0), m["tokens"] + self.docs
        self.d2, self.d1 = discounts(m["n1"], m["n2"], m["n3"], m["n4"]), discounts(m["m1"], m["m2"], m["m3"], m["m4"])
        self.types = max(1, m["types"])
        more = self.vocabulary - m["m1"] - m["m2"]
        self.rest = float(self.d1[1:] @ np.array([m["m1"], m["m2"], more])) / self.types if self.vocabulary else 1.0
        self.open = lru_cache(maxsize=None)(self._open)

    def _open(self, name: str) -> np.ndarray | None:
        try:
            return np.load(f"{self.root}/{name}.npy", mmap_mode="r")
        except FileNotFoundError:
            return None  # a shard without rows

    def _find(self, kind: str, keys: np.ndarray, shards: np.ndarray, width: int) -> np.ndarray:
        """Values of sorted keys; zeros where a key is unknown. Keys of a shard must be sorted."""
        out = np.zeros((len(keys), width), np.int64)
        for shard in np.unique(shards).tolist():
            mine = np.flatnonzero(shards == shard)
            known, values = self.open(f"{kind}-key-{shard}"), self.open(f"{kind}-n-{shard}")
            if known is None or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
            hit = known[at] == keys[mine]
            out[mine[hit]] = np.asarray(values[at[hit]]).reshape(int(hit.sum()), width)
        return out

    def word_facts(self, words: np.ndarray) -> np.ndarray:
        return self._find("word", words, shard_of(words, self.bits), 5)

    def score(self, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: known tokens, base score, model score."""
        before = _contexts(tokens, lengths)
        words, place = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        facts = self.word_facts(words)
        at, prior = place[: len(tokens)], place[len(tokens):]
        count = facts[:, 0].copy()
        count[words == END] = self.docs  # an end has no follower; it ends each training text
        cont = facts[:, 4]
        low = np.maximum(cont - self.d1[np.minimum(cont, 3)], 0.0) / self.types + self.rest / (self.vocabulary + 1)
        total = facts[:, 0]
        gamma = np.where(total > 0, facts[:, 1:4] @ self.d2[1:] / np.maximum(total, 1), 1.0)
        keys, row, back = np.unique(pair_keys(before, tokens), return_index=True, return_inverse=True)
        seen = self._find("pair", keys, pair_shard(before[row], keys, self.hot, self.bits), 1)[:, 0][back]
        high = np.maximum(seen - self.d2[np.minimum(seen, 3)], 0.0) / np.maximum(total[prior], 1)
        p = high + gamma[prior] * low[at]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        base = np.log10((count[at] + 1.0) / (self.tokens + self.vocabulary + 1.0))
        return np.add.reduceat((count[at] > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


def score_texts(docs: DataFrame, folder: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10) and ``perplexity``."""
    new = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("perplexity", T.DoubleType())]
    docs = docs.select(*[docs[c] for c in docs.columns if c not in dict(new)])
    names = docs.columns
    fields = [T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)] + [T.StructField(n, k) for n, k in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes = Model(folder), Hashes()
        for batch in batches:
            parts = [(lengths, *model.score(tokens, lengths)) for tokens, lengths in _pieces(batch.column(len(names)), hashes)]
            n, known, base, score = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(base, pa.float64()),
                 pa.array(score, pa.float64()), pa.array(10.0 ** (-score / np.maximum(n, 1)), pa.float64())], [f.name for f in fields])

    ready = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], text_of(docs, text_col).alias("_text"))
    return ready.mapInArrow(run, T.StructType(fields)).toDF(*names, *dict(new))


def digest(docs: DataFrame) -> DataFrame:
    folder = train(docs.filter(~held_out(F.col("doc_id"))).select("text"))
    scored = score_texts(docs.select("doc_id", "text"), folder)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
