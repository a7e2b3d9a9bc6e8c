"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased runs of letters: every word of every example counts, whatever the toxic share and however few the labels. Words and
starts of words (4 to 6 letters, ``start*``, for inflected and compound forms) that tell the label apart among a bounded sample of labelled
training texts (the ``max_labelled`` smallest by hash of the id that have a document; toxic odds of at least three times the usual ones and a
likelihood ratio G2 of at least ``min_g2``; the ``max_terms`` strongest) count three times as much; without any, the words decide alone. Term
frequencies are damped (1 + ln tf), document frequencies are counted over all documents, and vectors are scaled to length 1.

The examples are the ``max_examples`` smallest of that sample by hash of the id, so long as they have a word. They are laid out in blocks of
``block`` rows and indexed by term: rare terms by posting lists, terms of more than one row in ``DENSE`` by their weight in every row and their
largest weight in each block. A query adds up the lists of its rare terms, then what its common terms can add at most in each block; the common
terms of a row are added only if that bound reaches the k-th best of the rows with the largest bounds. Every query goes this way, whatever its length.
The top k by cosine is exact; ties go to the smaller example id. The vote is the cosine-weighted share of toxic neighbours, and votes are turned
into probabilities by monotone steps fitted on the examples themselves, each scored without itself. A text at cosine 1 of examples takes the toxic share of those.

A text without a word (null and empty texts too) has no neighbour and takes the toxic share of such training texts, one clean text added; a
text that shares no word with an example takes the calibrated usual share. Labels, language,
source and id are never inputs: the id, of any type, only decides which rows may teach. Repeated rows are scored each. Tables without labelled
training rows give 0 to every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import stored, text_of

MAX_LABELLED, MAX_EXAMPLES, MAX_TERMS, MIN_G2, NEIGHBOURS, BLOCK, THRESHOLD, MIN_ODDS, TELLING = 20_000, 4000, 4096, 25.0, 25, 8, 0.3, 3.0, 3.0
PREFIXES = (4, 5, 6)
DENSE = 4  # a term of more than one example in 4 is common
_WORD = re.compile(r"[^\W\d_]+")
#: ASCII bytes other than letters are spaces, A-Z is lower-cased, bytes of other characters stay.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4 == 2


def words_of(text: str) -> list[str]:
    """The matches of ``_WORD`` in the lower-cased text; the expression only runs on pieces with other characters than letters."""
    if text.isascii():
        return text.encode().translate(_BYTES).decode().split()
    pieces = text.lower().encode("utf-8", "surrogatepass").translate(_BYTES).decode("utf-8", "surrogatepass").split()
    return [w for piece in pieces for w in ((piece,) if piece.isalpha() else _WORD.findall(piece))]


def terms_of(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) >= k]]


def _labelled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of texts that hold each term: (term, texts, toxic texts)."""
    for batch in batches:
        both: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for term in {t for w in set(words_of(text)) for t in terms_of(w)}:
                n = both.setdefault(term, [0, 0])
                n[0] += 1
                n[1] += toxic
        yield pa.RecordBatch.from_arrays([pa.array(both.keys(), pa.string()), pa.array([n for n, _ in both.values()], pa.int64()), pa.array([t for _, t in both.values()], pa.int64())], ["term", "n", "t"])


def choose_terms(training: DataFrame, max_terms: int, min_g2: float) -> list[str]:
    """Terms that tell the label apart, strongest first; ``training`` has text and toxic (0 or 1)."""
    size = training.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not size.n or not size.t or size.t == size.n:
        return []
    counts = training.select("text", "toxic").mapInArrow(_labelled_terms, "term string, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    share = size.t / size.n

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, t = F.col("n"), F.col("t")
    g2 = 2 * (part(t, n * share) + part(n - t, n * (1 - share)) + part(F.lit(size.t) - t, (F.lit(size.n) - n) * share) + part(F.lit(size.n - size.t) - (n - t), (F.lit(size.n) - n) * (1 - share)))
    odds = (t + 0.5) * (size.n - size.t + 0.5) / ((n - t + 0.5) * (size.t + 0.5))
    best = counts.filter(odds >= MIN_ODDS).withColumn("g2", g2).filter(F.col("g2") >= min_g2).orderBy(F.desc("g2"), "term").limit(max_terms)
    return [r.term for r in best.collect()]


class _Known(dict):
    """Number of each word's term, -1 for none; words of several terms get numbers from ``len(terms)`` on, expanded by ``several``."""

    def __init__(self, terms: list[str]) -> None:
        super().__init__()
        self.number, self.several = {t: i for i, t in enumerate(terms)}, []
        self.same: dict[tuple[int, ...], int] = {}

    def __missing__(self, word: str) -> int:
        hits = tuple(self.number[t] for t in terms_of(word) if t in self.number)
        at = hits[0] if len(hits) == 1 else -1
        if len(hits) > 1:
            at = self.same.get(hits, -1)
            if at < 0:
                at = self.same[hits] = len(self.number) + len(self.several)
                self.several.append(np.array(hits, np.int64))
        if len(self) > 300_000:
            self.clear()
        self[word] = at
        return at


class TermCounter:
    """Numbers and frequencies of a text's terms: ``terms`` are words and starts (``start*``)."""

    def __init__(self, terms: list[str]) -> None:
        self.n, self.known = len(terms), _Known(terms)

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Terms (ascending), their frequencies, and whether the text has any word, known or not."""
        words = Counter(words_of(text))
        found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        tf = np.fromiter(words.values(), np.int64, len(words))
        extra = np.flatnonzero(found >= self.n)
        if len(extra):
            parts = [self.known.several[i - self.n] for i in found[extra].tolist()]
            tf = np.concatenate([tf, np.repeat(tf[extra], [len(p) for p in parts])])
            found[extra] = -1
            found = np.concatenate([found, *parts])
        by = np.argsort(found, kind="stable")
        by = by[np.searchsorted(found[by], 0):]
        found, tf = found[by], tf[by]
        if len(found):  # a start may come from several words
            at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            found, tf = found[at], np.add.reduceat(tf, at)
        return found, tf, bool(words)


def document_frequencies(texts: DataFrame, terms: pa.Array) -> tuple[int, np.ndarray]:
    """Number of texts, and of those that hold each term; ``texts`` has one column."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, df, n = TermCounter(shared.value.to_pylist()), np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                df[counter.count(text)[0]] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int64()), pa.array(np.append(df[seen], n), pa.int64())], ["term", "n"])

    got = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row per term
    shared.destroy()
    df = np.zeros(len(terms) + 1, np.int64)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()  # -1, the texts, is the last place
    return int(df[-1]), df[:-1]


class BlockMaxIndex:
    """Exact top-k cosine over unit vectors of (term, weight).

    Rows are laid out by their heaviest term, so that a block holds alike rows. A rare term has its posting list; a common one has its weight
    in each row and its largest weight in each block.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK) -> None:
        heaviest = np.array([t[np.argmax(w)] for t, w in vectors], np.int64)
        self.row = np.argsort(heaviest, kind="stable")
        self.place = np.argsort(self.row)
        self.n, self.block = len(vectors), block
        terms = np.concatenate([vectors[r][0] for r in self.row])
        weights = np.concatenate([vectors[r][1] for r in self.row])
        rows = np.repeat(np.arange(self.n), [len(vectors[r][0]) for r in self.row])
        lengths = np.bincount(terms, minlength=n_terms)
        common = np.flatnonzero(lengths > max(1, self.n // DENSE))
        self.common = np.full(n_terms, -1)
        self.common[common] = np.arange(len(common))
        dense = self.common[terms]
        self.full = np.zeros((self.n, len(common)))  # a row's common weights lie together
        self.full[rows[dense >= 0], dense[dense >= 0]] = weights[dense >= 0]
        self.maxima = np.maximum.reduceat(self.full, np.arange(0, self.n, block), axis=0)
        order = np.flatnonzero(dense < 0)
        order = order[np.argsort(terms[order], kind="stable")]
        self.posted, self.posted_weights = rows[order], weights[order]
        self.lists = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest, by cosine and then row; ``skip`` is a row to leave out. Rows that share no term are left out.

        The k rows of the largest bounds are completed first; then all whose bound reaches the least of those.
        """
        number = self.common[terms]
        rare, often = number < 0, number >= 0
        first, last = self.lists[terms[rare]], self.lists[terms[rare] + 1]
        size = last - first
        start = np.cumsum(size) - size
        flat = np.arange(size.sum()) + np.repeat(first - start, size)
        near = np.bincount(self.posted.take(flat), self.posted_weights.take(flat) * np.repeat(weights[rare], size), self.n)
        query = np.zeros(self.full.shape[1])
        query[number[often]] = weights[often]
        bound = near + np.repeat(self.maxima @ query, self.block)[: self.n]
        if skip >= 0:
            near[self.place[skip]] = bound[self.place[skip]] = -2.0
        seed = np.argpartition(bound, -k)[-k:] if k < self.n else np.arange(self.n)
        sure = (near[seed] + self.full[seed] @ query).min() if len(seed) == k else 0.0  # the k-th best reaches this
        left = np.flatnonzero(bound >= sure - 1e-8) if sure > 1e-8 else np.flatnonzero(bound > 0)
        got = np.round(near[left] + self.full[left] @ query, 9)
        left, got = left[got > 0], got[got > 0]
        if len(got) > k:
            hit = got >= np.partition(got, -k)[-k]
            left, got = left[hit], got[hit]
        best = np.lexsort((self.row[left], -got))[:k]
        return self.row[left[best]], got[best]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array({w for text in batch.column(0).to_pylist() for w in words_of(text)}, pa.string())], ["word"])


def example_counts(examples: DataFrame, terms: pa.Array) -> pa.Table:
    """Terms and their frequencies (lists of numbers) of the ``examples`` (id, text, toxic) that have a word, by id."""
    shared = examples.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(shared.value.to_pylist())
        for batch in batches:
            got = [counter.count(text) for text in batch.column(1).to_pylist()]
            made = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array([g[i] for g in got], pa.list_(pa.int32())) for i in (0, 1)]], ["id", "toxic", "terms", "tf"])
            yield made.filter(pa.array([g[2] for g in got], pa.bool_()))

    lists = [T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("terms", "tf")]
    got = examples.mapInArrow(run, T.StructType([examples.schema["id"], examples.schema["toxic"], *lists])).toArrow()  # no texts
    shared.destroy()
    ids = got.column("id").to_pylist()
    return got.take(pa.array(sorted(range(len(ids)), key=ids.__getitem__), pa.int64())).combine_chunks()


def _vectors(model: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, frequencies) of each example."""
    cuts = model["offsets"][1:-1]
    return list(zip(np.split(model["example_terms"], cuts), np.split(model["example_tf"], cuts)))


def _vector(terms: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = np.asarray(terms, np.int64)
    w = (1.0 + np.log(np.asarray(tf, float))) * idf[terms]
    return terms, w / np.sqrt((w * w).sum())


def _steps(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone step function (pool adjacent violators): (upper edge of each step, share). Edges lie midway between the votes of two steps."""
    order = np.argsort(votes, kind="stable")
    blocks: list[list[float]] = []  # sum, count, upper vote, lower vote
    for v, y in zip(votes[order], labels[order]):
        if blocks and blocks[-1][2] == blocks[-1][3] == v:
            blocks[-1][0] += y
            blocks[-1][1] += 1
        else:
            blocks.append([float(y), 1.0, float(v), float(v)])
        while len(blocks) > 1 and (blocks[-2][2] == v or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            s, n, v2, _ = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, v2, blocks[-1][3]]
    edges = [(b[2] + after[3]) / 2 for b, after in zip(blocks, blocks[1:])] + [b[2] for b in blocks[-1:]]
    return np.array(edges), np.array([(b[0] + 0.02) / (b[1] + 0.04) for b in blocks])


class Scorer:
    def __init__(self, model: dict) -> None:
        self.weight, self.labels, self.ids, self.k = model["weight"], model["labels"], model["ids"], model["k"]
        self.index = BlockMaxIndex([_vector(t, f, self.weight) for t, f in _vectors(model)], len(self.weight))
        self.counter, self.bare = TermCounter(model["terms"].to_pylist()), model["bare"]
        self.base, self.upper, self.share = model["base"], model.get("upper"), model.get("share")
        self.done: dict[bytes, tuple] = {}

    def vote(self, terms: np.ndarray, tf: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        rows, near = self.index.top(*_vector(terms, tf, self.weight), self.k, skip)
        # the nearer the more it counts; what is left of one whole neighbour goes to the usual share
        total = near.sum()
        far = max(0.0, 1.0 - total)
        return float(((near * self.labels[rows]).sum() + far * self.base) / (total + far)), rows, near

    def score(self, text: str) -> tuple[float, list, list]:
        key = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
        if key not in self.done:
            terms, tf, any_word = self.counter.count(text)
            if not any_word:
                return self.bare, [], []
            vote, rows, near = self.vote(terms, tf) if len(terms) else (self.base, [], np.zeros(0))
            at = min(int(np.searchsorted(self.upper, vote - 1e-12)), len(self.upper) - 1)
            if len(self.done) > 50_000:
                self.done.clear()
            same = self.labels[rows[near >= 1 - 1e-9]] if len(near) else near  # examples of the same terms speak for themselves
            share = (same.sum() + 0.02) / (len(same) + 0.04) if len(same) else self.share[at]
            self.done[key] = (float(share), [self.ids[r] for r in rows[:5]], near[:5].tolist())
        return self.done[key]


def fit(texts: DataFrame, teach: DataFrame, telling: list[str], max_examples: int, k: int) -> dict | None:
    """Model of the labelled training rows ``teach`` (id, text, toxic), with document frequencies of ``texts`` (one column)."""
    has_word = F.col("text").rlike(r"\p{L}")
    size = teach.agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.sum((~has_word).cast("int")).alias("bare"), F.sum(F.when(~has_word, F.col("toxic"))).alias("bare_t")).first()
    # chosen and counted by tasks: the driver holds numbers and the terms, as Arrow and numpy arrays, and never the texts
    examples = stored(teach.filter(has_word).orderBy(F.xxhash64("id"), "id").limit(max_examples), "examples")
    words = examples.select("text").mapInArrow(_words, "word string").distinct().toArrow().column("word").combine_chunks()
    if not len(words):
        return None
    terms = pc.unique(pa.concat_arrays([words, pa.array(telling, words.type)]))
    terms = terms.take(pc.sort_indices(terms))
    n_docs, df = document_frequencies(texts, terms)
    idf = np.log((n_docs + 1.0) / (df + 1.0)) + 1.0
    strong = pc.is_in(terms, pa.array(telling, terms.type)).to_numpy(zero_copy_only=False)
    rows = example_counts(examples, terms)
    lists = rows.column("terms").combine_chunks()
    return {
        "terms": terms, "weight": idf * np.where(strong, TELLING, 1.0), "labels": rows.column("toxic").to_numpy().astype(float), "ids": rows.column("id").to_pylist(),
        "offsets": lists.offsets.to_numpy(), "example_terms": lists.values.to_numpy(), "example_tf": rows.column("tf").combine_chunks().values.to_numpy(),
        "k": k, "base": (size.t + 0.02) / (size.n + 0.04), "bare": ((size.bare_t or 0) + 0.02) / (size.bare + 1.0),
    }


def calibrate(model: dict, spark) -> dict:
    """Votes of the examples, each without itself, and the steps that map votes to shares."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, given = Scorer(shared.value), _vectors(shared.value)
        for batch in batches:
            at = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.vote(*given[i], skip=i)[0] for i in at], pa.float64())], ["i", "vote"])

    n = len(model["ids"])
    votes = dict(spark.range(0, n, 1, min(12, max(1, n // 500 + 1))).toDF("i").mapInArrow(run, "i long, vote double").collect())  # one number per example
    shared.destroy()
    upper, share = _steps(np.round([votes[i] for i in range(n)], 9), model["labels"])
    return model | {"upper": upper, "share": share}


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS, min_g2: float = MIN_G2, k: int = NEIGHBOURS,
) -> dict | None:
    """The model. A document with several label rows is labelled toxic if any says so."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_lid")).agg(F.max(F.col(label_col)).cast("int").alias("_y"))
    plain = docs.select(docs[id_col].alias("_id"), text_of(docs, text_col).alias("_text"))
    # ids and labels of the sample: max_labelled rows of two numbers, small enough to send everywhere, so that no text is shuffled
    there = known.filter(~held_out(F.col("_lid"))).join(plain.select("_id"), F.col("_id") == F.col("_lid"), "left_semi")
    sample = there.orderBy(F.xxhash64("_lid"), "_lid").limit(max_labelled)
    teach = stored(plain.join(F.broadcast(sample), F.col("_id") == F.col("_lid")).select(F.col("_id").alias("id"), F.col("_text").alias("text"), F.col("_y").alias("toxic")), "labelled")
    telling = choose_terms(teach.select("text", "toxic"), max_terms, min_g2)
    model = fit(plain.select("_text"), teach, telling, max_examples, k)
    return calibrate(model, docs.sparkSession) if model else None


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``score``, ``neighbours`` (ids of the five nearest examples) and ``cosines``; input columns of these names are replaced."""
    new = ["score", "neighbours", "cosines"]
    model = learn(docs, labels, id_col, text_col, **options)
    docs = docs.select(*[docs[c] for c in docs.columns if c not in new or c in (id_col, text_col)])
    id_type = docs.schema[id_col].dataType
    if model is None:
        return docs.select("*", F.lit(0.0).alias("score"), F.array().cast(T.ArrayType(id_type)).alias("neighbours"), F.array().cast("array<double>").alias("cosines"))
    names = docs.columns
    id_at = names.index(id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], text_of(docs, text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, n = Scorer(shared.value), len(names)
        for batch in batches:
            got = [scorer.score(text) for text in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(n)], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(batch.column(id_at).type)), pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                [*[f"c{i}" for i in range(n)], *new])

    schema = T.StructType([*plain.schema.fields[: len(names)], T.StructField("score", T.DoubleType()), T.StructField("neighbours", T.ArrayType(id_type)), T.StructField("cosines", T.ArrayType(T.DoubleType()))])
    return plain.mapInArrow(run, schema).toDF(*names, *new)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours", "cosines")
