"""Source divergence audit over the terms that an iceberg search by byte prefixes keeps.

Terms are runs of letters (A-Z lower-cased, every character beyond ASCII counts as one). A language keeps the terms that occur in at least
``min_docs`` of its documents. They are found level by level: at a level of L bytes each document gives its distinct prefixes of L bytes,
and its terms that end within L. Documents are counted for each prefix; a prefix below the threshold is discarded with everything that
begins with it, since no longer term can occur in more documents. What begins with a surviving prefix goes on to the next level, of twice
the length, until no prefix survives; terms that end on the way and reach the threshold are the kept ones, counted by source as they end.

Between two levels only the stretch of each document's longer terms under surviving prefixes is stored, so levels shrink fast. Survivors
reach the tasks as a bit set of fixed size (``BITS``). Two prefixes that share a bit let some discarded ones through, which costs counting
and changes nothing: their own counts discard them again. Counts are added up inside each slice of documents, then before the shuffle.

Each group (language, source) and each language gives term t, with count c of N in all, the share p = 1 + floor(10^9 (c + 1) / (N + V)),
V the kept terms of the language. Two shares p, q differ by floor((p - q)^2 / q). Sums over all V terms are put together from the terms
that occur: a pair of groups needs how often each count occurs in either group, and single terms only where both groups hold them.
All numbers are whole: bigint, and decimal where a product may pass it. Shares add up to 10^9 + V, so no sum passes 2 (10^9 + V)^2, which
a bigint holds up to 10^9 kept terms of a language; a larger sum would be refused with an error, not cut.

Each row is a document; null texts, languages and sources are ''. Repeated rows count as documents of their own. Texts and terms of any
length are read whole. Ties rank by term or source in UTF-8 order. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import list_column, stored
from gleanery.llm.runs import LETTERS, lengths_of, word_runs
from gleanery.scale import is_bounded, lookup_join

MIN_DOCS, FIRST_LEVEL, BITS, TOP_TERMS = 3, 12, 1 << 24, 200
SLICE_BYTES = 6 << 20  # text taken up at a time by a task
COUNTS = "whole boolean, lang string, source string, term binary, docs long, n long"
SURVIVORS = "lang string, source string, terms array<binary>, counts array<int>"
COUNTS_ARROW = pa.schema([("whole", pa.bool_()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("n", pa.int64())])
SURVIVORS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32()))])


class Slice:
    """Distinct terms of some documents: for each (row, term) its count; terms by code in a dictionary."""

    def __init__(self, rows: np.ndarray, terms: pa.Array, counts: np.ndarray | None, langs: list[str], sources: list[str]) -> None:
        coded = terms.dictionary_encode()
        self.dictionary = coded.dictionary
        size = max(1, len(self.dictionary))
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if counts is None:
            both, counts = np.unique(rows * size + codes, return_counts=True)
            rows, codes = both // size, both % size
        self.rows, self.codes, self.counts, self.size = rows, codes, counts, size
        self.lengths = lengths_of(self.dictionary)
        self.langs, self.lang_of = _coded(langs)
        self.groups, self.group_of = _coded(list(zip(langs, sources)))

    def prefixes(self, length: int) -> tuple[pa.Array, np.ndarray]:
        """The dictionary's distinct prefixes of ``length`` bytes, and each term's place among them."""
        coded = pc.binary_slice(self.dictionary, 0, length).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def survives(self, length: int, bits: bytes) -> np.ndarray:
        """Places of the (row, term) that are longer than ``length`` and whose prefix has its bit."""
        heads, head_of = self.prefixes(length)
        longer = np.flatnonzero(self.lengths[self.codes] > length)
        pairs, where = np.unique(self.lang_of[self.rows[longer]] * max(1, len(heads)) + head_of[self.codes[longer]], return_inverse=True)
        heads, seeds = heads.to_pylist(), [zlib.crc32(lang.encode() + b"\0") for lang in self.langs]
        n = max(1, len(heads))
        marks = np.fromiter((zlib.crc32(heads[x % n], seeds[x // n]) % (8 * len(bits)) for x in pairs.tolist()), np.int64, len(pairs))
        packed = np.frombuffer(bits, np.uint8)
        return longer[((packed[marks >> 3] >> (marks & 7).astype(np.uint8)) & 1).astype(bool)[where]]


def _coded(values: list) -> tuple[list, np.ndarray]:
    codes: dict = {}
    of = np.fromiter((codes.setdefault(v, len(codes)) for v in values), np.int64, len(values))
    return list(codes), of


def slices(batch: pa.RecordBatch, longer_than: int = 0) -> Iterator[Slice]:
    """The batch's documents; of texts only the terms of more than ``longer_than`` bytes."""
    langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    if len(batch.schema) == 3:  # texts
        for part in word_runs(batch.column(2), LETTERS, SLICE_BYTES, longer_than):
            span = slice(part.first, part.first + len(part.per_row))
            yield Slice(part.rows, part.words, None, langs[span], sources[span])
        return
    terms, counts = batch.column(2), batch.column(3)
    rows = np.repeat(np.arange(len(batch)), terms.value_lengths().to_numpy(zero_copy_only=False))
    yield Slice(rows, terms.flatten().cast(pa.large_binary()), counts.flatten().to_numpy(zero_copy_only=False), langs, sources)


def count_level(after: int, length: int):
    """Counts of the terms of more than ``after`` and at most ``length`` bytes, by group, and of the longer ones' prefixes, by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ends = part.lengths[part.codes]
                here = (ends > after) & (ends <= length)
                keys, where = np.unique(part.group_of[part.rows[here]] * part.size + part.codes[here], return_inverse=True)
                groups = [part.groups[g] for g in (keys // part.size).tolist()]
                yield _rows(True, [g[0] for g in groups], [g[1] for g in groups], part.dictionary.take(pa.array(keys % part.size)),
                            np.bincount(where, minlength=len(keys)), np.bincount(where, part.counts[here], len(keys)).astype(np.int64))
                heads, head_of = part.prefixes(length)
                n = max(1, len(heads))
                more = ends > length
                seen = np.unique(part.rows[more] * n + head_of[part.codes[more]])  # a document counts once for a prefix
                keys, docs = np.unique(part.lang_of[seen // n] * n + seen % n, return_counts=True)
                yield _rows(False, [part.langs[x] for x in (keys // n).tolist()], [""] * len(keys), heads.take(pa.array(keys % n)), docs, np.zeros(len(keys), np.int64))

    return run


def _rows(whole: bool, langs: list, sources: list, terms: pa.Array, docs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([whole] * len(docs), pa.bool_()), pa.array(langs, pa.string()), pa.array(sources, pa.string()), terms.cast(pa.binary()), pa.array(docs, pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, schema=COUNTS_ARROW)


def keep_survivors(length: int, bits):
    """Each document's terms of more than ``length`` bytes whose prefix survived; documents without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, length):
                alive = part.survives(length, bits.value)
                rows, codes = part.rows[alive], part.codes[alive]
                has, sizes = np.unique(rows, return_counts=True)
                groups = [part.groups[g] for g in part.group_of[has].tolist()]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), part.dictionary.take(pa.array(codes)).cast(pa.binary()))
                counts = list_column(part.counts[alive].astype(np.int32), sizes, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), terms, counts], schema=SURVIVORS_ARROW)

    return run


def bit_set(prefixes: DataFrame) -> bytes | None:
    """The surviving (lang, term) prefixes as a bit set of BITS bits, whatever their number; None without any."""
    mark = F.pmod(F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("term"))), F.lit(BITS))
    marks = prefixes.select(mark.alias("m")).select(F.shiftright("m", 6).alias("word"), F.expr("shiftleft(1L, cast(m & 63 as int))").alias("bit"))
    words = marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # BITS / 64 rows at most
    if words.empty:
        return None
    out = np.zeros(BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.tobytes()


def clean(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, first_level: int = FIRST_LEVEL) -> DataFrame:
    """(lang, source, term, n, lang_n, head): occurrences of each kept term in each group that holds it, and in the language; ``head`` is
    true in one row of each (lang, term)."""
    spark = docs.sparkSession
    frame, ended, after, length = clean(docs), [], 0, first_level
    while True:
        counts = frame.mapInArrow(count_level(after, length), COUNTS)
        counts = stored(counts.groupBy("whole", "lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "level")
        ended.append(counts.filter("whole").drop("whole"))
        bits = bit_set(counts.filter(~F.col("whole") & (F.col("docs") >= min_docs)))
        if bits is None:
            break
        shared = spark.sparkContext.broadcast(bits)
        frame = stored(frame.mapInArrow(keep_survivors(length, shared), SURVIVORS), "survivors")
        shared.unpersist()
        after, length = length, 2 * length
    term = Window.partitionBy("term", "lang")  # the term first: sorts compare the first column's bytes before whole rows
    cells = reduce(DataFrame.unionAll, ended)
    cells = cells.withColumns({"lang_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "head": F.row_number().over(term.orderBy("source")) == 1})
    return stored(cells.filter(F.col("lang_docs") >= min_docs).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "head"), "terms")


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kinds)), exact for any count; null where no term is kept."""
    wide = F.call_function("div", F.lit(1_000_000_000).cast("decimal(18,0)") * (count + 1).cast("decimal(20,0)"), (total + kinds).cast("decimal(20,0)"))
    plain = F.call_function("div", F.lit(1_000_000_000).cast("long") * (count + 1).cast("long"), total + kinds)
    return F.when(kinds > 0, F.when(count < 9_000_000_000, plain).otherwise(wide) + 1)


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per (lang, source): total, kept terms of its own (kinds) and of the language (v), share of a term it lacks (p0), lang_total."""
    lang = cells.filter("head").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    rows = clean(docs).select("lang", "source").distinct().join(own, ["lang", "source"], "left")
    rows = lookup_join(rows, lang, "lang").fillna(0, ["total", "kinds", "v", "lang_total"])
    return stored(rows.withColumn("p0", share(F.lit(0), F.col("total"), F.col("v"))), "groups")


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of a language's sources."""
    a = groups.select("lang", "source", F.col("total").alias("ta"), F.col("kinds").alias("ka"), "v", F.col("p0").alias("pa"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("tb"), F.col("kinds").alias("kb"), F.col("p0").alias("pb"))
    small = is_bounded(groups)
    near = F.broadcast if small else (lambda df: df)
    other = F.col("source") != F.col("item")
    neither = a.join(near(b), "lang").filter(other).select("lang", "source", "item", F.coalesce((F.col("v") - F.col("ka") - F.col("kb")) * gap(F.col("pa"), F.col("pb")), F.lit(0)).alias("value"))
    tally = stored(cells.groupBy("lang", "source", "n").agg(F.count("*").alias("times")), "tally")
    mine = tally.join(near(a), ["lang", "source"]).join(near(b), "lang").filter(other)
    mine = mine.select("lang", "source", "item", (F.col("times") * gap(share(F.col("n"), F.col("ta"), F.col("v")), F.col("pb"))).alias("value"))
    theirs = tally.withColumnRenamed("source", "item").join(near(b), ["lang", "item"]).join(near(a), "lang").filter(other)
    theirs = theirs.select("lang", "source", "item", (F.col("times") * gap(F.col("pa"), share(F.col("n"), F.col("tb"), F.col("v")))).alias("value"))
    held = cells.join(near(groups), ["lang", "source"]).select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0")
    held = held.repartition("term", "lang")
    both = held.join(held.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0")), ["term", "lang"]).filter(other)
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    both = both.select("lang", "source", "item", (gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)).alias("value"))
    return reduce(DataFrame.unionAll, (neither, mine, theirs, both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, first_level: int = FIRST_LEVEL) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' compares a source with each other one of its language, part 'term' lists the
    ``top_terms`` terms that set it apart most from the whole language."""
    cells = kept_terms(docs, min_docs, first_level)
    groups = groups_of(docs, cells)
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = pair_values(cells, groups).withColumn("rank", F.row_number().over(best))
    terms = lookup_join(cells, groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"], "inner")
    terms = terms.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    terms = terms.filter("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


# the same rows in SQL, every pair of sources compared term by term
SQL = f"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
  w as (select r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
  k as (select lang, term, count(*) as ln from w group by lang, term having count(distinct r) >= {MIN_DOCS}),
  l as (select lang, count(*) as v, sum(ln) as lt from k group by lang),
  c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by all),
  g as (select lang, source, coalesce(sum(n), 0) as t from (select distinct lang, source from d) left join c using (lang, source) group by lang, source),
  s as (select g.lang, g.source, k.term, coalesce(n, 0) as n, 1 + 1000000000::hugeint * (coalesce(n, 0) + 1) // (g.t + l.v) as p, 1 + 1000000000::hugeint * (k.ln + 1) // (l.lt + l.v) as lp
    from g join k using (lang) join l using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
  p as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) x
      on x.lang = a.lang and x.source = a.source and x.item = b.source),
  t as (select lang, source, 'term' as part, term as item, (p - lp) * (p - lp) // lp as value from s where n > 0 and p > lp),
  o as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from p union all select * from t))
  select lang, source, part, item, value::bigint as value, rank::int as rank from o where part = 'pair' or rank <= {TOP_TERMS}"""
