"""Personal data: base patterns plus information-theoretic sanitisation of the terms that give a protected entity away.

Everything here is DataFrame code; text stays in the JVM.

Base: e-mail, ip, card and phone numbers found by pattern and then checked. Patterns carry possessive loops and start at run starts only
(or where the match before ended), which finds the same matches in time linear in the text.

Method: each distinct checked value is a protected entity e. Its context terms are the words of three letters or more within ``window``
words on either side, up to the next value of the kind. Over all documents, n(e), n(t) and n(e, t) are document counts, the information
content is IC(e) = log2(N / n(e)), and a term discloses the share PMI(e; t) / IC(e) = 1 + log2(n(e, t) / n(t)) / IC(e) of it. A share of
``generalise`` or more puts a placeholder in place of the term, in every document; ``remove`` or more takes the term out. A pair
counts only if the term stood in at least ``min_windows`` different windows of the entity: copies of one text repeat the same window and
prove nothing.

Null text is empty text: no spans. Overlaps between kinds are kept apart in the span lists and merged when redacting. Repeated rows get
the same spans each. Extra columns pass through; those named like a new column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import stored, text_of

#: Kinds in span order with their patterns (possessive and run-start forms of the plain ones).
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that must hold before a pattern can match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{14}", "phone": r"\+[0-9]"}
TERM, WORD, WINDOW, MIN_WINDOWS, GENERALISE, REMOVE, MAX_BROADCAST, BLOCK = "term", r"\p{L}{3,}", 5, 3, 0.8, 0.95, 100_000, 4096


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)


def _step(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))


def block_sums(lengths: Column) -> Column:
    """Exclusive prefix sums of the blocks of about sqrt(n) lengths."""
    step = _step(F.size(lengths))
    blocks = F.sequence(F.lit(0), F.floor(F.size(lengths) / step).cast("int"))
    return F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda done, b: F.concat(done, F.array(F.element_at(done, -1) + _total(F.slice(lengths, b * step + 1, step)))))


def prefix_sum(lengths: Column, sums: Column, i: Column) -> Column:
    """Sum of the first ``i`` lengths: whole blocks, then at most sqrt(n) single ones."""
    step = _step(F.size(lengths))
    block = F.floor(i / step).cast("int")
    return F.get(sums, block) + _total(F.slice(lengths, block * step + 1, i - block * step))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
        return F.length(digits).between(16, 19) & (F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda s: _valid(kind, s["value"])


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _as_span(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit("remove").alias("action"))


def _entity(kind: str, m: Column) -> Column:
    plain = F.lower(m) if kind in ("email", "ip") else F.regexp_replace(m, "[^0-9]", "")
    return F.concat(F.lit(kind + ":"), plain)


def _located(df: DataFrame, text: str, kind: str, pattern: Column, wanted: Column) -> DataFrame:
    """Adds ``_p_kind`` (pieces between matches) and ``_m_kind`` (matches), then ``_s_kind``: array of (start, stop, value) in code points."""
    none = F.array().cast("array<string>")
    df = df.withColumns({
        f"_m_{kind}": F.when(wanted, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none),
    })
    df = df.withColumn(f"_p_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
    lengths = F.zip_with(f"_p_{kind}", f"_m_{kind}", lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
    df = df.withColumn(f"_l_{kind}", lengths).withColumn(f"_o_{kind}", block_sums(F.col(f"_l_{kind}")))
    located = F.transform(f"_m_{kind}", lambda m, i: F.struct(prefix_sum(F.col(f"_l_{kind}"), F.col(f"_o_{kind}"), i + 1).alias("stop"), m.alias("value"), i.alias("place")))
    # a prefix ends with the match
    return df.withColumn(f"_s_{kind}", F.transform(located, lambda s: F.struct((s["stop"] - F.length(s["value"])).alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), s["place"].alias("place"))))


def _with_base(docs: DataFrame, text: str) -> DataFrame:
    df = docs
    for kind, pattern in KINDS.items():
        df = _located(df, text, kind, F.lit(pattern), F.col(text).contains("@") if kind == "email" else F.col(text).rlike(NEEDS[kind]))
        df = df.withColumn(f"_s_{kind}", F.filter(f"_s_{kind}", _checked(kind)))
    return df


def _windows(base: DataFrame, window: int) -> DataFrame:
    """For each row, ``windows``: array of (entity, terms) of its checked values, terms being the distinct words around them."""
    def context(kind: str):
        words = F.col(f"_w_{kind}")
        return lambda s: F.struct(_entity(kind, s["value"]).alias("entity"), F.array_sort(F.array_distinct(F.concat(
            F.reverse(F.slice(F.reverse(F.get(words, s["place"])), 1, window)), F.slice(F.get(words, s["place"] + 1), 1, window)))).alias("terms"))

    base = base.withColumns({f"_w_{kind}": F.transform(f"_p_{kind}", lambda p: F.regexp_extract_all(F.lower(p), F.lit(WORD), F.lit(0))) for kind in KINDS})
    around = F.concat(*[F.transform(f"_s_{kind}", context(kind)) for kind in KINDS])
    # an entity named twice in a text, with the same words around it, counts once
    return base.select(F.array_distinct(around).alias("windows"))


def _match(facts: DataFrame, terms: DataFrame, on: str, n: int, max_broadcast: int) -> DataFrame:
    """Join to a term table of ``n`` rows: sent to every task only while it is proven small, shuffled beyond that."""
    return facts.join(F.broadcast(terms) if n <= max_broadcast else terms, on)


def disclosing_terms(
    docs: DataFrame, text_col: str = "text", window: int = WINDOW, min_windows: int = MIN_WINDOWS, generalise: float = GENERALISE,
    remove: float = REMOVE, max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """(term, entity, share, action): the terms above the disclosure threshold, each with the entity it reveals most (stored table)."""
    plain = docs.select(text_of(docs, text_col).alias("_text"))
    held = stored(_windows(_with_base(plain, "_text"), window), "windows")
    total = held.count()
    windows = held.select(F.explode("windows").alias("x")).select("x.entity", "x.terms")
    n_e = windows.groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = (
        windows.groupBy("entity", "terms").agg(F.count("*").alias("rows")).select("entity", "rows", F.explode("terms").alias("term"))
        .groupBy("entity", "term").agg(F.count("*").alias("windows"), F.sum("rows").alias("n_et"))
        .filter(F.col("windows") >= min_windows)
    )

    def share(n_term: str) -> Column:
        return 1 + F.log2(F.least(F.lit(1.0), F.col("n_et") / F.col(n_term))) / F.log2(F.greatest(F.lit(2.0), F.lit(float(total)) / F.col("n_e")))

    # texts with the term in some window are a lower bound of n(t): pairs that fail with it fail with n(t), which spares counting common words
    least = held.select(F.explode(F.array_distinct(F.flatten(F.col("windows.terms")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_low"))
    pairs = stored(pairs.join(n_e, "entity").join(least, "term").filter(share("n_low") >= generalise).select("entity", "term", "n_et", "n_e"), "pairs")
    n_pairs = pairs.count()
    terms = pairs.select("term").distinct()
    words = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(WORD), F.lit(0)))
    seen = _match(plain.select(F.explode(words).alias("term")), terms, "term", n_pairs, max_broadcast) if n_pairs else plain.select(F.lit("").alias("term")).limit(0)
    n_t = seen.groupBy("term").agg(F.count("*").alias("n_t"))
    scored = pairs.join(n_t, "term").withColumn("share", share("n_t")).filter(F.col("share") >= generalise)
    best = scored.groupBy("term").agg(F.max_by(F.struct("entity", "share"), F.struct("share", "entity")).alias("b"))
    action = F.when(F.col("b.share") >= remove, "remove").otherwise("generalise")
    return stored(best.select("term", F.col("b.entity").alias("entity"), F.col("b.share").alias("share"), action.alias("action")), "terms")


def find_spans(docs: DataFrame, text_col: str = "text", max_broadcast: int = MAX_BROADCAST, **options) -> DataFrame:
    """Documents with ``pii_spans``: array of (kind, start, stop, action), base kinds as listed and then terms, by start; code points, stop exclusive."""
    terms = disclosing_terms(docs, text_col, max_broadcast=max_broadcast, **options)
    n_terms = terms.count()
    docs = docs.select(*[docs[c] for c in docs.columns if c != "pii_spans"])
    names = docs.columns
    df = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], text_of(docs, text_col).alias("_text"))
    df = _with_base(df, "_text")
    base = [F.transform(f"_s_{kind}", _as_span(kind)) for kind in KINDS]
    df = df.withColumn("_base", F.concat(*base)).select(*[f"c{i}" for i in range(len(names))], "_text", "_base")
    if n_terms:
        keyed = df.withColumn("_key", F.xxhash64("_text", F.lit(1)))
        forms = F.array_distinct(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
        found = keyed.select("_key", F.explode(forms).alias("form")).withColumn("term", F.lower("form"))
        found = _match(found, terms.select("term", "action"), "term", n_terms, max_broadcast)
        found = stored(found.groupBy("_key").agg(F.collect_set("form").alias("_forms"), F.collect_set(F.when(F.col("action") == "remove", F.col("form"))).alias("_gone")), "forms")
        few = found.count() <= max_broadcast // 10
        df = keyed.join(F.broadcast(found) if few else found, "_key", "left")
        pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.coalesce("_forms", F.array().cast("array<string>")), "|"), F.lit(r")(?!\p{L})"))
        df = _located(df, "_text", TERM, pattern, F.col("_forms").isNotNull())
        own = F.transform(f"_s_{TERM}", lambda s: F.struct(F.lit(TERM).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
                                                           F.when(F.array_contains("_gone", s["value"]), "remove").otherwise("generalise").alias("action")))
        own = F.filter(own, lambda s: ~F.exists("_base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
        df = df.withColumn("_base", F.concat("_base", own))
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_base").alias("pii_spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["kind"] != TERM)
    counts = [F.size(F.filter(spans, _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def _merged(spans: Column) -> Column:
    """Spans by start with overlaps merged, as (kind, start, stop, action); the first kind of a run names it."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("less"), s["kind"].alias("kind"), s["action"].alias("action"))))
    empty = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,action:string>>")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["stop"], -s["less"]).alias("stop"), last["action"].alias("action"))
        fresh = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["less"]).alias("stop"), s["action"].alias("action"))
        return F.when(F.size(done) == 0, F.array(fresh)).when(s["start"] < last["stop"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    return F.aggregate(order, empty, add)


def redact(found: DataFrame, text_col: str = "text", spans: Sequence[str] = ("pii_spans",)) -> DataFrame:
    """Text with each merged span taken out (disclosing terms), or replaced by its kind in brackets; the span column goes.

    The text is cut into blocks of 4,096 code points, so a span costs its own length and at most two blocks, whatever the text's length.
    """
    name = spans[0]
    df = found.withColumn("_cuts", F.when(F.size(name) > 0, _merged(F.col(name))))
    df = df.withColumn("_blocks", F.when(F.col("_cuts").isNotNull(), F.regexp_extract_all(F.col(text_col), F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))))

    def piece(a: Column, b: Column) -> Column:
        first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        joined = F.array_join(F.slice("_blocks", first + 1, last - first + 1), "")
        return F.when(b > a, F.substring(joined, (a - first * BLOCK + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    mark = F.transform("_cuts", lambda s, i: F.concat(
        piece(F.coalesce(F.get(F.col("_cuts"), i - 1)["stop"], F.lit(0).cast("long")), s["start"]),
        F.when((s["kind"] == TERM) & (s["action"] == "remove"), "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))))
    tail = piece(F.element_at("_cuts", -1)["stop"], F.length(text_col).cast("long"))
    text = F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(mark, ""), tail))
    return df.withColumn(text_col, text).drop("_cuts", "_blocks", name)
