"""Audience gate: decision, reason codes and matched terms per posting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import defaults as d
from gleanery.functions.rules import blocked_category, blocked_title, demanded_portfolio, words_pattern
from gleanery.functions.text import let, sentences, squash

TARGET, OUT, REVIEW = "TARGET_GENERALIST", "OUT_OF_SCOPE", "NEEDS_REVIEW"
ANY_MAJOR = "(?i)" + "|".join(d.NON_TARGET_MAJORS + d.TARGET_MAJORS)


def _stems(patterns: list[str]) -> list[str]:
    """Literal text every match of a pattern starts with, per alternative: plain search rules most texts out at once."""

    found, depth, current = [], 0, ""
    for ch in "|".join(patterns) + "|":
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            head = re.match(r"[^(\[?\\]*", current)[0]
            found.append(head[:-1] if current[len(head):].startswith("?") else head)
            current = ""
        else:
            current += ch
    unique = sorted(set(found), key=len)
    return [s for i, s in enumerate(unique) if not any(t in s for t in unique[:i])]


MAJOR_STEMS = _stems(d.NON_TARGET_MAJORS + d.TARGET_MAJORS)
ANY_BLOCKED_TITLE = "(?i)" + "|".join(p for p, _ in d.BLOCKED_TITLE_PATTERNS)
REQUIREMENT, DESCRIPTION, TAG = 0, 1, 2

_TERMS = T.ArrayType(
    T.StructType([
        T.StructField("blocked", T.ArrayType(T.StringType())),
        T.StructField("allowed", T.ArrayType(T.StringType())),
        T.StructField("allowed_in_context", T.ArrayType(T.StringType())),
    ])
)


def _in_context(sentence: str, start: int, end: int, cue: re.Pattern) -> bool:
    """A long share of the sentence, or a qualification word close by."""

    if end - start >= max(2, int(len(sentence) * d.MAJOR_SHARE)):
        return True
    return bool(cue.search(sentence[max(0, start - d.MAJOR_CUE_BEFORE) : end + d.MAJOR_CUE_AFTER]))


@F.pandas_udf(_TERMS)
def _major_terms(texts: pd.Series) -> pd.Series:
    """Majors named in each compact sentence, kept only where at least one stands in a qualification context.

    Match offsets decide this, and Spark's regex functions return none, hence the only Python in the gate.
    """

    blocked = [re.compile(p, re.I) for p in d.NON_TARGET_MAJORS]
    allowed = [re.compile(p, re.I) for p in d.TARGET_MAJORS]
    cue = re.compile(d.MAJOR_CUES, re.I)

    def one(sentence):
        bad = [m for p in blocked for m in p.finditer(sentence)]
        good = [m for p in allowed for m in p.finditer(sentence)]
        good_here = [m.group() for m in good if _in_context(sentence, *m.span(), cue)]
        if not good_here and not any(_in_context(sentence, *m.span(), cue) for m in bad):
            return {"blocked": [], "allowed": [], "allowed_in_context": []}
        return {"blocked": [m.group() for m in bad], "allowed": [m.group() for m in good], "allowed_in_context": good_here}

    return texts.map(lambda items: None if items is None else [one(s) for s in items])


# filters on the decision must not be pushed below this step: Catalyst would copy the whole gate into them
major_terms = _major_terms.asNondeterministic()


def _tag_terms(tags: Column, patterns: list[str]) -> Column:
    """First hit of every pattern in every tag that is a real demand (soft wording without a hard mark is skipped)."""

    soft, strong = words_pattern(d.SOFT_MARKERS), words_pattern(d.STRONG_MARKERS)
    firm = F.filter(F.transform(tags, lambda t: squash(t)), lambda t: ~t.rlike(soft) | t.rlike(strong))
    hits = F.transform(firm, lambda t: F.array(*[F.regexp_extract(t, "(?i)" + p, 0) for p in patterns]))
    return F.array_distinct(F.filter(F.flatten(hits), lambda t: t != ""))


def _named_sentences(origin: int, texts: Column) -> Column:
    """Sentences that name any major, with their origin. Most texts have none and send nothing to Python."""

    stems = F.array(*[F.lit(s) for s in MAJOR_STEMS])
    hinted = F.filter(texts, lambda t: let(squash(t), lambda tight: F.exists(stems, lambda s: F.contains(tight, s))))
    found = F.filter(sentences(hinted), lambda s: squash(s).rlike(ANY_MAJOR))
    return F.transform(found, lambda s: F.struct(F.lit(origin).alias("origin"), s.alias("text")))


def assess(df, title: str = "title", category: str = "role_category", requirements: str = "requirements",
           description: str = "description", tags: str = "major_tags", name: str = "audience"):
    """Add the struct ``audience(decision, reason_codes, matched_terms)``.

    One ``when`` chain decides, cheap tests first and evaluated only as far as needed. Rows that the title or category
    settles send no sentences to Python.
    """

    empty = F.array().cast("array<string>")
    reqs, labels = F.coalesce(F.col(requirements), empty), F.coalesce(F.col(tags), empty)
    about = F.array(F.coalesce(F.col(description), F.lit("")))
    kind = F.coalesce(F.col(category), F.lit(""))
    settled = F.trim(kind).isin(*[c for c, _ in d.BLOCKED_CATEGORIES]) | F.coalesce(
        F.lower(F.col(title)).rlike(ANY_BLOCKED_TITLE) | squash(title).rlike(ANY_BLOCKED_TITLE), F.lit(False))
    named = F.concat(_named_sentences(REQUIREMENT, reqs), _named_sentences(DESCRIPTION, about), _named_sentences(TAG, labels))
    df = df.withColumn("_named", F.when(~settled, named))
    df = df.withColumn("_terms", major_terms(F.transform("_named", lambda x: squash(x["text"]))))

    soft, strong, free = words_pattern(d.SOFT_MARKERS), words_pattern(d.STRONG_MARKERS), "(?i)" + d.UNRESTRICTED_MAJOR
    firm = lambda s: s.rlike(strong) | ~s.rlike(soft)
    pairs = F.arrays_zip("_named", "_terms")
    counted = F.filter(pairs, lambda x: (x["_named"]["origin"] != TAG) & firm(squash(x["_named"]["text"])) & ~x["_named"]["text"].rlike(free))
    texts = F.concat(reqs, about)
    free_hit = F.exists(sentences(texts), lambda s: s.rlike(free) & firm(squash(s)))
    free_term = F.when(free_hit, F.array(F.lit(d.UNRESTRICTED_TERM))).otherwise(empty)
    late = F.filter(pairs, lambda x: x["_named"]["origin"] != DESCRIPTION)
    df = df.withColumns({
        "_good": F.array_distinct(F.concat(free_term, F.flatten(F.transform(counted, lambda x: x["_terms"]["allowed"])))),
        "_bad": F.array_distinct(F.flatten(F.transform(counted, lambda x: x["_terms"]["blocked"]))),
        "_late": F.array_distinct(F.flatten(F.transform(late, lambda x: x["_terms"]["allowed_in_context"]))),
    })
    general = "(?i)" + "|".join(d.GENERALIST_TITLES)
    blocked, titled = blocked_category(kind), blocked_title(F.col(title))
    folio = F.when(F.exists(texts, lambda x: x.rlike("(?i)作品集|portfolio")), demanded_portfolio(texts))
    tag_good, tag_bad = _tag_terms(labels, d.TARGET_MAJORS), _tag_terms(labels, d.NON_TARGET_MAJORS)

    def verdict(decision: str, reason, terms):
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(decision).alias("decision"), F.array(reason).alias("reason_codes"), terms.alias("matched_terms"))

    result = (
        F.when(blocked.isNotNull(), verdict(OUT, blocked, F.array(F.trim(kind))))
        .when(settled, verdict(OUT, titled["reason"], F.array(titled["term"])))
        .when(folio.isNotNull(), verdict(OUT, "BLOCKED_SPECIALIST_PORTFOLIO", F.array(folio)))
        .when(F.size(tag_good) > 0, verdict(TARGET, "ALLOWED_TARGET_MAJOR", tag_good))
        .when(F.size(tag_bad) > 0, verdict(OUT, "BLOCKED_NON_TARGET_MAJOR", tag_bad))
        .when(F.size("_good") > 0, verdict(TARGET, "ALLOWED_TARGET_MAJOR", F.col("_good")))
        .when(F.size("_bad") > 0, verdict(OUT, "BLOCKED_NON_TARGET_MAJOR", F.col("_bad")))
        .when(F.concat_ws(" ", reqs, labels).rlike(free), verdict(TARGET, "ALLOWED_UNRESTRICTED_MAJOR", F.array(F.lit(d.UNRESTRICTED_TERM))))
        .when(F.size("_late") > 0, verdict(TARGET, "ALLOWED_TARGET_MAJOR", F.col("_late")))
        .when(squash(title).rlike(general), verdict(TARGET, "ALLOWED_GENERALIST_TITLE", empty))
        .otherwise(verdict(REVIEW, "REVIEW_INSUFFICIENT_REQUIREMENTS", empty))
    )
    return df.withColumn(name, result).drop("_named", "_terms", "_good", "_bad", "_late")


def is_publishable(audience: str = "audience") -> Column:
    return F.col(f"{audience}.decision") == TARGET
