"""Rule tables compiled to columns: gates, labels and reason codes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery import defaults as d
from gleanery.functions.text import let, lit_or_col, sentences, squash


def words_pattern(words: Iterable[str]) -> str:
    """One case-insensitive alternation: a rule costs one pass over the text however many words it has."""

    return "(?i)" + "|".join(re.escape(w) for w in words)


def has_any(text: str | Column, words: Iterable[str]) -> Column:
    return F.coalesce(lit_or_col(text).rlike(words_pattern(words)), F.lit(False))


def first_label(text: str | Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first pattern that matches."""

    text, chain = lit_or_col(text), None
    for pattern, label in rules:
        hit = text.rlike(pattern)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(F.lit(default))


def reason_list(*checks: tuple[Column, str | Column]) -> Column:
    """Codes of all checks that hold, in order. NULL checks count as not holding."""

    return F.array_compact(
        F.array(*[F.when(c, F.lit(r) if isinstance(r, str) else r) for c, r in checks])
    )


def first_reason(checks: Sequence[tuple[Column, str | Column]], passed: str = "ready") -> Column:
    """Code of the first failing check: one lazy ``when`` chain, so cheap checks shield costly ones."""

    chain = None
    for check, reason in checks:
        value = F.lit(reason) if isinstance(reason, str) else reason
        chain = F.when(check, value) if chain is None else chain.when(check, value)
    return chain.otherwise(F.lit(passed))


# --- labels ------------------------------------------------------------------------------------------

def role_category(label: str | Column, vocabulary: Sequence[str] = tuple(d.ROLE_CATEGORIES),
                  aliases: Sequence[tuple[Sequence[str], str]] = tuple(d.ROLE_ALIASES), other: str = d.OTHER_ROLE) -> Column:
    """A known category stays; otherwise the first alias group found in the label decides."""

    label = F.trim(lit_or_col(label))
    rules = [(words_pattern(words), name) for words, name in aliases]
    return F.when(label.isin(*vocabulary), label).otherwise(first_label(squash(label), rules, other))


def _feed_words(words: Sequence[str]) -> str:
    alone = [w for w in words if w == "ai"]
    parts = [re.escape(w) for w in words if w != "ai"] + ["(?<![a-z])ai(?![a-z])" for _ in alone]
    return "|".join(parts)


def feed_role_category(text: str | Column, aliases: Sequence[tuple[Sequence[str], str]] = tuple(d.FEED_ROLE_ALIASES),
                       other: str = d.OTHER_ROLE) -> Column:
    return first_label(F.lower(lit_or_col(text)), [(_feed_words(w), name) for w, name in aliases], other)


def cohort(text: str | Column, hint: str | Column | None = None, unknown: str = d.UNKNOWN) -> Column:
    """Graduation year: Chinese marks, then English programme wording, then a reviewed hint of the source."""

    text = F.coalesce(lit_or_col(text), F.lit(""))
    programme = (r"(?:intern(?:ship)?|co[- ]?op|upcoming\s+graduates?|graduate\s+(?:program|programme)"
                 r"|academy|class(?:es)?)")
    found = lambda pattern, source=text: F.nullif(F.regexp_extract(source, pattern, 1), F.lit(""))
    short = found(r"(?<!\d)(2\d)\s*届")
    year = F.coalesce(
        found(r"(?<!\d)(20\d{2})\s*届"),
        F.when(short.isNotNull(), F.concat(F.lit("20"), short)),
        found(r"(?<!\d)(20\d{2})\s*(?:年\s*)?(?:校园招聘|校招|秋招|春招)"),
        found(r"(?i)(?<!\d)(20\d{2})(?!\d)[^.!?\n]{0,140}" + programme),
        found("(?i)" + programme + r"[^.!?\n]{0,140}(?<!\d)(20\d{2})(?!\d)"),
    )
    if hint is not None:
        year = F.coalesce(year, found(r"(?<!\d)(20\d{2})(?!\d)", F.coalesce(lit_or_col(hint), F.lit(""))))
    return F.coalesce(year, F.lit(unknown))


def batch(text: str | Column, unknown: str = d.UNKNOWN) -> Column:
    return first_label(text, [(re.escape(m), label) for m, label in d.BATCH_MARKERS], unknown)


def education(text: str | Column, unknown: str = d.UNKNOWN) -> Column:
    return first_label(text, [("|".join(map(re.escape, ms)), label) for ms, label in d.EDUCATION_MARKERS], unknown)


# --- gates -------------------------------------------------------------------------------------------

def in_scope(flag: Column, head: Column, full: Column, negative: Iterable[str] = tuple(d.SOCIAL_TERMS),
             positive: Iterable[str] = tuple(d.CAMPUS_TERMS)) -> Column:
    """Scope gate. An explicit no, or a negative word in the head fields, loses; an explicit yes wins; otherwise the
    full text decides, negative words first."""

    return (
        F.when(flag.eqNullSafe(F.lit(False)), F.lit(False))
        .when(has_any(head, negative), F.lit(False))
        .when(flag.eqNullSafe(F.lit(True)), F.lit(True))
        .when(has_any(full, negative), F.lit(False))
        .otherwise(has_any(full, positive))
    )


def feed_scope_flag(text: Column, markers: Column | None = None, campus_only: Column | None = None,
                    path: Column | None = None) -> Column:
    """Tri-state flag of a feed row: false, true or unknown."""

    text = F.lower(F.coalesce(text, F.lit("")))
    positive = has_any(text, d.FEED_CAMPUS_WORDS)
    if markers is not None:
        own = F.exists(markers, lambda m: F.contains(text, F.lower(m)))
        positive = F.when(F.coalesce(F.size(markers), F.lit(0)) > 0, own).otherwise(positive)
    chain = F.when(has_any(text, d.FEED_SOCIAL_WORDS), F.lit(False)).when(positive, F.lit(True))
    if campus_only is not None and path is not None:
        chain = chain.when(campus_only & has_any(path, d.CAMPUS_PATH_WORDS), F.lit(True))
    return chain.otherwise(F.lit(None).cast("boolean"))


def allow_listed(ids: Column, title: Column, allowed_ids: Column, allowed_markers: Column) -> Column:
    """Explicit id or title allow-list; two empty lists let every row pass."""

    clean = lambda items: F.filter(F.transform(items, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    want_ids, want_marks = clean(allowed_ids), clean(allowed_markers)
    head = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return (
        ((F.size(want_ids) == 0) & (F.size(want_marks) == 0))
        | F.arrays_overlap(clean(ids), want_ids)
        | ((head != "") & F.exists(want_marks, lambda m: F.contains(head, m)))
    )


def feed_row_allowed(ids: Column, title: Column, context: Column, allowed_ids: Column, allowed_markers: Column,
                     markers: Column | None = None) -> Column:
    """Allow-list, then any row not marked as out of scope."""

    return allow_listed(ids, title, allowed_ids, allowed_markers) & F.coalesce(feed_scope_flag(context, markers), F.lit(True))


def blocked_category(category: Column, blocked: Sequence[tuple[str, str]] = tuple(d.BLOCKED_CATEGORIES)) -> Column:
    """Reason code for a blocked category, else NULL."""

    chain = None
    for reason in dict.fromkeys(r for _, r in blocked):
        hit = F.trim(category).isin(*[c for c, r in blocked if r == reason])
        chain = F.when(hit, reason) if chain is None else chain.when(hit, reason)
    return chain


def blocked_title(title: Column, patterns: Sequence[tuple[str, str]] = tuple(d.BLOCKED_TITLE_PATTERNS)) -> Column:
    """Struct (reason, term) of the first pattern found in the title or in the title without white space."""

    spaced, tight = F.lower(F.coalesce(title, F.lit(""))), squash(title)
    term = lambda pattern, text: F.nullif(F.regexp_extract(text, "(?i)" + pattern, 0), F.lit(""))
    chain = None
    for pattern, reason in patterns:
        hit = F.coalesce(term(pattern, spaced), term(pattern, tight))
        item = F.struct(F.lit(reason).alias("reason"), hit.alias("term"))
        found = spaced.rlike("(?i)" + pattern) | tight.rlike("(?i)" + pattern)
        chain = F.when(found, item) if chain is None else chain.when(found, item)
    return chain


def demanded_portfolio(texts: Column, demand: str = d.PORTFOLIO_DEMAND, exempt: str = d.PORTFOLIO_OF_BUSINESS) -> Column:
    """Term of the first sentence that demands a portfolio and does not speak of a book of business."""

    hits = F.filter(sentences(texts), lambda s: s.rlike("(?i)" + demand) & ~s.rlike("(?i)" + exempt))
    return let(F.try_element_at(hits, F.lit(1)), lambda first: F.when(first.isNotNull(), F.regexp_extract(first, "(?i)" + demand, 0)))


def passes_page_guard(category: Column, title: Column) -> Column:
    """The page's own short guard: same lists, one test on the title as written."""

    every = "(?i)" + "|".join(f"(?:{p})" for p, _ in d.BLOCKED_TITLE_PATTERNS)
    return F.coalesce(~category.isin(*[c for c, _ in d.BLOCKED_CATEGORIES]) & ~title.rlike(every), F.lit(False))
