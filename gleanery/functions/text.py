"""Text cleaning and comparison keys."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import defaults as d

SPACE = r"(?U)\s+"  # Unicode white space, as in U+3000


def lit_or_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""

    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def first_not_null(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(1))


def squash(text: str | Column) -> Column:
    """Remove all white space and lower the case."""

    return F.lower(F.regexp_replace(F.coalesce(lit_or_col(text), F.lit("")), SPACE, ""))


def single_spaced(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(lit_or_col(text), F.lit("")), SPACE, " "))


def blank_to_null(text: str | Column) -> Column:
    return F.nullif(F.trim(lit_or_col(text)), F.lit(""))


def bounded_text(text: str | Column, limit: int) -> Column:
    """One-line text cut to ``limit`` characters; blank becomes NULL."""

    return F.nullif(F.substring(single_spaced(text), 1, limit), F.lit(""))


# Markup as four kinds of pieces; attributes may hold ">" in quotes. Possessive loops keep each scan linear.
_ATTRIBUTES = r"""(?:"[^"<]*"|'[^'<]*'|[^"'<>])*+"""
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_HIDDEN = rf"(?is)<({'|'.join(d.HIDDEN_TAGS)})\b[^>]*+>.*?(?:</\1\s*+>|\z)"
_BREAK = rf"(?i)</?(?:{'|'.join(d.BREAK_TAGS)})\b{_ATTRIBUTES}>"
_TAG = rf"</?[a-zA-Z]{_ATTRIBUTES}>|</?[a-zA-Z][^<>]*+>|<[!?][^<>]*+>"


def without_markup(text: Column) -> Column:
    """Comments, hidden elements and tags removed; block tags become a space. What is no whole tag stays text."""

    plain = text
    for pattern, by in ((_COMMENT, ""), (_HIDDEN, ""), (_BREAK, " "), (_TAG, "")):
        plain = F.regexp_replace(plain, pattern, by)
    return F.when(text.contains("<"), plain).otherwise(text)


def in_parts(values: pa.Array, change, rows: int = 256) -> pa.Array:
    """``change`` of every value that is not null. A batch stays in Arrow; only ``rows`` of its values at a time are Python objects."""

    parts = (values.slice(i, rows).to_pylist() for i in range(0, len(values), rows))
    done = [pa.array([None if v is None else change(v) for v in part], values.type) for part in parts]
    return pa.concat_arrays(done) if done else values


@F.arrow_udf(T.StringType())
def _unescaped(texts: pa.Array) -> pa.Array:
    return in_parts(texts, html.unescape)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _unescaped_each(lists: pa.Array) -> pa.Array:
    return in_parts(lists, lambda items: [x if x is None else html.unescape(x) for x in items])


_REFERENCE = "&#?[A-Za-z0-9]"


def clean_text(text: str | Column, limit: int | None = None) -> Column:
    """Visible text of possibly marked-up input, whole unless a limit is asked for. Only rows that may hold character references leave the JVM."""

    text = lit_or_col(text)
    plain = F.coalesce(_unescaped(F.when(text.rlike(_REFERENCE), without_markup(text))), without_markup(text))
    spaced = single_spaced(plain)
    return F.substring(spaced, 1, limit) if limit else spaced


def is_cut(text: str | Column, limit: int) -> Column:
    """True where ``clean_text`` with this limit loses characters."""

    return F.length(clean_text(text)) > limit


def clean_each(items: Column) -> Column:
    """``clean_text`` of every text in an array."""

    plain = F.transform(items, without_markup)
    referring = F.exists(items, lambda x: x.rlike(_REFERENCE))
    return F.transform(F.coalesce(_unescaped_each(F.when(referring, plain)), plain), lambda x: single_spaced(x))


def clean_list(items: str | Column, limit: int | None = None, item_limit: int | None = None) -> Column:
    """Distinct non-blank clean texts in order; all of them, and whole, unless limits are asked for."""

    items = F.coalesce(lit_or_col(items), F.array().cast("array<string>"))
    parsed = clean_each(items)
    cut = F.transform(parsed, lambda x: F.substring(x, 1, item_limit)) if item_limit else parsed
    kept = F.array_distinct(F.filter(cut, lambda x: x != ""))
    return F.slice(kept, 1, limit) if limit else kept


def normalize_city(city: str | Column, unknown: str = d.UNKNOWN) -> Column:
    stripped = F.replace(clean_text(city), F.lit("市"), F.lit(""))
    return F.coalesce(F.nullif(stripped, F.lit("")), F.lit(unknown))


def sentences(values: str | Column) -> Column:
    """Non-blank sentences of every text in an array."""

    parts = F.transform(lit_or_col(values), lambda v: F.split(F.coalesce(v, F.lit("")), r"[。；;\n.!！?？]"))
    return F.filter(F.flatten(parts), lambda s: s.rlike(r"(?U)\S"))


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return in_parts(texts, lambda t: unicodedata.normalize("NFKC", t))


@F.arrow_udf(T.StringType())
def _nfkc_folded(texts: pa.Array) -> pa.Array:
    return in_parts(texts, lambda t: unicodedata.normalize("NFKC", t).casefold())


def nfkc(text: str | Column) -> Column:
    """Unicode NFKC. Spark has no such function, so rows with non-ASCII text pass through Python."""

    text = lit_or_col(text)
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def name_key(name: str | Column) -> Column:
    """Comparison key of a name: NFKC, case folded, only digits, a-z and CJK kept. Suffixes are kept."""

    name = lit_or_col(name)
    folded = F.coalesce(_nfkc_folded(F.when(name.rlike(r"[^\x00-\x7F]"), name)), F.lower(name))
    return F.regexp_replace(folded, "[^0-9a-z㐀-鿿]+", "")


def name_keys(names: str | Column) -> Column:
    """``name_key`` over an array; lists of ASCII names stay on the JVM."""

    names = lit_or_col(names)
    wide = F.exists(names, lambda x: x.rlike(r"[^\x00-\x7F]"))
    folded = F.coalesce(_nfkc_folded_each(F.when(wide, names)), F.transform(names, lambda x: F.lower(F.coalesce(x, F.lit("")))))
    return F.transform(folded, lambda x: F.regexp_replace(x, "[^0-9a-z㐀-鿿]+", ""))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nfkc_folded_each(lists: pa.Array) -> pa.Array:
    return in_parts(lists, lambda items: [unicodedata.normalize("NFKC", x or "").casefold() for x in items])


def string_list(*values: Column) -> Column:
    """Scalars to an ordered list of distinct non-blank strings."""

    return F.array_distinct(F.filter(F.array(*[F.trim(v.cast("string")) for v in values]), lambda x: x.isNotNull() & (x != "")))


def text_key(text: str | Column) -> Column:
    """Loose matching key: lower case, without white space and bracket or dot marks."""

    return F.regexp_replace(F.lower(F.trim(F.coalesce(lit_or_col(text), F.lit("")))), r"(?U)[\s·・()（）【】\[\]{}]+", "")
