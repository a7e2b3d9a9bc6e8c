"""JSON envelopes: find the row list, page totals and embedded objects."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import defaults as d
from gleanery.functions.text import first_not_null, let, lit_or_col

ROWS = "array<variant>"
FIELDS = "map<string,variant>"


def path(*keys: str) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def list_of(value: Column) -> Column:
    """The items of a JSON list, NULL for anything else."""

    return F.try_variant_get(value, "$", ROWS)


def fields_of(value: Column) -> Column:
    """The fields of a JSON object, NULL for anything else."""

    return F.try_variant_get(value, "$", FIELDS)


def is_array(value: Column) -> Column:
    return list_of(value).isNotNull()


def is_object(value: Column) -> Column:
    return fields_of(value).isNotNull()


def texts(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def row_list(payload: Column, keys=tuple(d.ROW_LIST_KEYS), wrappers=tuple(d.ROW_LIST_WRAPPERS)) -> Column:
    """First known list in the envelope as ``array<variant>``; NULL when none is found.

    Own keys come first, then each wrapper in order: its own keys, then the wrappers inside it.
    """

    own = lambda m: first_not_null(F.transform(texts(keys), lambda k: list_of(F.try_element_at(m, k))))
    inner = lambda m: F.filter(F.transform(texts(wrappers), lambda w: fields_of(F.try_element_at(m, w))), lambda x: x.isNotNull())

    def deep(m):
        level = F.flatten(F.transform(inner(m), lambda x: F.concat(F.array(own(x)), F.transform(inner(x), lambda y: own(y)))))
        return F.coalesce(own(m), first_not_null(level))

    return let(payload, lambda v: F.coalesce(list_of(v), let(fields_of(v), deep)))


def unwrap(df: DataFrame, body: str, item: str = "item", found: str = "found") -> DataFrame:
    """One row per item of each JSON body. Bodies without a list stay as one row with ``found = false``."""

    df = df.withColumn("_rows", row_list(F.try_parse_json(F.col(body))))
    return df.withColumn(found, F.col("_rows").isNotNull()).select(
        "*", F.posexplode_outer("_rows").alias("item_no", item)).drop("_rows")


def _rows_at_any_depth(keys: tuple[str, ...]):
    """Objects in known lists of each payload: an envelope's own lists first, then the envelopes inside it, in key order."""

    def walk(text):
        root = json.loads(text)
        found, todo = (list(root), []) if isinstance(root, list) else ([], [root])
        while todo:
            value = todo.pop()
            known = [value[k] for k in keys if k in value]
            for item in known:
                found += item if isinstance(item, list) else []
            todo += [item for item in reversed(known) if isinstance(item, dict)]
        return [json.dumps(x, ensure_ascii=False) for x in found if isinstance(x, dict)]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def rows(payloads: pd.Series) -> pd.Series:
        return payloads.map(walk, na_action="ignore")

    return rows


def all_directory_rows(payload: Column, keys=tuple(d.DIRECTORY_LIST_KEYS)) -> Column:
    """Every object in every known list, in the envelope and in the envelopes inside it, to any depth: hits are joined.

    Two levels are read on the JVM; only payloads with an envelope below them are walked in Python.
    """

    empty = F.array().cast(ROWS)
    at = lambda m, read: F.filter(F.transform(texts(keys), lambda k: read(F.try_element_at(m, k))), lambda x: x.isNotNull())
    lists = lambda m: F.flatten(at(m, list_of))

    def rows(m):
        return F.concat(lists(m), F.flatten(F.transform(at(m, fields_of), lambda x: lists(x))))

    # two envelopes in one payload may lie in one another; the walk decides
    body, envelope = payload.cast("string"), rf'"(?:{"|".join(re.escape(k) for k in keys)})":\{{'
    deeper = body.rlike(rf"(?s){envelope}.*{envelope}")
    walked = F.transform(_rows_at_any_depth(tuple(keys))(F.when(deeper, body)), lambda x: F.parse_json(x))
    every = let(payload, lambda v: F.coalesce(list_of(v), let(fields_of(v), rows), empty))
    return F.coalesce(walked, F.filter(every, is_object))


def first_field(item: Column, *keys: str) -> Column:
    """First field that is neither NULL, blank, ``[]`` nor ``{}``, as text."""

    got = F.array(*[F.try_variant_get(item, path(k), "string") for k in keys])
    return F.try_element_at(F.filter(got, lambda g: g.isNotNull() & ~g.isin("", "[]", "{}")), F.lit(1))


def first_variant(item: Column, *keys: str) -> Column:
    got = F.array(*[F.try_variant_get(item, path(k), "variant") for k in keys])
    return F.try_element_at(F.filter(got, lambda v: F.coalesce(F.try_variant_get(v, "$", "string") != "", F.lit(False))), F.lit(1))


def first_number(payload: Column, wrappers: list[str], keys: list[str]) -> Column:
    """First whole number under the keys, in the envelope itself and then in each wrapper."""

    number = lambda m: first_not_null(F.transform(texts(keys), lambda k: F.try_variant_get(F.try_element_at(m, k), "$", "string").try_cast("bigint")))
    inner = lambda m: F.transform(texts(wrappers), lambda w: number(fields_of(F.try_element_at(m, w))))
    return let(fields_of(payload), lambda m: F.coalesce(number(m), first_not_null(inner(m))))


def page_meta(payload: Column) -> Column:
    """Struct (total, page_size) from the usual pagination envelopes."""

    return let(payload, lambda p: F.struct(
        first_number(p, d.PAGE_META_WRAPPERS, d.PAGE_TOTAL_KEYS).alias("total"),
        first_number(p, d.PAGE_META_WRAPPERS, d.PAGE_SIZE_KEYS).alias("page_size")))


def listing_page(payload: Column) -> Column:
    """Struct (items, total) of one listing page; the total is only read when a list was found."""

    empty = F.array().cast(ROWS)
    return let(payload, lambda p: let(row_list(p), lambda rows: F.struct(
        F.coalesce(F.filter(rows, is_object), empty).alias("items"),
        F.when(rows.isNotNull(), first_number(p, ["data"], d.LISTING_TOTAL_KEYS)).alias("total"))))


def payload_kind(content_type: str | Column, body: str | Column) -> Column:
    """``json`` by content type or first character, else ``html``."""

    json = F.lower(F.coalesce(lit_or_col(content_type), F.lit(""))).contains("json") | lit_or_col(body).rlike(r"^\s*[\[{]")
    return F.when(json, F.lit("json")).otherwise(F.lit("html"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _graphs_at_any_depth(blocks: pd.Series) -> pd.Series:
    def walk(texts_):
        found = []
        for text in texts_:
            try:
                todo = [json.loads(text)]
            except (TypeError, ValueError):
                continue
            while todo:
                value = todo.pop()
                if isinstance(value, list):
                    todo += reversed(value)
                elif isinstance(value, dict):
                    todo.append(value["@graph"]) if value.get("@graph") is not None else found.append(value)
        return [json.dumps(x, ensure_ascii=False) for x in found]

    return blocks.map(walk, na_action="ignore")


def jsonld_objects(blocks: Column) -> Column:
    """JSON-LD script texts to their objects, ``@graph`` lists opened to any depth (the first two levels on the JVM)."""

    graph = lambda v: F.try_variant_get(v, "$['@graph']", "variant")
    as_list = lambda v: F.coalesce(list_of(v), F.array(v))
    level = F.flatten(F.transform(F.filter(F.transform(blocks, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull()), as_list))
    for _ in range(2):
        level = F.flatten(F.transform(level, lambda v: as_list(F.coalesce(graph(v), v))))
    graphs = r'"@graph"\s*:'
    deeper = F.array_join(blocks, " ").rlike(rf"(?s){graphs}.*{graphs}.*{graphs}|\[\s*\[")
    walked = F.transform(_graphs_at_any_depth(F.when(deeper, blocks)), lambda x: F.parse_json(x))
    return F.coalesce(walked, F.filter(level, is_object))


def is_type(item: Column, name: str = "jobposting") -> Column:
    """``@type``, single or list, ends in the name (plain or as the tail of a URL)."""

    pattern = rf"(?i)(^|/){name}/?$"
    many = F.try_variant_get(item, "$['@type']", "array<string>")
    one = F.try_variant_get(item, "$['@type']", "string")
    return F.coalesce(F.exists(many, lambda t: t.rlike(pattern)), one.rlike(pattern), F.lit(False))


_LITERAL_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\Z)|\'(?:[^\'\\]|\\.)*+(?:\'|\Z)|[{}]', re.S)


@F.pandas_udf(T.StringType())
def _object_literal(texts_: pd.Series) -> pd.Series:
    """Each text up to the brace that closes its first one. Strings are whole tokens, so braces in them do not count."""

    def cut(text):
        level = 0
        for token in _LITERAL_TOKENS.finditer(text):
            level += {"{": 1, "}": -1}.get(token[0], 0)
            if not level:
                return text[: token.end()]
        return None

    return texts_.map(cut, na_action="ignore")


def assigned_object(text: str | Column, name: str) -> Column:
    """Object literal assigned to a script variable, as VARIANT; braces are matched, nothing is evaluated."""

    tail = F.regexp_extract(lit_or_col(text), rf"(?is)(?:window\.)?{name}\s*=\s*(\{{.*)$", 1)
    literal = _object_literal(F.nullif(tail, F.lit("")))
    read = lambda x: F.coalesce(F.try_parse_json(x), F.try_parse_json(F.replace(x, F.lit("'"), F.lit('"'))))
    return let(read(literal), lambda v: F.when(is_object(v), v))
