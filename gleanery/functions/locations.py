"""Places: visible text to structured locations, without guessing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery import defaults as d
from gleanery.functions.rules import has_any, words_pattern
from gleanery.functions.text import clean_each, lit_or_col, single_spaced

FIELDS = ("scope", "country_code", "province_code", "city_code", "district_code", "display_name", "raw")
LOCATION_TYPE = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"
MAINLAND, HMT, ABROAD, REMOTE, UNKNOWN_SCOPE = "MAINLAND_CHINA", "HONG_KONG_MACAU_TAIWAN", "OVERSEAS", "REMOTE", "UNKNOWN"


def location(**parts: Column | str | None) -> Column:
    value = lambda p: p if isinstance(p, Column) else F.lit(p)
    return F.struct(*[value(parts.get(f)).cast("string").alias(f) for f in FIELDS])


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(pairs: dict[str, str]) -> Column:
    """A fixed table as one literal map."""

    return F.expr("map(" + ", ".join(f"{_quote(k)}, {_quote(v)}" for k, v in pairs.items()) + ")")


def _first_contained(text: Column, pairs: dict[str, str]) -> Column:
    """Value of the first listed name found inside the text."""

    table = F.expr("array(" + ", ".join(f"named_struct('name', {_quote(k)}, 'value', {_quote(v)})" for k, v in pairs.items()) + ")")
    found = F.filter(table, lambda x: F.contains(text, x["name"]))
    return F.try_element_at(found, F.lit(1))["value"]


def _locate(raw: Column) -> Column:
    """One cleaned place text to one location; the order of the steps decides."""

    compact = F.trim(F.replace(raw, F.lit("市"), F.lit("")))
    abroad = _first_contained(compact, {k: f"{c}|{n}" for k, (c, n) in d.OVERSEAS.items()})
    abroad = F.coalesce(F.try_element_at(literal_map({k: f"{c}|{n}" for k, (c, n) in d.OVERSEAS.items()}), compact), abroad)
    country, country_name = F.split_part(abroad, F.lit("|"), F.lit(1)), F.split_part(abroad, F.lit("|"), F.lit(2))
    district = _first_contained(compact, {k: f"{p}|{c}|{k}" for k, (p, c) in d.DISTRICTS.items()})
    d_part = lambda i: F.split_part(district, F.lit("|"), F.lit(i))
    city_key = F.regexp_replace(compact, "[区县]", "")
    city_province = F.try_element_at(literal_map(d.MAINLAND_CITIES), city_key)
    province = _first_contained(compact, d.PROVINCES)
    join = lambda *parts: F.concat_ws("-", *parts)
    return (
        F.when(compact.rlike(words_pattern(d.REMOTE_WORDS)), location(scope=REMOTE, display_name="远程", raw=raw))
        .when(abroad.isNotNull(), location(scope=ABROAD, country_code=country, raw=raw,
                                           display_name=F.concat(country_name, F.lit(" · "), compact)))
        .when(compact.isin(*d.HK_MO_TW), location(scope=HMT, country_code=F.try_element_at(literal_map(d.HK_MO_TW), compact),
                                                  display_name=compact, raw=raw))
        .when(district.isNotNull(), location(scope=MAINLAND, country_code="CN", province_code=d_part(1),
                                             city_code=join(d_part(1), d_part(2)), district_code=join(d_part(1), d_part(3)),
                                             display_name=F.concat(d_part(2), F.lit(" · "), d_part(3)), raw=raw))
        .when(city_province.isNotNull(), location(scope=MAINLAND, country_code="CN", province_code=city_province,
                                                  city_code=join(city_province, city_key), display_name=city_key, raw=raw))
        .when(province.isNotNull(), location(scope=MAINLAND, country_code="CN", province_code=province,
                                             display_name=compact, raw=raw))
        .when(compact.isin(*d.NATIONWIDE), location(scope=MAINLAND, country_code="CN", display_name="全国", raw=raw))
        .otherwise(location(scope=UNKNOWN_SCOPE, raw=raw, display_name=F.coalesce(F.nullif(compact, F.lit("")), F.lit(d.UNKNOWN))))
    )


def parse_locations(text: str | Column) -> Column:
    """Place text to an array of distinct locations."""

    text = F.coalesce(lit_or_col(text), F.lit(""))
    pieces = F.filter(F.split(text, d.LOCATION_SEPARATORS), lambda p: single_spaced(p) != "")
    pieces = F.when(F.size(pieces) == 0, F.array(F.lit(d.UNKNOWN))).otherwise(pieces)
    return F.array_distinct(F.transform(clean_each(pieces), lambda p: _locate(p)))


def complete_locations(given: str | Column) -> Column:
    """Structured locations from a feed, missing codes filled from the dictionary; an unknown scope is replaced."""

    def fill(item):
        raw = F.coalesce(F.nullif(item["raw"], F.lit("")), item["display_name"])
        head = F.trim(F.try_element_at(F.filter(F.split(raw, d.LOCATION_SEPARATORS), lambda p: F.trim(p) != ""), F.lit(1)))
        base = _locate(F.coalesce(head, F.lit(d.UNKNOWN)))
        merged = F.struct(
            item["scope"].alias("scope"),
            *[F.coalesce(F.nullif(item[f], F.lit("")), base[f]).alias(f) for f in FIELDS[1:]],
        )
        unknown = F.coalesce(item["scope"], F.lit(UNKNOWN_SCOPE)) == UNKNOWN_SCOPE
        return F.when(unknown, base).otherwise(merged)

    return F.array_distinct(F.transform(lit_or_col(given), fill))


def normalize_locations(text: str | Column, given: str | Column | None = None) -> Column:
    if given is None:
        return parse_locations(text)
    given = lit_or_col(given)
    return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, complete_locations(given)).otherwise(parse_locations(text))


def rename_location_fields(items: Column) -> Column:
    """Variant array of strings or objects in the common spellings to location structs; nothing is guessed."""

    def pick(item, *names):
        got = [F.try_variant_get(item, f"$.{n}", "string") for n in names]
        return F.coalesce(*[F.nullif(g, F.lit("")) for g in got])

    def rename(item):
        plain = F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))
        shown = F.coalesce(plain, pick(item, "display_name", "displayName", "city", "name"))
        return F.struct(
            pick(item, "scope", "locationScope").alias("scope"),
            pick(item, "country_code", "countryCode").alias("country_code"),
            pick(item, "province_code", "provinceCode").alias("province_code"),
            pick(item, "city_code", "cityCode").alias("city_code"),
            pick(item, "district_code", "districtCode").alias("district_code"),
            shown.alias("display_name"),
            F.coalesce(pick(item, "raw"), shown).alias("raw"),
        )

    return F.filter(F.transform(items, rename), lambda x: F.coalesce(x["display_name"], F.lit("")) != "")


def split_cities(text: str | Column) -> Column:
    parts = F.split(F.coalesce(lit_or_col(text), F.lit("")), "[、/，,；;|]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), "市$", "")), lambda p: p != ""))


def page_locations(city: str | Column, given: str | Column) -> Column:
    """Locations for the page: given ones, else the city text read with the page's own dictionary."""

    def read(place):
        country = F.try_element_at(literal_map(d.PAGE_OVERSEAS), place)
        province = F.try_element_at(literal_map(d.PAGE_CITY_PROVINCE), place)
        parent = F.try_element_at(literal_map(d.PAGE_CITY_PARENT), place)
        label = F.coalesce(F.try_element_at(literal_map(d.COUNTRY_LABELS), country), country)
        shown = (F.when(country.isNotNull(), F.concat(label, F.lit(" · "), place))
                 .when(parent.isNotNull(), F.concat(parent, F.lit(" · "), place)).otherwise(place))
        return location(scope=F.when(country.isNotNull(), F.lit(ABROAD)).otherwise(F.lit(MAINLAND)), country_code=country,
                        province_code=province, city_code=F.concat_ws("-", F.coalesce(province, F.lit("UNKNOWN")), place),
                        display_name=shown, raw=place)

    given = lit_or_col(given)
    return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(F.transform(split_cities(city), read))


def display_locations(city: str | Column, given: str | Column, empty: str = "地点待定") -> Column:
    shown = F.array_distinct(F.filter(F.transform(lit_or_col(given), lambda x: F.trim(x["display_name"])), lambda x: x != ""))
    cities = split_cities(city)
    return (
        F.when(F.coalesce(F.size(shown), F.lit(0)) > 0, F.array_join(shown, "、"))
        .when(F.size(cities) > 0, F.array_join(cities, "、"))
        .otherwise(F.coalesce(F.nullif(lit_or_col(city), F.lit("")), F.lit(empty)))
    )


def repair_web_locations(given: str | Column) -> Column:
    """Unknown places stay only if they name a known city and are not requirement text; else one to-confirm row."""

    label = lambda x: F.coalesce(F.nullif(x["display_name"], F.lit("")), x["raw"], F.lit(""))
    unknown = lambda x: F.coalesce(x["scope"], F.lit(UNKNOWN_SCOPE)) == UNKNOWN_SCOPE
    fits = lambda x: (has_any(label(x), d.ROW_CITY_WORDS) & (F.length(label(x)) <= 80)
                      & ~label(x).rlike(d.LOCATION_REQUIREMENT_WORDS))

    def repair(x):
        fixed = F.struct(
            F.lit(MAINLAND).alias("scope"), F.coalesce(x["country_code"], F.lit("CN")).alias("country_code"),
            x["province_code"].alias("province_code"), x["city_code"].alias("city_code"),
            x["district_code"].alias("district_code"), label(x).alias("display_name"),
            F.coalesce(F.nullif(x["raw"], F.lit("")), label(x)).alias("raw"),
        )
        return F.when(unknown(x), fixed).otherwise(x)

    items = F.coalesce(lit_or_col(given), F.array().cast(f"array<{LOCATION_TYPE}>"))
    kept = F.transform(F.filter(items, lambda x: ~unknown(x) | fits(x)), repair)
    confirm = F.array(location(scope=MAINLAND, country_code="CN", display_name="地点待确认", raw=d.UNKNOWN))
    return F.when(F.size(kept) == 0, confirm).otherwise(kept)
