"""Structural check of raw holdings documents, before anything in them is typed.

A document is parsed to a VARIANT, which keeps unknown fields and the types that values were
sent with.  Objects and lists become maps and arrays of variants, are unfolded, and every value
is held against the rule of its field.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import ASSET_TYPES
from ..storage import materialize
from .quality import (
    COLLECTION_STATUSES,
    DATE_SHAPE,
    DATE_STATUSES,
    ETF_CODE_SHAPE,
    INSTANT_SHAPE,
    PROVIDERS,
    SOURCE_TYPES,
    VERSION_SHAPE,
)


@dataclass(frozen=True)
class Field:
    """What a field may hold: JSON types, and for texts a pattern, a list or a least length."""

    types: tuple[str, ...]
    required: bool = False
    pattern: str | None = None
    allowed: tuple[str, ...] | None = None
    filled: bool = False


def _text(**rules) -> Field:
    return Field(("string",), **rules)


_TEXT_OR_NULL, _NUMBER_OR_NULL = Field(("string", "null")), Field(("number", "integer", "null"))

# The holdings document.  A path ending in [] is that of a list's items.
RULES: dict[str, dict[str, Field]] = {
    "$": {
        "schemaVersion": _text(required=True, pattern=VERSION_SHAPE),
        "etfCode": _text(required=True, pattern=ETF_CODE_SHAPE),
        "etfName": _text(required=True, filled=True),
        "baseDate": _text(required=True, pattern=DATE_SHAPE),
        "generatedAt": _text(required=True, pattern=INSTANT_SHAPE),
        "source": Field(("object",), required=True),
        "collection": Field(("object",), required=True),
        "holdings": Field(("array",), required=True),
        "diagnostics": Field(("object",)),
        "dateResolution": Field(("object", "null")),
    },
    "$.source": {
        "provider": _text(required=True, allowed=PROVIDERS),
        "sourceType": Field(("string", "null"), allowed=SOURCE_TYPES),
        "isFallback": Field(("boolean",), required=True),
    },
    "$.collection": {
        "status": _text(required=True, allowed=COLLECTION_STATUSES),
        "attemptedProviders": Field(("array",)),
        "message": _TEXT_OR_NULL,
    },
    "$.dateResolution": {
        "requestedDate": _TEXT_OR_NULL,
        "resolvedBaseDate": _TEXT_OR_NULL,
        "lookbackDays": Field(("integer", "null")),
        "status": _text(allowed=DATE_STATUSES),
    },
    "$.holdings[]": {
        "assetCode": _text(required=True, filled=True),
        "assetName": _text(required=True, filled=True),
        "assetType": _text(required=True, allowed=ASSET_TYPES),
        "market": _TEXT_OR_NULL,
        "currency": _TEXT_OR_NULL,
        "quantity": _NUMBER_OR_NULL,
        "contractCount": _NUMBER_OR_NULL,
        "marketValue": _NUMBER_OR_NULL,
        "weightPct": _NUMBER_OR_NULL,
        "rank": Field(("integer", "null")),
        "rawAssetCode": _TEXT_OR_NULL,
    },
}
ITEMS = {"$.collection.attemptedProviders[]": _text(allowed=PROVIDERS), "$.holdings[]": Field(("object",))}


def kind_of(value: Column) -> Column:
    """JSON type of a variant; a number without a fraction is an integer, however it is written.

    Objects and lists are told by opening them one level; their schema would be that of all
    that is in them.
    """
    name = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(F.is_variant_null(value), "null")
        .when(F.try_variant_get(value, "$", "map<string,variant>").isNotNull(), "object")
        .when(F.try_variant_get(value, "$", "array<variant>").isNotNull(), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(number == F.floor(number), "integer")
        .otherwise("number")
    )


def _findings(path: Column, rule: Field, value: Column, kind: Column) -> Column:
    """Array of (path, error) of one value."""
    text = F.try_variant_get(value, "$", "string")
    is_text = kind == "string"
    checks = [("type", ~kind.isin(*rule.types))]
    if rule.pattern:
        checks.append(("pattern", is_text & ~text.rlike(rule.pattern)))
    if rule.allowed:
        checks.append(("enum", is_text & ~text.isin(*rule.allowed)))
    if rule.filled:
        checks.append(("minLength", is_text & (text == "")))
    return F.array_compact(F.array(*[F.when(bad, F.struct(path.alias("path"), F.lit(name).alias("error"))) for name, bad in checks]))


def _fields(objects: DataFrame, keys: Sequence[str], at: str, must: bool = False) -> DataFrame:
    """Errors of the fields of the objects in ``value``: unknown, missing and wrong ones.

    If they ``must`` be objects, another value has the error type; else it has none here.
    """
    rules = RULES[at]
    opened = objects.select(*keys, F.try_variant_get("value", "$", "map<string,variant>").alias("fields"))
    opened = opened if must else opened.where("fields is not null")
    named = F.map_keys("fields")
    absent = [F.when(~F.array_contains(named, n), F.lit(f"{at}.{n}")) for n, rule in rules.items() if rule.required]
    unknown = F.transform(F.array_except(named, F.array(*[F.lit(n) for n in rules])), lambda n: F.concat(F.lit(f"{at}."), n))

    def all_of(paths: Column, error: str) -> Column:
        return F.transform(paths, lambda p: F.struct(p.alias("path"), F.lit(error).alias("error")))

    found = [all_of(unknown, "additionalProperties")]
    if absent:
        found.append(all_of(F.array_compact(F.array(*absent)), "required"))
    found = F.concat(*found)
    if must:
        found = F.when(F.col("fields").isNull(), F.array(F.struct(F.lit(at).alias("path"), F.lit("type").alias("error")))).otherwise(found)
    picked = opened.select(*keys, found.alias("found"), *[F.element_at("fields", n).alias(f"v_{n}") for n in rules])
    kinds = picked.withColumns({f"k_{n}": kind_of(F.col(f"v_{n}")) for n in rules})
    nothing = F.array().cast("array<struct<path:string,error:string>>")
    values = [F.when(F.col(f"v_{n}").isNotNull(), _findings(F.lit(f"{at}.{n}"), rule, F.col(f"v_{n}"), F.col(f"k_{n}"))).otherwise(nothing) for n, rule in rules.items()]
    return kinds.select(*keys, F.inline(F.concat("found", *values)))


def check_raw_documents(documents: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """(keys, path, error, count) of what is wrong with JSON documents, equal errors counted.

    ``path`` is that of the field, with [] for any item of a list.  Errors: json (no JSON),
    type, required, additionalProperties, pattern, enum, minLength.  A document of null is not
    there and has the error json; one without errors has no row.  Lists are unfolded, so a
    document with very many holdings is checked row by row, and only counts are shuffled.
    """
    keys = list(keys)
    # Written once, as the checks of the parts all read it.
    parsed = materialize(documents.select(*keys, F.try_parse_json(F.col(body)).alias("value")), "parsed")
    broken = parsed.where("value is null").select(*keys, F.lit("$").alias("path"), F.lit("json").alias("error"))
    whole = parsed.where("value is not null")
    wrong_root = whole.where(kind_of(F.col("value")) != "object").select(*keys, F.lit("$").alias("path"), F.lit("type").alias("error"))
    found = [broken, wrong_root, _fields(whole, keys, "$")]
    for at in ("$.source", "$.collection", "$.dateResolution"):
        inner = whole.select(*keys, F.try_variant_get("value", at, "variant").alias("value"))
        found.append(_fields(inner.where("value is not null"), keys, at))
    for at, rule in ITEMS.items():
        lists = whole.select(*keys, F.try_variant_get("value", at.removesuffix("[]"), "array<variant>").alias("items"))
        items = lists.select(*keys, F.explode("items").alias("value"))
        if at in RULES:
            found.append(_fields(items, keys, at, must=True))
            continue
        judged = items.withColumn("kind", kind_of(F.col("value")))
        found.append(judged.select(*keys, F.inline(_findings(F.lit(at), rule, F.col("value"), F.col("kind")))))
    errors = reduce(DataFrame.unionByName, found)
    return errors.groupBy(*keys, "path", "error").agg(F.count(F.lit(1)).alias("count"))
