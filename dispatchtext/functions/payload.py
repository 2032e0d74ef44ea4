"""Strict JSON payloads of requests as columns: types are looked at, nothing is coerced into a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that count as yes and no where a flag comes as a string, in any case.
YES = ("1", "on", "t", "true", "y", "yes")
NO = ("0", "off", "f", "false", "n", "no")
NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def json_whole(payload: Column, kind: str) -> Column:
    """The payload read as `kind` if it is one whole JSON value, else null.

    Spark's parser stops after the first value. The payload is therefore read inside an object that ends with its own
    digest: the digest is found, and the object has two keys, only if nothing stands around the payload's value.
    """
    seal = F.md5(payload)
    wrapped = F.concat(F.lit('{"body":'), payload, F.lit(',"seal":"'), seal, F.lit('"}'))
    read = F.from_json(wrapped, f"body {kind}, seal string", {"allowSingleQuotes": "false"})
    return F.when((read["seal"] == seal) & (F.size(F.json_object_keys(wrapped)) == 2), read["body"])


def json_fields(payload: Column) -> Column:
    """Fields (key, value as a variant) of a payload that is one JSON object, else null; a key that comes twice is listed twice."""
    return F.map_entries(json_whole(payload, "map<string,variant>"))


def field(fields: Column, key: str) -> Column:
    """Value of a key; the last one counts."""
    return F.try_element_at(F.filter(fields, lambda f: f["key"] == key), F.lit(-1))["value"]


def kind(value: Column) -> Column:
    """BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, VOID, ARRAY, OBJECT; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def flag(value: Column) -> Column:
    """A flag's value: no value is false; booleans, 0, 1 and the words YES and NO count; anything else gives null."""
    word, number = F.lower(F.try_variant_get(value, "$", "string")), F.try_variant_get(value, "$", "double")
    return (
        F.when(value.isNull(), F.lit(False)).when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind(value).isin(*NUMBERS), F.when(number == 1, F.lit(True)).when(number == 0, F.lit(False)))
        .when(kind(value) == "STRING", F.when(word.isin(*YES), F.lit(True)).when(word.isin(*NO), F.lit(False)))
    )


def decode_payload(payload: Column) -> tuple[Column, Column, Column]:
    """(text, debug, error code) of a payload: one JSON object with a string `text` and perhaps a flag `debug`, no other key."""
    fields = json_fields(payload)
    text, debug = field(fields, "text"), flag(field(fields, "debug"))
    other = F.exists(fields, lambda f: ~f["key"].isin("text", "debug"))
    good = F.coalesce(fields.isNotNull() & ~other & (kind(text) == "STRING") & debug.isNotNull(), F.lit(False))
    return F.when(good, F.try_variant_get(text, "$", "string")), F.when(good, debug), F.when(~good, F.lit("invalid_input"))
