"""Key/value payloads: array<struct<key, value array<string>>>, in which keys may repeat. NULL acts like empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.functions.scalar import col

KV = "array<struct<key:string,value:array<string>>>"
TYPES = ("string", "boolean", "integer", "float", "date", "timestamp", "integer_array", "json")


def entries(field: Column | str) -> Column:
    return F.coalesce(col(field), F.array().cast(KV))


def combined(*fields: Column | str) -> Column:
    return F.concat(*[entries(f) for f in fields])


def values_of(field: Column | str, key: Column | str) -> Column:
    """All values of all entries with the key, in order."""
    key = F.lit(key) if isinstance(key, str) else key
    found = F.filter(entries(field), lambda e: e["key"] == key)
    return F.flatten(F.transform(found, lambda e: F.coalesce(e["value"], F.array().cast("array<string>"))))


def cast_value(text: Column, data_type: str) -> Column:
    """A single text as one of TYPES; what cannot be read is NULL."""
    casts = {
        "string": lambda t: t, "boolean": scalar.safe_bool, "integer": scalar.safe_int, "float": scalar.safe_float, "date": scalar.string_to_date,
        "timestamp": scalar.string_to_timestamp, "integer_array": scalar.string_to_int_array, "json": lambda t: F.try_parse_json(t),
    }
    if data_type not in casts:
        raise ValueError(f"unknown data type {data_type!r}")
    return casts[data_type](text)


def joined(values: Column) -> Column:
    """Values joined by commas; an empty result is NULL."""
    return F.nullif(F.array_join(values, ","), F.lit(""))


def extract(field: Column | str, key: Column | str, data_type: str = "string", is_array: bool = False) -> Column:
    """A key's value: text joined from all values, or a typed single value (NULL if there are several), or an array."""
    return typed(values_of(field, key), data_type, is_array)


def typed(values: Column, data_type: str = "string", is_array: bool = False) -> Column:
    """All values of a key as :func:`extract` gives them."""
    if is_array:
        if data_type == "integer_array":
            raise ValueError("an integer_array cannot be an array again")
        return F.transform(values, lambda v: cast_value(v, data_type)) if data_type != "string" else values
    if data_type == "string":
        return joined(values)
    return F.when(F.size(values) <= 1, cast_value(F.get(values, F.lit(0)), data_type)) if data_type != "integer_array" else cast_value(F.get(values, F.lit(0)), data_type)


def extract_prefix(field: Column | str, prefix: str) -> Column:
    """Values of all keys that start with the prefix, concatenated by commas."""
    found = F.filter(entries(field), lambda e: F.startswith(e["key"], F.lit(prefix)))
    return joined(F.flatten(F.transform(found, lambda e: e["value"])))


def has_key(field: Column | str, key: str) -> Column:
    """Whether exactly one entry has the key."""
    return F.size(F.filter(entries(field), lambda e: e["key"] == key)) == 1


def replace_key(field: Column | str, key: Column | str, value: Column | str) -> Column:
    """Entries without the key, and one new entry with it at the end."""
    key = F.lit(key) if isinstance(key, str) else key
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.filter(entries(field), lambda e: e["key"] != key), F.array(F.struct(key.alias("key"), F.array(value).alias("value"))).cast(KV))


def flatten_pairs(field: Column | str) -> Column:
    """array<struct<key, value string>> with one pair for each value."""
    return F.flatten(F.transform(entries(field), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("key"), v.alias("value")))))


def query_text(field: Column | str) -> Column:
    """'key=value' pairs joined by '&'; NULL if there is none."""
    pairs = F.transform(flatten_pairs(field), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return F.nullif(F.array_join(pairs, "&"), F.lit(""))


def pairs_equal(a: Column | str, b: Column | str) -> Column:
    """Whether two arrays of (key, value) pairs say the same.

    Both empty: true. Else every key must be in both, with equal distributions of values: repeats in proportion are
    equal, a key with nothing but NULL values on a side equals any values, and a NULL key equals nothing.
    """
    none = F.array().cast("array<struct<key:string,value:string>>")
    a, b = F.coalesce(col(a), none), F.coalesce(col(b), none)
    keys = F.array_distinct(F.transform(F.concat(a, b), lambda p: p["key"]))

    def values(pairs: Column, key: Column) -> Column:
        return F.transform(F.filter(pairs, lambda p: p["key"] == key), lambda p: p["value"])

    def spread(own: Column, other: Column) -> Column:
        return F.array_sort(F.flatten(F.transform(own, lambda v: F.array_repeat(v, F.size(other)))))

    def same(key: Column) -> Column:
        x, y = values(a, key), values(b, key)
        known_x, known_y = F.array_compact(x), F.array_compact(y)
        present = (F.size(x) > 0) & (F.size(y) > 0)
        equal = (F.size(known_x) == 0) | (F.size(known_y) == 0) | (spread(known_x, y) == spread(known_y, x))
        return F.coalesce(key.isNotNull() & present & equal, F.lit(False))

    return F.forall(keys, same)


def attribution(field: Column | str, names: list[str], external: Column, flat: bool = True) -> dict[str, Column]:
    """Values of query parameters, by name, where ``external`` says that the visit came from elsewhere."""
    pairs = col(field) if flat else flatten_pairs(field)

    def value(name: str) -> Column:
        found = F.transform(F.filter(F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>")), lambda p: p["key"] == name), lambda p: p["value"])
        return F.when(external, joined(found))

    return {name: value(name) for name in names}
