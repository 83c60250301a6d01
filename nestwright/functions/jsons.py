"""JSON text to key/value lists and arrays of strings."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from nestwright.functions._inputs import flag, loose, named

#: Spark's parser accepts these unless told otherwise; JSON doesn't have them.
_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
ITEMS = "array<struct<key:string,value:string>>"


def _valid(text: Column) -> Column:
    """Whether the text is one JSON value and nothing more. Inside an array it must be the only element, and inside
    an object the only field: text that closes one kind of bracket early can't close the other."""
    alone = F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _OPTIONS)) == 1
    field = F.size(F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>", _OPTIONS)) == 1
    return F.coalesce(alone & field, F.lit(False)) & ~text.rlike(r"^\s*$")


def _read(expr: Any, strict: bool, exact: bool, opening: str, parsed: Callable[[Column], Column], kind: str, python: Callable) -> Column:
    flag("strict", strict), flag("exact", exact)
    text = loose(expr)
    checked = F.when(F.typeof(text).isin("string", "void"), text).otherwise(F.raise_error(F.concat(F.lit("expected a string, got "), F.typeof(text))).cast("string"))
    wrong = F.raise_error(F.lit("invalid JSON")).cast(kind) if strict else F.lit(None).cast(kind)
    own = F.arrow_udf(python, kind)(checked) if exact else parsed(checked)
    found = F.when(text.isNull(), F.lit(None).cast(kind)).when(~_valid(checked), wrong).when(F.ltrim(F.regexp_replace(checked, r"^[\s]+", "")).startswith(opening), own)
    return named(found, expr)


def _items(text: Column) -> Column:
    """Entries in order of a key's first place, with its last value."""
    entries = F.map_entries(F.from_json(text, "map<string,string>", _OPTIONS))
    backward = F.reverse(entries)
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    reversed_keys = F.transform(backward, lambda e: e["key"])
    rebuilt = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(backward, F.array_position(reversed_keys, k).cast("int"))["value"].alias("value")))
    return F.when(F.size(keys) == F.size(entries), entries).otherwise(rebuilt).cast(ITEMS)


def json_object_items(expr: Any, *, strict: bool = False, exact: bool = False) -> Column:
    """The entries of a JSON object, array<struct<key,value>>: strings as they are, null as null, other values as
    compact JSON text. A repeated key has its first place and its last value.

    Null for null, for valid JSON of another kind, and for invalid text, which is an error with `strict`. Numbers are
    written as Spark does; `exact` writes them as Python's json does, by an Arrow function."""
    return _read(expr, strict, exact, "{", _items, ITEMS, _python_items)


def json_array_values(expr: Any, *, strict: bool = False, exact: bool = False) -> Column:
    """The values of a JSON array as array<string>, written like those of json_object_items, and null where that is."""
    return _read(expr, strict, exact, "[", lambda t: F.from_json(t, "array<string>", _OPTIONS), "array<string>", _python_values)


def _written(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _loaded(text: str | None, kind: type) -> Any:
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return value if isinstance(value, kind) else None


def _python_items(texts: pa.Array) -> pa.Array:
    read = (_loaded(t, dict) for t in texts.to_pylist())
    return pa.array([None if v is None else [{"key": k, "value": _written(x)} for k, x in v.items()] for v in read], pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))


def _python_values(texts: pa.Array) -> pa.Array:
    read = (_loaded(t, list) for t in texts.to_pylist())
    return pa.array([None if v is None else [_written(x) for x in v] for v in read], pa.list_(pa.string()))
