"""URL query strings and URL assembly."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any
from urllib.parse import quote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.functions._inputs import flag, loose, named


def _quoted(text: Column) -> Column:
    """Letters, digits and `_.-~` stay, a space is `+`, other bytes are %XX."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _told(value: Column, kind: T.DataType | None) -> Column:
    """A scalar as Python writes it."""
    text = value.cast("string")
    if kind is None or isinstance(kind, T.BooleanType):
        text = F.when(F.typeof(value) == "boolean", F.initcap(text)).otherwise(text)
    return F.coalesce(text, F.lit("None"))


def _listed(value: Column, element: T.DataType) -> Column:
    quote = F.lit("'") if isinstance(element, T.StringType) else F.lit("")
    items = F.transform(value, lambda x: F.when(x.isNull(), F.lit("None")).otherwise(F.concat(quote, _told(x, element), quote)))
    return F.coalesce(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")), F.lit("None"))


def _pairs_query(pairs: Column) -> Column:
    def pair(e: Column) -> Column:
        key = F.when(e["key"].isNull(), F.raise_error(F.lit("keys must not be null")).cast("string")).when(F.typeof(e["key"]) != "string", F.raise_error(F.lit("keys must be strings")).cast("string")).otherwise(e["key"])
        return F.concat(_quoted(key), F.lit("="), _quoted(_told(e["value"], None)))

    return F.array_join(F.transform(pairs, pair), "&")


def _repeated(start: str, element: T.DataType) -> Callable[[Column], Column]:
    return lambda x: F.concat(F.lit(start), _quoted(_told(x, element)))


def _fields_query(fields: list[tuple[str, Column, T.DataType | None]], doseq: bool) -> Column:
    parts = []
    for name, value, kind in fields:
        start = quote_plus(name, safe="~") + "="
        if isinstance(kind, T.ArrayType):
            if doseq:
                many = F.array_join(F.transform(value, _repeated(start, kind.elementType)), "&")
                parts.append(F.when(value.isNull(), F.lit(start + "None")).when(F.size(value) > 0, many))
                continue
            parts.append(F.concat(F.lit(start), _quoted(_listed(value, kind.elementType))))
        else:
            parts.append(F.concat(F.lit(start), _quoted(_told(value, kind))))
    return F.concat_ws("&", *parts) if parts else F.lit("")


def _python_text(value: Any) -> str:
    if isinstance(value, list):
        return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in value) + "]"
    return value if isinstance(value, str) else str(value)


def _arrow_query(doseq: bool):
    def encode(values: pa.Array) -> pa.Array:
        pairs = pa.types.is_list(values.type) or pa.types.is_large_list(values.type)
        if not pairs and not pa.types.is_struct(values.type):
            raise TypeError(f"expected a struct or a list of key/value structs, got {values.type}")
        out: list[str | None] = []
        for row in values.to_pylist():
            if row is None:
                out.append(None)
                continue
            fields = [(e["key"], e["value"]) for e in row] if pairs else list(row.items())
            if pairs and not all(isinstance(k, str) for k, _ in fields):
                raise ValueError("keys must be strings and not null")
            flat = [(k, x) for k, v in fields for x in (v if doseq and not pairs and isinstance(v, list) else [v])]
            out.append("&".join(f"{quote_plus(k, safe='~')}={quote_plus(_python_text(v), safe='~')}" for k, v in flat))
        return pa.array(out, pa.string())

    return encode


def url_query_encode(expr: Any, *, doseq: bool = False, kind: str = "auto") -> Column:
    """A query string, encoded as forms are, of a struct's fields or of an array of {key, value} structs.

    Scalars are written as Python writes them: None, True, numbers. A list in a struct is repeated pairs with `doseq`,
    none if it is empty, else its text in brackets; `doseq` doesn't touch key/value arrays. Null gives null, a null key
    is an error. A mapping of names to columns is taken as a struct that is never null. A bare column doesn't tell its
    type, so it goes through an Arrow function; with kind="pairs" it is taken as a key/value array, with kind="plain" a
    mapping's columns as strings, integers, booleans or dates, and with with_url_query() a struct's type is known: these
    are plain Spark expressions, but for floats in key/value arrays, which Spark writes otherwise."""
    flag("doseq", doseq)
    if kind not in ("auto", "pairs", "plain"):
        raise ValueError("kind must be 'auto', 'pairs' or 'plain'")
    if isinstance(expr, Mapping):
        fields = [(name, loose(value)) for name, value in expr.items()]
        if kind == "plain" or not fields:
            return _fields_query([(name, value, None) for name, value in fields], doseq)
        return F.arrow_udf(_arrow_query(doseq), "string")(F.struct(*(value.alias(name) for name, value in fields)))
    column = loose(expr)
    if kind == "pairs":
        # The type is a constant when the query is planned, so only one of the two branches is left.
        floats = F.typeof(column).rlike("value:(float|double)")
        return named(F.when(floats, F.arrow_udf(_arrow_query(doseq), "string")(column)).otherwise(_pairs_query(column)), expr)
    return named(F.arrow_udf(_arrow_query(doseq), "string")(column), expr)


def _plain(kind: T.DataType) -> bool:
    """Whether Spark writes values of the type as Python does."""
    if isinstance(kind, T.ArrayType):
        return not isinstance(kind.elementType, T.ArrayType) and _plain(kind.elementType)
    return isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.NullType, T.DateType))


def with_url_query(df: DataFrame, column: str, out: str | None = None, *, doseq: bool = False) -> DataFrame:
    """df with the query string of a struct or key/value column as `out` (or in its place), by Spark expressions where
    the types allow it; floats, whose text Spark writes otherwise, go through the Arrow function."""
    kind = df.select(column).schema[0].dataType
    value = F.col(column)
    if isinstance(kind, T.StructType) and all(_plain(f.dataType) for f in kind):
        query = F.when(value.isNotNull(), _fields_query([(f.name, value[f.name], f.dataType) for f in kind], flag("doseq", doseq)))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and {"key", "value"} <= set(kind.elementType.names) and _plain(kind.elementType["value"].dataType):
        query = url_query_encode(value, doseq=doseq, kind="pairs")
    else:
        query = url_query_encode(value, doseq=doseq)
    return df.withColumn(out or column, query)


def url_build(*, scheme: Any = None, netloc: Any = None, path: Any = None, params: Any = None, query: Any = None, fragment: Any = None) -> Column:
    """A URL of its parts, as they are; a part that is missing, null or empty is left out. A bare string is a column's
    name. Never null. Parts that aren't strings are an error of the query."""

    def part(value: Any) -> Column:
        if value is None:
            return F.lit("")
        column = loose(value)
        typed = F.when(F.typeof(column).isin("string", "void"), column.cast("string")).otherwise(F.raise_error(F.concat(F.lit("URL parts must be strings, got "), F.typeof(column))).cast("string"))
        return F.coalesce(typed, F.lit(""))

    scheme, netloc, path, params, query, fragment = map(part, (scheme, netloc, path, params, query, fragment))
    there = lambda c: c != ""
    tail = F.concat(path, F.when(there(params), F.concat(F.lit(";"), params)).otherwise(""))
    host = there(netloc) | (there(scheme) & tail.startswith("//"))
    rooted = F.when(there(tail) & ~tail.startswith("/"), F.concat(F.lit("/"), tail)).otherwise(tail)
    return F.concat(
        F.when(there(scheme), F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host, F.concat(F.lit("//"), netloc, rooted)).otherwise(tail),
        F.when(there(query), F.concat(F.lit("?"), query)).otherwise(""),
        F.when(there(fragment), F.concat(F.lit("#"), fragment)).otherwise(""),
    ).alias("url")
