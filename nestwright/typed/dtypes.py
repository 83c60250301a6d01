"""Python annotations as Spark types, and values as both write them."""

from __future__ import annotations

import datetime as dt
import types
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from typing import Annotated, Any, TypeAliasType, Union, get_args, get_origin

from pyspark.sql import types as T


@dataclass(frozen=True)
class Unsigned:
    """Marks an integer that must be from 0 to 2**bits - 1."""

    bits: int


@dataclass(frozen=True)
class Unit:
    """Marks the unit that a time was declared in. Spark keeps microseconds; coarser units are cut on the way in."""

    name: str


I8, I16, I32, I64 = (Annotated[int, t] for t in (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()))
U8, U16, U32, U64 = (Annotated[int, t, Unsigned(b)] for t, b in ((T.ShortType(), 8), (T.IntegerType(), 16), (T.LongType(), 32), (T.DecimalType(20, 0), 64)))
F32, F64 = Annotated[float, T.FloatType()], Annotated[float, T.DoubleType()]
TimestampMs, TimestampUs, TimestampNs = (Annotated[dt.datetime, T.TimestampNTZType(), Unit(u)] for u in ("ms", "us", "ns"))
DurationMs, DurationUs, DurationNs = (Annotated[dt.timedelta, T.DayTimeIntervalType(), Unit(u)] for u in ("ms", "us", "ns"))

#: Spark types of plain Python ones.
PLAIN: dict[Any, T.DataType] = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType(), dt.date: T.DateType(), dt.datetime: T.TimestampNTZType(), dt.timedelta: T.DayTimeIntervalType()}


def opened(annotation: Any) -> tuple[Any, list[Any]]:
    """The annotation without type aliases, Annotated and Optional, and what Annotated added."""
    extra: list[Any] = []
    while True:
        if isinstance(annotation, TypeAliasType):
            annotation = annotation.__value__
        elif get_origin(annotation) is Annotated:
            annotation, *more = get_args(annotation)
            extra = [*more, *extra]
        elif get_origin(annotation) in (Union, types.UnionType):
            kinds = [a for a in get_args(annotation) if a is not type(None)]
            if len(kinds) != 1:
                return annotation, extra
            annotation = kinds[0]
        else:
            return annotation, extra


def bare(annotation: Any) -> Any:
    """The annotation with the same done inside lists, tuples and dicts, for comparison."""
    kind, _ = opened(annotation)
    if args := get_args(kind):
        return (get_origin(kind), *(a if a is Ellipsis else bare(a) for a in args))
    return kind


def spark_type(annotation: Any) -> T.DataType:
    kind, extra = opened(annotation)
    declared = [e for e in extra if isinstance(e, T.DataType)]
    if declared:
        return declared[-1]
    if kind in PLAIN:
        return PLAIN[kind]
    args = get_args(kind)
    if get_origin(kind) is list and len(args) == 1:
        return T.ArrayType(spark_type(args[0]))
    if get_origin(kind) is dict and len(args) == 2:
        return T.ArrayType(T.StructType([T.StructField("key", spark_type(args[0])), T.StructField("value", spark_type(args[1]))]))
    raise TypeError(f"Cannot infer a Spark dtype from {annotation!r}")


def _writer(annotation: Any, kind: T.DataType) -> Callable[[Any], Any] | None:
    own, extra = opened(annotation)
    args = get_args(own)
    if get_origin(own) is list and isinstance(kind, T.ArrayType):
        inner = writer(args[0], kind.elementType)
        return lambda v: [inner(x) for x in v]
    if get_origin(own) is dict and isinstance(kind, T.ArrayType):
        key, value = (writer(a, f.dataType) for a, f in zip(args, kind.elementType.fields, strict=True))
        return lambda v: [(key(k), value(x)) for k, x in v.items()]
    for mark in extra:
        if isinstance(mark, Unsigned):

            def unsigned(v: Any, bits: int = mark.bits) -> Any:
                if not isinstance(v, int) or isinstance(v, bool) or not 0 <= v < 1 << bits:
                    raise ValueError(f"{v!r} isn't an unsigned integer of {bits} bits")
                return Decimal(v) if bits == 64 else v

            return unsigned
        if isinstance(mark, Unit) and mark.name == "ms":
            if own is dt.timedelta:
                return lambda v: dt.timedelta(milliseconds=v // dt.timedelta(milliseconds=1))
            return lambda v: v.replace(microsecond=v.microsecond // 1000 * 1000)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return None


def writer(annotation: Any, kind: T.DataType) -> Callable[[Any], Any]:
    """Values as createDataFrame takes them; None stays."""
    own = _writer(annotation, kind)
    return (lambda v: v) if own is None else (lambda v: None if v is None else own(v))


def _reader(annotation: Any) -> Callable[[Any], Any] | None:
    own, extra = opened(annotation)
    args = get_args(own)
    if get_origin(own) is list:
        inner = reader(args[0])
        return lambda v: [inner(x) for x in v]
    if get_origin(own) is dict:
        key, value = map(reader, args)
        return lambda v: {key(k): value(x) for k, x in (v.items() if isinstance(v, dict) else (tuple(e) for e in v))}
    if any(isinstance(m, Unsigned) and m.bits == 64 for m in extra):
        return int
    if own is bytes:
        return bytes
    return None


def reader(annotation: Any) -> Callable[[Any], Any]:
    """Values of rows as models hold them."""
    own = _reader(annotation)
    return (lambda v: v) if own is None else (lambda v: None if v is None else own(v))


def metadata(annotation: Any) -> dict[str, str]:
    return next(({"unit": e.name} for e in opened(annotation)[1] if isinstance(e, Unit)), {})
