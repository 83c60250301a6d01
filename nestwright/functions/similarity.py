"""Rank-weighted similarity of ordered lists.

An item weighs p to the power of its first place, counted from 0; nulls weigh nothing but take up places. Two lists
are as similar as the sum of the lesser weights is to the sum of the greater ones, over all items of both.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable, Sequence
from numbers import Real
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestwright.functions._inputs import named, strict

_HINT = "for plain sequences use py_list_similarity"
_SCALARS = (str, bytes, int, float, datetime.date, datetime.time, datetime.timedelta)


def _decay(p: Any) -> float:
    if isinstance(p, bool) or not isinstance(p, Real):
        raise TypeError("p must be a real number")
    p = float(p)
    if not math.isfinite(p) or not 0 < p <= 1:
        raise ValueError("p must be in (0, 1]")
    return p


def _total(array: Column, p: float) -> Column:
    """The sum of the weights of a list's items, of which each counts at its first place."""
    weight = lambda k: F.when(k.isNotNull(), F.pow(F.lit(p), F.array_position(array, k) - 1)).otherwise(0.0)
    return F.aggregate(F.array_distinct(array), F.lit(0.0), lambda total, k: total + weight(k))


def _ratio(a: Column, b: Column, total: Column, p: float) -> Column:
    """The similarity of two lists whose weights add up to `total`: the lesser weight of an item that both have is that
    of its later place, and the greater weights are what the lesser ones leave of the total. Lists without items: 1."""
    lesser = lambda k: F.when(k.isNotNull(), F.pow(F.lit(p), F.greatest(F.array_position(a, k), F.array_position(b, k)) - 1)).otherwise(0.0)
    return F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda n, k: n + lesser(k), lambda n: F.coalesce(F.try_divide(n, total - n), F.lit(1.0)))


def _comparable(array: Column, nested: bool = False) -> tuple[Column, Column]:
    """Whether the items are floats, and their texts, by which those are compared: that parts 0.0 from -0.0 and joins
    NaN with NaN."""
    kind = F.typeof(array)
    floats = kind.rlike("^array<" + ("array<" if nested else "") + "(float|double)>")
    return floats, (F.transform(array, lambda xs: F.transform(xs, lambda x: x.cast("string"))) if nested else F.transform(array, lambda x: x.cast("string")))


def _checked(a: Column, b: Column, nested: bool, score: Column, kind: str) -> Column:
    """The score, or an error of the query if items aren't scalars or the two differ in type (void fits any type). The
    conditions are constants, which fold away."""
    kinds = F.typeof(a), F.typeof(b)
    deep = "^array<" + "array<" * nested + "(array|struct|map)<"
    same = (kinds[0] == kinds[1]) | kinds[0].contains("void") | kinds[1].contains("void")
    unlike = F.raise_error(F.concat(F.lit("lists must have the same element type: "), kinds[0], F.lit(", "), kinds[1])).cast(kind)
    odd = F.raise_error(F.concat(F.lit("list items must be scalars: "), kinds[0], F.lit(", "), kinds[1])).cast(kind)
    return F.when(kinds[0].rlike(deep) | kinds[1].rlike(deep), odd).when(same, score).otherwise(unlike)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once for each row."""
    return F.transform(F.array(value), body)[0]


def _pair(a: Column, b: Column, p: float) -> Column:
    # Both lists take the type that they have in common, which matters to a void one.
    both = F.struct(F.coalesce(a, b).alias("a"), F.coalesce(b, a).alias("b"))
    return _let(both, lambda s: _ratio(s["a"], s["b"], _total(s["a"], p) + _total(s["b"], p), p))


def list_similarity(list_a: Any, list_b: Any, p: float = 0.9) -> Column:
    """The similarity of two array columns, a double; null if either is null; 1.0 if neither has an item.

    Items must be scalars, and their types equal (a void array fits any); others are an error of analysis or of the query."""
    a, b = strict(list_a, _HINT), strict(list_b, _HINT)
    p = _decay(p)
    floats, texts = _comparable(a)
    score = F.when(floats, _pair(texts, _comparable(b)[1], p)).otherwise(_pair(a, b, p))
    return named(F.when(a.isNotNull() & b.isNotNull(), _checked(a, b, False, score, "double")), list_a)


def _weighed(lists: Column, p: float) -> Column:
    """Every inner list with its place and its total, which is made once and serves all pairs."""
    return F.transform(lists, lambda x, i: F.struct(x.alias("l"), i.alias("i"), _total(x, p).alias("t")))


def _mean(own: Column, others: Column, p: float) -> Column:
    """The mean similarity of a list to others, all of them structs as _weighed makes; null if there are none."""
    total = F.aggregate(others, F.lit(0.0), lambda acc, o: acc + _ratio(own["l"], o["l"], own["t"] + o["t"], p))
    return F.when(F.size(others) > 0, total / F.size(others))


def _mean_similarity(lists: Column, p: float) -> Column:
    return _let(F.filter(_weighed(lists, p), lambda x: x["l"].isNotNull()), lambda held: F.transform(lists, lambda x, i: F.when(x.isNotNull(), _others_mean(held, i, p))))


def _others_mean(held: Column, i: Column, p: float) -> Column:
    """The mean similarity of the list at place i to the others."""
    return _let(F.filter(held, lambda y: y["i"] == i)[0], lambda own: _mean(own, F.filter(held, lambda y: y["i"] != i), p))


def list_mean_similarity(lists: Any, p: float = 0.9) -> Column:
    """For every inner list its mean similarity to the other inner lists that aren't null: array<double>.

    A null inner list, or one without others, scores null; null gives null."""
    column = strict(lists, _HINT)
    p = _decay(p)
    floats, texts = _comparable(column, nested=True)
    score = F.when(floats, _let(texts, lambda x: _mean_similarity(x, p))).otherwise(_let(column, lambda x: _mean_similarity(x, p)))
    return named(F.when(column.isNotNull(), _checked(column, column, True, score, "array<double>")), lists)


def _mean_similarity_to(targets: Column, references: Column, p: float) -> Column:
    others = F.filter(_weighed(F.coalesce(references, F.slice(targets, 1, 0)), p), lambda y: y["l"].isNotNull())
    return _let(others, lambda held: F.transform(_weighed(F.coalesce(targets, references), p), lambda x: F.when(x["l"].isNotNull(), _mean(x, held, p))))


def list_mean_similarity_to(lists: Any, reference_lists: Any, p: float = 0.9) -> Column:
    """For every inner list its mean similarity to the reference lists that aren't null: array<double>.

    Null lists give null; null references, or none that isn't null, give a null for every list."""
    targets, references = strict(lists, _HINT), strict(reference_lists, _HINT)
    p = _decay(p)
    floats, texts = _comparable(targets, nested=True)
    score = F.when(floats, _mean_similarity_to(texts, _comparable(references, nested=True)[1], p)).otherwise(_mean_similarity_to(targets, references, p))
    return named(F.when(targets.isNotNull(), _checked(targets, references, True, score, "array<double>")), lists)


def _item_key(item: Any) -> Any:
    if not isinstance(item, _SCALARS):
        raise TypeError(f"list items must be scalars, got {type(item).__name__}")
    if isinstance(item, float):
        return ("nan",) if math.isnan(item) else (item, math.copysign(1, item))
    return item


def py_list_similarity(list_a: Sequence[Any], list_b: Sequence[Any], p: float = 0.9) -> float:
    """The similarity of two plain sequences. Items that aren't null must all have one Python type."""
    p = _decay(p)
    kinds = {type(x) for xs in (list_a, list_b) for x in xs if x is not None}
    if len(kinds) > 1:
        raise TypeError("lists must not mix item types: " + ", ".join(sorted(k.__name__ for k in kinds)))
    weights: list[dict] = [{}, {}]
    for own, xs in zip(weights, (list_a, list_b), strict=True):
        for i, x in enumerate(xs):
            if x is not None:
                own.setdefault(_item_key(x), p**i)
    items = dict.fromkeys([*weights[0], *weights[1]])
    both = [(weights[0].get(k, 0.0), weights[1].get(k, 0.0)) for k in items]
    most = sum(map(max, both))
    return sum(map(min, both)) / most if most else 1.0
