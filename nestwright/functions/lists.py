"""Zipping and pairing the elements of arrays."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestwright.functions._inputs import flag, loose, named


def _checked_names(names: Any, count: int) -> list[str]:
    if isinstance(names, str):
        raise TypeError("fields must be a sequence of names, not a single string")
    names = list(names)
    if len(names) != count:
        raise ValueError(f"fields must have exactly {count} names")
    if not all(isinstance(n, str) for n in names):
        raise TypeError("field names must be strings")
    if len(set(names)) != len(names):
        raise ValueError("field names must be unique")
    return names


def _name_of(expr: Any) -> str | None:
    """The name that a list goes by, where it says one: its own, a column's or an alias."""
    if isinstance(expr, str):
        return expr.rpartition(".")[2]
    said = re.fullmatch(r"Column<'(?:.* AS )?([\w.`]+)'>", repr(expr)) if isinstance(expr, Column) else None
    return said and said[1].strip("`").rpartition(".")[2]


def list_zip(*exprs: Any, pad: bool = False, fields: Any = None) -> Column:
    """Arrays to one array of structs: as long as the shortest, or padded with nulls to the longest.

    A null array gives null; null elements are values like others. Without `fields` the inputs' names are the fields'
    names, which must differ; columns that are made of others should be given `fields`, since Spark names them only later."""
    flag("pad", pad)
    if len(exprs) < 2:
        raise ValueError("list_zip needs at least two lists")
    columns = [loose(e) for e in exprs]
    if fields is None:
        known = [name for e in exprs if (name := _name_of(e)) is not None]
        if len(set(known)) != len(known):
            raise ValueError("field names must be unique; give fields")
        zipped = F.arrays_zip(*columns)
    else:
        zipped = F.arrays_zip(*(c.alias(n) for c, n in zip(columns, _checked_names(fields, len(columns)), strict=True)))
    if not pad:
        zipped = F.slice(zipped, 1, F.least(*map(F.size, columns)))
        zipped = F.when(_all_there(columns), zipped)
    return named(zipped, exprs[0])


def _all_there(columns: list[Column]) -> Column:
    there = columns[0].isNotNull()
    for c in columns[1:]:
        there = there & c.isNotNull()
    return there


def _pair_names(left_value: str, right_value: str, with_index: bool, left_index: str | None, right_index: str | None) -> tuple[list[str], bool]:
    flag("with_index", with_index)
    indexed = with_index or left_index is not None or right_index is not None
    names = [("left_index" if left_index is None else left_index), ("right_index" if right_index is None else right_index)] * indexed + [left_value, right_value]
    if not all(isinstance(n, str) for n in names):
        raise TypeError("field names must be strings")
    if len(set(names)) != len(names):
        raise ValueError("field names must be unique")
    return names, indexed


def _pairs(outer: Column, inner_of, names: list[str], indexed: bool, skip_null: bool) -> Column:
    """inner_of(i) is (the array that element i is paired with, the place of its first element)."""

    def each(x: Column, i: Column) -> Column:
        inner, start = inner_of(i)
        return F.transform(inner, lambda y, j: F.struct(*(v.alias(n) for v, n in zip([i.cast("int"), (start + j).cast("int")] * indexed + [x, y], names, strict=True))))

    out = F.flatten(F.transform(outer, each))
    if skip_null:
        left, right = names[-2:]
        out = F.filter(out, lambda p: p[left].isNotNull() & p[right].isNotNull())
    return out


def list_combinations(
    expr: Any, *, left_value: str = "left_value", right_value: str = "right_value", with_index: bool = False, left_index: str | None = None, right_index: str | None = None, skip_null: bool = False, skip_self: bool = False
) -> Column:
    """All pairs (i, j) of an array's elements with i <= j, or i < j with `skip_self`, in order of i, then j.

    Places are those in the array, also where `skip_null` leaves pairs with a null element out. Null gives null."""
    flag("skip_null", skip_null), flag("skip_self", skip_self)
    names, indexed = _pair_names(left_value, right_value, with_index, left_index, right_index)
    array, shift = loose(expr), int(skip_self)
    rest = lambda i: (F.slice(array, i + 1 + shift, F.size(array)), i + shift)
    return named(_pairs(array, rest, names, indexed, skip_null), expr)


def list_combinations_to(
    expr: Any, target: Any, *, left_value: str = "left_value", right_value: str = "right_value", with_index: bool = False, left_index: str | None = None, right_index: str | None = None, skip_null: bool = False
) -> Column:
    """All pairs of an element of one array with an element of another, in order of the left, then the right place.
    Null on either side gives null."""
    flag("skip_null", skip_null)
    names, indexed = _pair_names(left_value, right_value, with_index, left_index, right_index)
    left, right = loose(expr), loose(target)
    return named(F.when(left.isNotNull() & right.isNotNull(), _pairs(left, lambda i: (right, F.lit(0)), names, indexed, skip_null)), expr)
