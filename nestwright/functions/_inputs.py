"""How arguments become columns, and checks of options."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def loose(value: Any) -> Column:
    """A column as it is, a string as a column's name, anything else as a literal."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def strict(value: Any, hint: str) -> Column:
    """A column or its name; anything else is a TypeError that ends with the hint."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    raise TypeError(f"expected a Column or a column's name, got {type(value).__name__}; {hint}")


def flag(name: str, value: Any) -> bool:
    if not isinstance(value, bool):
        raise TypeError(f"{name} must be a bool")
    return value


def named(out: Column, first: Any) -> Column:
    """Called as the first input, where that was given by name."""
    return out.alias(first.rpartition(".")[2]) if isinstance(first, str) else out
