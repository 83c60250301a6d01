"""The functions as methods of Column, for those who want them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column

from nestwright.functions import jsons, lists, similarity

#: Methods by namespace.
METHODS = {
    "list": {
        "zip": lists.list_zip,
        "combinations": lists.list_combinations,
        "combinations_to": lists.list_combinations_to,
        "similarity": similarity.list_similarity,
        "mean_similarity": similarity.list_mean_similarity,
        "mean_similarity_to": similarity.list_mean_similarity_to,
    },
    "str": {"json_object_items": jsons.json_object_items, "json_array_values": jsons.json_array_values},
}


class Namespace:
    """column.list or column.str: the functions with the column as their first argument."""

    def __init__(self, functions: dict[str, Any]):
        self._functions = functions

    def __get__(self, column: Column | None, owner: type) -> Any:
        return self if column is None else _Bound(column, self._functions)


class _Bound:
    def __init__(self, column: Column, functions: dict[str, Any]):
        self._column, self._functions = column, functions

    def __getattr__(self, name: str) -> Any:
        try:
            function = self._functions[name]
        except KeyError:
            raise AttributeError(name) from None
        return lambda *args, **options: function(self._column, *args, **options)


def _owners() -> list[type]:
    """Column and the classes that stand in for it."""
    from pyspark.sql.classic.column import Column as Classic

    return [Column, Classic]


def install(*, overwrite: bool = False) -> list[str]:
    """Adds the namespaces `list` and `str` to Column; returns those added. What is there already stays unless
    `overwrite`. Columns give fields by attribute; a field called `list` or `str` must then be asked for by brackets."""
    if not isinstance(overwrite, bool):
        raise TypeError("overwrite must be a bool")
    added = []
    for name, functions in METHODS.items():
        for owner in _owners():
            if overwrite or name not in vars(owner):
                setattr(owner, name, Namespace(functions))
                added.append(name)
    return sorted(set(added))
