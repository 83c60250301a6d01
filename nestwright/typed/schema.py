"""Declarations of columns. One walk over a schema's fields serves storage, expressions and reading alike."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator, Mapping
from types import MappingProxyType
from typing import Any, Generic, TypeVar, get_args

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.typed import dtypes
from nestwright.typed.context import EMPTY, Context

V = TypeVar("V")


class Field(Generic[V]):
    """A declared field; `path` leads to it from the schema that it was reached from, itself last."""

    flat = False

    def __init__(self, spark_name: str | None = None) -> None:
        if spark_name is not None and (not isinstance(spark_name, str) or not spark_name):
            raise TypeError("spark_name must be a string that isn't empty")
        self.spark_name, self.name, self.owner, self.root = spark_name, "", None, None
        self.path: tuple[Field, ...] = (self,)

    @property
    def argument(self) -> Any:
        alias = getattr(self, "__orig_class__", None)
        if alias is None:
            raise TypeError(f"{type(self).__name__} needs a type: {type(self).__name__}[...]()")
        return get_args(alias)[0]

    def _declare(self, owner: type, name: str) -> None:
        self.owner = self.root = owner
        self.name, self.spark_name = name, self.spark_name or name
        self._check()

    def _check(self) -> None:
        pass

    def _under(self, parent: Field) -> Field:
        own = copy.copy(self)
        own.root, own.path = parent.root, (*parent.path, own)
        return own

    def expr(self) -> SparkColumn:
        """The column, or what is at this place in it; inside a list the values of its elements."""
        return _resolved(self.path, F.col, "", 0)


class _Dynamic(Field[V]):
    """Columns whose names' ends a context gives."""

    def __init__(self, spark_name: str | None = None, divider: str = "_") -> None:
        super().__init__(spark_name)
        self.divider = _divider(divider)

    def _check(self) -> None:
        self.dtype = dtypes.spark_type(self.argument)

    @property
    def context_path(self) -> tuple[Any, ...]:
        return (self.root, *(f.name for f in self.path))

    @property
    def declared_path(self) -> tuple[Any, ...]:
        return (self.owner, self.name)

    def expr(self) -> SparkColumn:
        raise TypeError(f"{type(self).__name__} is many columns; use key_expr(key)")

    def key_expr(self, key: str) -> SparkColumn:
        """The column of one key."""
        if not isinstance(key, str) or not key:
            raise TypeError("a key is a string that isn't empty")
        leaf = Column[self.argument](spark_name=self.spark_name + self.divider + key)
        return _resolved((*self.path[:-1], leaf), F.col, "", 0)


def _divider(divider: Any) -> str:
    if not isinstance(divider, str) or not divider:
        raise TypeError("divider must be a string that isn't empty")
    return divider


class Column(Field[V]):
    """A scalar, a list or a dict."""

    def __init__(self, spark_name: str | None = None, dtype: T.DataType | None = None) -> None:
        super().__init__(spark_name)
        if dtype is not None and not isinstance(dtype, T.DataType):
            raise TypeError("dtype must be a Spark DataType")
        self._dtype = dtype

    def _check(self) -> None:
        self.dtype = self._dtype or dtypes.spark_type(self.argument)


class FlatDict(_Dynamic[V]):
    """A dict as one column for each key that the context binds."""


class FlatTuple(_Dynamic[V]):
    """A tuple as one column for each name that the context binds, in their order."""


class _Nested(Field[V]):
    def _check(self) -> None:
        if not (isinstance(self.argument, type) and issubclass(self.argument, Schema)):
            raise TypeError(f"{type(self).__name__} needs a Schema class")

    @property
    def schema(self) -> type[Schema]:
        return self.argument


class _Children:
    def __init__(self, parent: _Nested):
        self._parent = parent

    def __getattr__(self, name: str) -> Any:
        try:
            return self._parent.schema.fields()[name]._under(self._parent)
        except KeyError:
            raise AttributeError(name) from None


class Struct(_Nested[V]):
    """A struct; its fields are at .fields."""

    @property
    def fields(self) -> Any:
        return _Children(self)


class ListStruct(_Nested[V]):
    """A list of structs; the fields of its elements are at .item."""

    @property
    def item(self) -> Any:
        return _Children(self)


class FlatStruct(Struct[V]):
    """A struct whose fields are columns beside it, with its name and the divider in front."""

    flat = True

    def __init__(self, spark_name: str | None = None, divider: str = "_") -> None:
        super().__init__(spark_name)
        self.divider = _divider(divider)


class FlatListStruct(ListStruct[V]):
    """A list of structs as columns of lists, one for each field and all of one length."""

    flat = True

    def __init__(self, spark_name: str | None = None, divider: str = "_") -> None:
        super().__init__(spark_name)
        self.divider = _divider(divider)


def _resolved(path: tuple[Field, ...], get: Callable[[str], SparkColumn], prefix: str, lists: int) -> SparkColumn:
    """`lists` counts the flat lists that the columns here are spread over."""
    field, rest = path[0], path[1:]
    if field.flat:
        if not rest:
            raise TypeError(f"{type(field).__name__} is many columns; use those of its fields")
        return _resolved(rest, get, prefix + field.spark_name + field.divider, lists + isinstance(field, FlatListStruct))
    value = get(prefix + field.spark_name)
    if not rest:
        return value

    def inside(v: SparkColumn, depth: int) -> SparkColumn:
        if depth:
            return F.transform(v, lambda e: inside(e, depth - 1))
        return _resolved(rest, lambda name: v.getField(name), "", 0)

    return inside(value, lists + isinstance(field, ListStruct))


class SchemaMeta(type):
    def __new__(mcs, name: str, bases: tuple[type, ...], body: dict[str, Any]) -> SchemaMeta:
        declared: dict[str, Field] = {}
        for base in reversed(bases):
            declared |= {k: copy.copy(f) for k, f in getattr(base, "_fields", {}).items()}
        own = {k: v for k, v in body.items() if isinstance(v, Field)}
        declared |= own
        cls = super().__new__(mcs, name, bases, {k: v for k, v in body.items() if k not in own})
        for key, field in declared.items():
            field.path = (field,)
            field._declare(cls, key)
            setattr(cls, key, field)
        names = [f.spark_name for f in declared.values()]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise TypeError(f"{name} has duplicate Spark names: {', '.join(twice)}")
        cls._fields = MappingProxyType(declared)
        return cls

    def __call__(cls, *args: Any, **options: Any) -> Any:
        raise TypeError(f"{cls.__name__} cannot be instantiated")


class Schema(metaclass=SchemaMeta):
    """Base of declarations: class Row(Schema): id = Column[int]()"""

    _fields: Mapping[str, Field] = MappingProxyType({})

    @classmethod
    def fields(cls) -> Mapping[str, Field]:
        return cls._fields

    @classmethod
    def spark_schema(cls, context: Context | None = None) -> T.StructType:
        """All columns, with those that the context binds."""
        return struct_of(cls._fields.values(), context or EMPTY, None)

    @classmethod
    def model_schema(cls, model: type, context: Context | None = None) -> T.StructType:
        """The columns that a model selects."""
        return _builder(cls, model).spark_schema(context)

    @classmethod
    def to_frame(cls, row: Any, *, context: Context | None = None, strict: bool = True, spark: SparkSession | None = None) -> DataFrame:
        """The record as a frame of one row."""
        return cls.to_frame_many(type(row), [row], context=context, strict=strict, spark=spark)

    @classmethod
    def to_frame_many(cls, model: type, rows: Iterable[Any], *, context: Context | None = None, strict: bool = True, spark: SparkSession | None = None) -> DataFrame:
        """The records as rows; `strict` has Spark check every value's type. No rows keep the whole schema."""
        plan = _builder(cls, model).physical_plan_for(context)
        data = [plan.row(r) for r in rows]
        return (spark or SparkSession.builder.getOrCreate()).createDataFrame(data, plan.schema, verifySchema=strict)

    @classmethod
    def from_frame(cls, model: type, frame: DataFrame, *, strict_schema: bool = False) -> Any:
        """The record of a frame of one row; others are a ValueError."""
        builder = _builder(cls, model)
        if strict_schema:
            cls.assert_frame_schema(model, frame)
        rows = frame.limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"expected exactly one row, got {'more' if rows else 'none'}")
        return builder.record(rows[0].asDict())

    @classmethod
    def iter_frame(cls, model: type, frame: DataFrame, *, strict_schema: bool = False) -> Iterator[Any]:
        """The records of the rows, a partition at a time."""
        builder = _builder(cls, model)
        if strict_schema:
            cls.assert_frame_schema(model, frame)
        return (builder.record(r.asDict()) for r in frame.toLocalIterator())

    @classmethod
    def assert_frame_schema(cls, model: type, frame: DataFrame) -> None:
        """A TypeError unless the frame has the model's columns and no others, with the keys that its names show."""
        builder = _builder(cls, model)
        expected = builder.spark_schema(builder.context_of(frame.schema))
        if plain(expected) != plain(frame.schema):
            raise TypeError(f"frame schema doesn't match: expected {expected.simpleString()}, got {frame.schema.simpleString()}")

    @classmethod
    def to_dict(cls, row: Any, *, by_spark_name: bool = False, context: Context | None = None) -> dict[str, Any]:
        builder = _builder(cls, type(row))
        return builder.physical_dict(row, context) if by_spark_name else builder.plain_dict(row)

    @classmethod
    def from_dict(cls, model: type, values: Mapping[str, Any], *, by_spark_name: bool = False) -> Any:
        builder = _builder(cls, model)
        return builder.record(values, strict=True) if by_spark_name else builder.from_plain(values)


def _builder(schema: type[Schema], model: type) -> Any:
    from nestwright.typed.build import get_builder

    return get_builder(model, schema)


def plain(kind: T.DataType) -> Any:
    """A type without nullability and metadata, for comparison."""
    if isinstance(kind, T.StructType):
        return tuple((f.name, plain(f.dataType)) for f in kind)
    if isinstance(kind, T.ArrayType):
        return ("array", plain(kind.elementType))
    return kind


def struct_of(fields: Iterable[Field], context: Context, below: Callable[[Field], Iterable[Field]] | None) -> T.StructType:
    """The columns of fields; `below` picks those of a nested field, else all are taken."""
    out: dict[str, T.StructField] = {}

    def add(name: str, kind: T.DataType, lists: int, extra: dict[str, str]) -> None:
        for _ in range(lists):
            kind = T.ArrayType(kind)
        if name in out:
            raise TypeError(f"conflicting physical field {name!r}")
        out[name] = T.StructField(name, kind, True, extra)

    def walk(own: Iterable[Field], prefix: str, lists: int) -> None:
        for field in own:
            if isinstance(field, _Dynamic):
                for key in context.keys_of(field):
                    add(prefix + field.spark_name + field.divider + key, field.dtype, lists, {})
                continue
            if not isinstance(field, _Nested):
                add(prefix + field.spark_name, field.dtype, lists, dtypes.metadata(field.argument))
                continue
            children = below(field) if below else [f._under(field) for f in field.schema.fields().values()]
            if field.flat:
                walk(children, prefix + field.spark_name + field.divider, lists + isinstance(field, FlatListStruct))
            else:
                inner = struct_of(children, context, below)
                add(prefix + field.spark_name, T.ArrayType(inner) if isinstance(field, ListStruct) else inner, lists, {})

    walk(fields, "", 0)
    return T.StructType(list(out.values()))
