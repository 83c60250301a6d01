"""Models: record classes bound to a schema, and the plans by which their records become rows and back."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from nestwright.typed import dtypes
from nestwright.typed.context import EMPTY, Context
from nestwright.typed.schema import FlatDict, FlatListStruct, FlatTuple, Field, ListStruct, Schema, _Dynamic, _Nested, struct_of

_BUILDER = "__typed_builder__"
_NOTHING = object()


def is_record(cls: Any) -> bool:
    """A dataclass, or a NamedTuple with types."""
    return isinstance(cls, type) and (dataclasses.is_dataclass(cls) or issubclass(cls, tuple) and hasattr(cls, "_fields") and bool(cls.__dict__.get("__annotations__") or getattr(cls, "__annotations__", None)))


def _hints(cls: type) -> dict[str, Any]:
    return get_type_hints(cls, include_extras=True, localns={cls.__name__: cls})


def _fields_of(cls: type) -> dict[str, tuple[Any, Callable[[], Any] | None]]:
    """(annotation, maker of the default or None) by field."""
    if dataclasses.is_dataclass(cls):
        try:
            hints = _hints(cls)
        except NameError:
            hints = {}
        out = {}
        for f in dataclasses.fields(cls):
            made = f.default_factory if f.default_factory is not dataclasses.MISSING else (lambda d=f.default: d) if f.default is not dataclasses.MISSING else None
            out[f.name] = (hints.get(f.name, f.type), made)
        return out
    hints, defaults = _hints(cls), cls._field_defaults
    return {n: (hints[n], (lambda d=defaults[n]: d) if n in defaults else None) for n in cls._fields}


@dataclasses.dataclass(frozen=True)
class _Part:
    """A field that model and schema share."""

    field: Field
    write: Callable[[Any], Any]
    read: Callable[[Any], Any]
    sub: Builder | None = None


@dataclasses.dataclass(frozen=True)
class PhysicalPlan:
    schema: T.StructType
    row: Callable[[Any], tuple]


class Builder:
    """A model's fields matched with a schema's, checked once; plans are kept by the context's bindings."""

    def __init__(self, schema: type[Schema], model: type, strict: bool = False, parent: Field | None = None) -> None:
        if not (isinstance(schema, type) and issubclass(schema, Schema)):
            raise TypeError("schema must be a Schema class")
        if not is_record(model):
            raise TypeError(f"{getattr(model, '__name__', model)!s} must be a dataclass or a typed NamedTuple")
        self.schema, self.model, self.strict = schema, model, strict
        self.defaults: dict[str, Callable[[], Any] | None] = {}
        self.parts: dict[str, _Part] = {}
        self._plans: dict[Any, PhysicalPlan] = {}
        declared = schema.fields()
        for name, (annotation, made) in _fields_of(model).items():
            self.defaults[name] = made
            if name not in declared:
                if made is None or strict:
                    raise TypeError(f"{model.__name__}.{name} is not declared in {schema.__name__}")
                continue
            field = declared[name] if parent is None else declared[name]._under(parent)
            self.parts[name] = self._part(name, field, annotation)
        if strict and (missing := [n for n in declared if n not in self.defaults]):
            raise TypeError(f"{model.__name__} lacks fields of {schema.__name__}: {', '.join(missing)}")

    def _part(self, name: str, field: Field, annotation: Any) -> _Part:
        kind, _ = dtypes.opened(annotation)
        args = get_args(kind)
        said = f"{self.model.__name__}.{name}"
        if isinstance(field, _Nested):
            if isinstance(field, ListStruct):
                kind = dtypes.opened(args[0])[0] if get_origin(kind) is list and args else None
            if not (isinstance(kind, type) and (dataclasses.is_dataclass(kind) or issubclass(kind, tuple) and hasattr(kind, "_fields"))):
                raise TypeError(f"{said} does not match its schema structure")
            return _Part(field, lambda v: v, lambda v: v, Builder(field.schema, kind, self.strict, field))
        expected: Any = dtypes.bare(field.argument)
        if isinstance(field, FlatDict):
            expected = (dict, str, expected)
        elif isinstance(field, FlatTuple):
            expected = (tuple, expected, Ellipsis)
        if dtypes.bare(annotation) != expected:
            raise TypeError(f"{said} uses Python type {annotation!r}, its schema another: {field.argument!r}")
        return _Part(field, dtypes.writer(field.argument, field.dtype), dtypes.reader(field.argument))

    @classmethod
    def for_model(cls, model: type, *, schema: type[Schema]) -> Builder:
        return get_builder(model, schema)

    def to_frame(self, row: Any, *, context: Context | None = None, strict: bool = True, spark: SparkSession | None = None) -> DataFrame:
        """A record of this model as a frame of one row."""
        return self.to_frame_many([row], context=context, strict=strict, spark=spark)

    def to_frame_many(self, rows: Iterable[Any], *, context: Context | None = None, strict: bool = True, spark: SparkSession | None = None) -> DataFrame:
        return self.schema.to_frame_many(self.model, rows, context=context, strict=strict, spark=spark)

    def from_frame(self, frame: DataFrame, *, strict_schema: bool = False) -> Any:
        return self.schema.from_frame(self.model, frame, strict_schema=strict_schema)

    def iter_frame(self, frame: DataFrame, *, strict_schema: bool = False) -> Iterator[Any]:
        return self.schema.iter_frame(self.model, frame, strict_schema=strict_schema)

    def _below(self, field: Field) -> list[Field]:
        """The fields under a nested one that its own model selects."""
        builder: Builder = self
        for step in field.path:
            builder = builder.parts[step.name].sub
        return [p.field for p in builder._ordered()]

    def _ordered(self) -> list[_Part]:
        """Parts in the schema's order."""
        return [self.parts[n] for n in self.schema.fields() if n in self.parts]

    def spark_schema(self, context: Context | None = None) -> T.StructType:
        return self.physical_plan_for(context).schema

    def physical_plan_for(self, context: Context | None = None) -> PhysicalPlan:
        """The plan for what the context binds now; the same object as long as that stays the same."""
        context = context or EMPTY
        key = context.signature
        if key not in self._plans:
            schema = struct_of([p.field for p in self._ordered()], context, self._below)
            writers = self._writers(context)
            self._plans[key] = PhysicalPlan(schema, lambda record: (self._check(record), tuple(w(record) for w in writers)[: len(schema)])[1])
        return self._plans[key]

    def _check(self, record: Any) -> None:
        if type(record) is not self.model:
            raise TypeError(f"expected {self.model.__name__}, got {type(record).__name__}")

    def _writers(self, context: Context) -> list[Callable[[Any], Any]]:
        """For each column what it is of a record, which may be None under a flat struct."""
        return [w for name, w in sorted(self._columns(context), key=lambda c: c[0] is None)]

    def _columns(self, context: Context) -> list[tuple[str | None, Callable[[Any], Any]]]:
        out: list[tuple[str | None, Callable[[Any], Any]]] = []
        for part in self._ordered():
            field, name, sub = part.field, part.field.name, part.sub
            value = lambda r, n=name: None if r is None else getattr(r, n)
            if isinstance(field, _Dynamic):
                out += self._dynamic(part, value, context.keys_of(field))
            elif sub is None:
                out.append((field.spark_name, lambda r, v=value, w=part.write: w(v(r))))
            elif not field.flat:
                own, width = sub._writers(context), sum(name is not None for name, _ in sub._columns(context))
                one = lambda v, o=own, s=sub, n=width: None if v is None else (s._check(v), tuple(w(v) for w in o)[:n])[1]
                if isinstance(field, ListStruct):
                    out.append((field.spark_name, lambda r, v=value, one=one: None if v(r) is None else [one(x) for x in v(r)]))
                else:
                    out.append((field.spark_name, lambda r, v=value, one=one: one(v(r))))
            else:
                for child, write in sub._columns(context):
                    full = child and field.spark_name + field.divider + child
                    if isinstance(field, FlatListStruct):
                        out.append((full, lambda r, v=value, w=write, s=sub: None if v(r) is None else [(s._check(x), w(x))[1] for x in v(r)]))
                    else:
                        out.append((full, lambda r, v=value, w=write, s=sub: w(None) if v(r) is None else (s._check(v(r)), w(v(r)))[1]))
        return out

    def _dynamic(self, part: _Part, value: Callable[[Any], Any], keys: tuple[str, ...]) -> list[tuple[str | None, Callable[[Any], Any]]]:
        field, start = part.field, part.field.spark_name + part.field.divider
        label = f"{self.model.__name__}.{field.name}"

        def entries(record: Any) -> Any:
            own = value(record)
            if own is None:
                return {}
            if isinstance(field, FlatDict):
                if not isinstance(own, Mapping):
                    raise TypeError(f"{label} must be a dict")
                for key in own:
                    if key not in keys:
                        raise TypeError(f"{label} has the unbound key {key!r}")
                return own
            if not isinstance(own, tuple) or len(own) != len(keys):
                raise TypeError(f"{label} must be a tuple of length {len(keys)}")
            return dict(zip(keys, own, strict=True))

        # Without keys there is no column, but values that no key takes must be found: a writer without a name, last.
        return [(start + key, lambda r, k=key: part.write(entries(r).get(k))) for key in keys] or [(None, entries)]

    # Reading.

    def _claimed(self) -> set[str]:
        """The names of columns that the schema gives to fields for certain, at this level."""
        out: set[str] = set()

        def walk(fields: Any, prefix: str) -> None:
            for field in fields:
                if isinstance(field, _Nested) and field.flat:
                    walk(field.schema.fields().values(), prefix + field.spark_name + field.divider)
                elif not isinstance(field, _Dynamic):
                    out.add(prefix + field.spark_name)

        walk(self.schema.fields().values(), "")
        return out

    def _prefixes(self) -> list[str]:
        """The beginnings of the names of columns that contexts add, at this level, longest first."""
        out: list[str] = []

        def walk(fields: Any, prefix: str) -> None:
            for field in fields:
                if isinstance(field, _Dynamic):
                    out.append(prefix + field.spark_name + field.divider)
                elif isinstance(field, _Nested) and field.flat:
                    walk(field.schema.fields().values(), prefix + field.spark_name + field.divider)

        walk(self.schema.fields().values(), "")
        return sorted(out, key=len, reverse=True)

    def _keys_in(self, names: list[str]) -> dict[str, list[str]]:
        """Keys by the beginning of their columns' names: a column belongs to the longest that fits, unless declared."""
        claimed, prefixes, out = self._claimed(), self._prefixes(), {}
        for name in names:
            if name not in claimed:
                fits = next((p for p in prefixes if name.startswith(p) and len(name) > len(p)), None)
                if fits is not None:
                    out.setdefault(fits, []).append(name[len(fits) :])
        return out

    def record(self, values: Mapping[str, Any], strict: bool = False) -> Any:
        """A record of a row's columns; with `strict` others than the schema's are a TypeError."""
        keys = self._keys_in(list(values))
        if strict:
            known = self._claimed() | {p + k for p, ks in keys.items() for k in ks}
            if unknown := [n for n in values if n not in known]:
                raise TypeError(f"unknown columns: {', '.join(map(repr, unknown))}")
        return self._made(values, "", keys, strict)

    def _made(self, values: Mapping[str, Any], prefix: str, keys: dict[str, list[str]], strict: bool) -> Any:
        out: dict[str, Any] = {}
        for name, part in self.parts.items():
            found = self._value(part, values, prefix, keys, strict)
            if found is _NOTHING:
                if self.defaults[name] is None:
                    raise TypeError(f"column {prefix + part.field.spark_name!r} is missing")
                continue
            out[name] = found
        return self.model(**out)

    def _value(self, part: _Part, values: Mapping[str, Any], prefix: str, keys: dict[str, list[str]], strict: bool) -> Any:
        field, sub = part.field, part.sub
        full = prefix + field.spark_name
        if isinstance(field, _Dynamic):
            own = keys.get(full + field.divider, [])
            read = [(k, values[full + field.divider + k]) for k in own]
            if isinstance(field, FlatTuple):
                return tuple(part.read(v) for _, v in read)
            return {k: part.read(v) for k, v in read if v is not None}
        if sub is None:
            return part.read(values[full]) if full in values else _NOTHING
        if not field.flat:
            if full not in values:
                return _NOTHING
            one = lambda v: None if v is None else sub.record(v.asDict() if hasattr(v, "asDict") else v, strict)
            value = values[full]
            return None if value is None else [one(v) for v in value] if isinstance(field, ListStruct) else one(value)
        start = full + field.divider
        own = {n: v for n, v in values.items() if n.startswith(start) and (n in self._flat_names(sub, start) or any(start + p[len(start) :] in keys for p in keys if n.startswith(p)))}
        if not own:
            return _NOTHING
        if all(v is None for v in own.values()):
            return None
        if not isinstance(field, FlatListStruct):
            return sub._made(values, start, keys, strict)
        lengths = {None if v is None else len(v) for v in own.values()}
        if len(lengths) != 1:
            raise TypeError(f"the lists of {full!r} differ in length")
        return [sub._made({n: v[i] for n, v in own.items()}, start, keys, strict) for i in range(lengths.pop())]

    def _flat_names(self, sub: Builder, start: str) -> set[str]:
        return {start + n for n in sub._claimed()}

    def context_of(self, schema: T.StructType) -> Context:
        """The bindings that a frame's columns show."""
        context = Context()

        def look(builder: Builder, kind: T.StructType, prefix: str, keys: dict[str, list[str]] | None) -> None:
            keys = builder._keys_in(kind.names) if keys is None else keys
            for part in builder._ordered():
                field, full = part.field, prefix + part.field.spark_name
                if isinstance(field, _Dynamic):
                    context.bind(field, keys.get(full + field.divider, []))
                elif part.sub is not None and field.flat:
                    look(part.sub, kind, full + field.divider, keys)
                elif part.sub is not None and full in kind.names:
                    inner = kind[full].dataType
                    while isinstance(inner, T.ArrayType):
                        inner = inner.elementType
                    if isinstance(inner, T.StructType):
                        look(part.sub, inner, "", None)

        look(self, schema, "", None)
        return context

    # Dictionaries.

    def physical_dict(self, record: Any, context: Context | None) -> dict[str, Any]:
        plan = self.physical_plan_for(context)

        def named(kind: T.DataType, value: Any, annotation: Any = None) -> Any:
            if value is None:
                return None
            if isinstance(kind, T.StructType):
                return {f.name: named(f.dataType, v) for f, v in zip(kind, value, strict=True)}
            if isinstance(kind, T.ArrayType):
                return [named(kind.elementType, v) for v in value]
            return value

        return {f.name: named(f.dataType, v) for f, v in zip(plan.schema, plan.row(record), strict=True)}

    def plain_dict(self, record: Any) -> dict[str, Any]:
        self._check(record)
        out: dict[str, Any] = {}
        for name, part in self.parts.items():
            value = getattr(record, name)
            if part.sub is not None and value is not None:
                value = [None if v is None else part.sub.plain_dict(v) for v in value] if isinstance(part.field, ListStruct) else part.sub.plain_dict(value)
            out[name] = value
        return out

    def from_plain(self, values: Mapping[str, Any]) -> Any:
        if unknown := [n for n in values if n not in self.parts]:
            raise TypeError(f"unknown fields: {', '.join(map(repr, unknown))}")
        out: dict[str, Any] = {}
        for name, value in values.items():
            part = self.parts[name]
            if part.sub is not None and value is not None:
                value = [None if v is None else part.sub.from_plain(v) for v in value] if isinstance(part.field, ListStruct) else part.sub.from_plain(value)
            out[name] = value
        if missing := [n for n in self.parts if n not in out and self.defaults[n] is None]:
            raise TypeError(f"missing fields: {', '.join(map(repr, missing))}")
        return self.model(**out)


def get_builder(model: type, schema: type[Schema]) -> Builder:
    """The builder that @model made for this very schema."""
    builder = vars(model).get(_BUILDER) if isinstance(model, type) else None
    if builder is None:
        raise TypeError(f"{getattr(model, '__name__', model)!s} has no builder; decorate it with @model")
    if builder.schema is not schema:
        raise TypeError(f"{model.__name__} belongs to {builder.schema.__name__}, not to {schema.__name__}")
    return builder


def model(*, schema: type[Schema], strict: bool = False) -> Callable[[type], type]:
    """Binds a class to a schema. A class that is neither a dataclass nor a NamedTuple becomes a dataclass with slots.
    With `strict` the two must have the same fields, at every level."""
    if not (isinstance(schema, type) and issubclass(schema, Schema)):
        raise TypeError("schema must be a Schema class")
    if not isinstance(strict, bool):
        raise TypeError("strict must be a bool")

    def bind(cls: type) -> type:
        named_tuple = isinstance(cls, type) and issubclass(cls, tuple)
        own = cls if named_tuple or "__dataclass_fields__" in vars(cls) else dataclasses.dataclass(slots=True)(cls)
        setattr(own, _BUILDER, Builder(schema, own, strict))
        return own

    return bind
