import dataclasses
import datetime as dt
from typing import NamedTuple

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright import typed as tp


class Place(tp.Schema):
    city = tp.Column[str]()
    code = tp.Column[str](spark_name="countryCode")


class Where(tp.Schema):
    source = tp.Column[str]()
    place = tp.Struct[Place]()


class Event(tp.Schema):
    name = tp.Column[str]()
    score = tp.Column[tp.F32]()
    where = tp.Struct[Where]()


class Row(tp.Schema):
    request = tp.Column[str](spark_name="requestId")
    where = tp.Struct[Where]()
    events = tp.ListStruct[Event]()
    tags = tp.Column[list[str]]()
    flat = tp.FlatStruct[Where](divider="__")
    many = tp.FlatListStruct[Event]()


PLACE = "struct<city:string,countryCode:string>"
WHERE = f"struct<source:string,place:{PLACE}>"
EVENT = f"struct<name:string,score:float,where:{WHERE}>"


@dataclasses.dataclass
class PlaceM:
    city: str
    code: str


@dataclasses.dataclass
class WhereM:
    source: str
    place: PlaceM


class EventM(NamedTuple):
    name: str
    score: float
    where: WhereM | None


@tp.model(schema=Row)
class RowM:
    request: str
    where: WhereM | None
    events: list[EventM]
    tags: list[str] | None = None
    flat: WhereM | None = None
    many: list[EventM] | None = None
    own: int = 7


def record(name="one", flat=True):
    at = WhereM("web", PlaceM("Berlin", "DE"))
    return RowM(name, at, [EventM("open", 0.75, at), EventM("shut", 0.5, None)], ["t"], at if flat else None, [EventM("m", 0.25, at)] if flat else None)


def test_schema_and_round_trip(spark):
    assert Row.spark_schema().simpleString() == f"struct<requestId:string,where:{WHERE},events:array<{EVENT}>,tags:array<string>,flat__source:string,flat__place:{PLACE},many_name:array<string>,many_score:array<float>,many_where:array<{WHERE}>>"
    rows = [record(), record("two", flat=False)]
    frame = Row.to_frame_many(RowM, rows, spark=spark)
    assert frame.schema.simpleString() == Row.spark_schema().simpleString()
    assert sorted(Row.iter_frame(RowM, frame, strict_schema=True), key=lambda r: r.request) == rows
    assert Row.from_frame(RowM, frame.where("requestId = 'two'")) == rows[1]
    with pytest.raises(ValueError, match="exactly one row"):
        Row.from_frame(RowM, frame)
    with pytest.raises(TypeError, match="schema doesn't match"):
        Row.from_frame(RowM, frame.drop("tags").limit(1), strict_schema=True)
    assert Row.to_frame_many(RowM, [], spark=spark).schema == Row.to_frame_many(RowM, rows, spark=spark).schema


def test_paths(spark):
    frame = Row.to_frame(record(), spark=spark)
    out = frame.select(
        Row.request.expr(), Row.where.fields.place.fields.city.expr().alias("city"), Row.events.item.score.expr().alias("scores"), Row.events.item.where.fields.place.fields.code.expr().alias("codes"),
        Row.flat.fields.place.fields.code.expr().alias("flat"), Row.many.item.where.fields.place.fields.city.expr().alias("many"),
    ).first()
    assert tuple(out) == ("one", "Berlin", [0.75, 0.5], ["DE", None], "DE", ["Berlin"])
    with pytest.raises(TypeError, match="many columns"):
        Row.flat.expr()


def test_dicts():
    row = record()
    assert Row.from_dict(RowM, Row.to_dict(row)) == row
    physical = Row.to_dict(row, by_spark_name=True)
    assert physical["where"]["place"]["countryCode"] == "DE" and physical["many_name"] == ["m"] and "own" not in physical
    assert Row.from_dict(RowM, physical, by_spark_name=True) == row
    with pytest.raises(TypeError, match="unknown"):
        Row.from_dict(RowM, {"nothing": 1})
    with pytest.raises(TypeError, match="unknown"):
        Row.from_dict(RowM, physical | {"nothing": 1}, by_spark_name=True)


class Dynamic(tp.Schema):
    key = tp.Column[int](spark_name="rowId")
    metrics = tp.FlatDict[float]()
    metrics_total = tp.Column[int]()
    scores = tp.FlatTuple[tp.F32](divider="__")


@tp.model(schema=Dynamic)
class DynamicM:
    key: int
    metrics: dict[str, float] = dataclasses.field(default_factory=dict)
    metrics_total: int = 0
    scores: tuple[float, ...] = ()


def test_dynamic_columns(spark):
    context = tp.Context().bind(Dynamic.metrics, ["views", "rate"]).bind(Dynamic.scores, ["p", "r"])
    rows = [DynamicM(1, {"views": 10.0}, 4, (0.75, 0.5)), DynamicM(2, {"rate": 0.25}, 5, (0.5, 0.25))]
    frame = Dynamic.to_frame_many(DynamicM, rows, context=context, spark=spark)
    assert frame.columns == ["rowId", "metrics_views", "metrics_rate", "metrics_total", "scores__p", "scores__r"]
    assert frame.schema == Dynamic.spark_schema(context) == Dynamic.model_schema(DynamicM, context)
    assert sorted(Dynamic.iter_frame(DynamicM, frame, strict_schema=True), key=lambda r: r.key) == rows
    assert frame.select(Dynamic.metrics.key_expr("rate").alias("x")).collect()[0].x in (None, 0.25)
    for bad, message in ((DynamicM(1, {"x": 1.0}, 0, (0.0, 0.0)), "unbound key 'x'"), (DynamicM(1, {}, 0, (0.0,)), "length 2")):
        with pytest.raises(TypeError, match=message):
            Dynamic.to_frame(bad, context=context, spark=spark)
    with pytest.raises(TypeError, match="unbound key"):
        Dynamic.to_frame(rows[0], spark=spark)
    assert Dynamic.to_frame(DynamicM(3), spark=spark).columns == ["rowId", "metrics_total"]
    assert Dynamic.to_dict(rows[0], by_spark_name=True, context=context)["metrics_rate"] is None
    with pytest.raises(TypeError):
        Dynamic.metrics.expr()
    builder = tp.Builder.for_model(DynamicM, schema=Dynamic)
    plan = builder.physical_plan_for(context)
    assert builder.physical_plan_for(context) is plan
    assert builder.physical_plan_for(context.bind(Dynamic.metrics, ["a"])) is not plan
    with pytest.raises(TypeError, match="conflicting physical field"):
        Dynamic.spark_schema(tp.Context().bind(Dynamic.metrics, ["total"]))


def test_paths_bind_by_themselves(spark):
    class Values(tp.Schema):
        values = tp.FlatDict[int]()

    class Pair(tp.Schema):
        left = tp.Struct[Values]()
        right = tp.FlatStruct[Values](divider="-")

    @dataclasses.dataclass
    class ValuesM:
        values: dict[str, int] = dataclasses.field(default_factory=dict)

    @tp.model(schema=Pair)
    class PairM:
        left: ValuesM
        right: ValuesM

    row = PairM(ValuesM({"a": 1}), ValuesM({"b": 2}))
    context = tp.Context().bind(Pair.left.fields.values, ["a"]).bind(Pair.right.fields.values, ["b"])
    frame = Pair.to_frame(row, context=context, spark=spark)
    assert frame.schema.simpleString() == "struct<left:struct<values_a:bigint>,right-values_b:bigint>"
    assert Pair.from_frame(PairM, frame, strict_schema=True) == row
    shared = tp.Context().bind(Values.values, ["a", "b"])
    assert Pair.spark_schema(shared).simpleString() == "struct<left:struct<values_a:bigint,values_b:bigint>,right-values_a:bigint,right-values_b:bigint>"


def test_all_types(spark):
    class Wide(tp.Schema):
        a = tp.Column[tp.U64]()
        b = tp.Column[tp.U8]()
        c = tp.Column[dict[str, float]]()
        d = tp.Column[tp.TimestampMs]()
        e = tp.Column[dt.timedelta]()
        f = tp.Column[bytes]()
        g = tp.Column[dt.date | None]()
        h = tp.Column[int](dtype=T.IntegerType())
        i = tp.Column[list[tp.F64]]()

    @tp.model(schema=Wide, strict=True)
    class WideM(NamedTuple):
        a: int
        b: int
        c: dict[str, float]
        d: dt.datetime
        e: dt.timedelta
        f: bytes
        g: dt.date | None
        h: int
        i: list[float]

    row = WideM(2**64 - 1, 255, {"x": 1.0, "y": 2.0}, dt.datetime(2020, 1, 2, 3, 4, 5, 678000), dt.timedelta(days=1, microseconds=5), b"\x00", None, 3, [1.0, None])
    frame = Wide.to_frame(row, spark=spark)
    assert frame.schema["a"].dataType == T.DecimalType(20, 0) and frame.schema["c"].dataType.simpleString() == "array<struct<key:string,value:double>>"
    assert Wide.from_frame(WideM, frame) == row
    with pytest.raises(ValueError):
        Wide.to_frame(row._replace(b=256), spark=spark)


def test_declarations_are_checked():
    with pytest.raises(TypeError, match="Cannot infer"):
        type("Bad", (tp.Schema,), {"x": tp.Column[complex]()})
    with pytest.raises(TypeError, match="duplicate Spark names"):
        type("Bad", (tp.Schema,), {"x": tp.Column[int](), "y": tp.Column[int](spark_name="x")})
    with pytest.raises(TypeError, match="cannot be instantiated"):
        Row()
    with pytest.raises(TypeError, match="divider"):
        tp.FlatStruct[Where](divider="")
    cases = {"is not declared": {"requestId": str}, "uses Python type": {"tags": list[int]}, "does not match its schema structure": {"events": list[str]}}
    for message, hints in cases.items():
        with pytest.raises(TypeError, match=message):
            tp.model(schema=Row)(type("M", (), {"__annotations__": hints}))
    with pytest.raises(TypeError, match="lacks fields"):
        tp.model(schema=Place, strict=True)(type("M", (), {"__annotations__": {"city": str}}))
    with pytest.raises(TypeError, match="Schema class"):
        tp.model(schema=object)
    with pytest.raises(TypeError, match="no builder"):
        Place.to_dict(PlaceM("a", "b"))
    for keys, error in (("ab", TypeError), (["a", "a"], ValueError), ([""], TypeError)):
        with pytest.raises(error):
            tp.Context().bind(Dynamic.metrics, keys)
    with pytest.raises(TypeError):
        tp.Context().bind(Row.request, ["a"])
    assert isinstance(Dynamic.metrics, tp.ContextFieldProtocol) and F is not None
