"""Queries that go through typed schemas."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestwright.typed.build import Builder, model
from nestwright.typed.context import Context, ContextFieldProtocol
from nestwright.typed.schema import Column, FlatDict, FlatListStruct, FlatStruct, FlatTuple, ListStruct, Schema, Struct


class PartSchema(Schema):
    size = Column[int](spark_name="p_size")
    brand = Column[str](spark_name="p_brand")


class LineSchema(Schema):
    number = Column[int]()
    part = Struct[PartSchema]()


class OrderSchema(Schema):
    key = Column[int](spark_name="o_orderkey")
    lines = ListStruct[LineSchema]()


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nested lines, taken apart again by the schema's path expressions."""
    part, line = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    nested = line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("number"), F.struct(F.col("p_size").cast("long").alias("p_size"), "p_brand").alias("part")))).alias("lines")
    )
    sizes, brands = OrderSchema.lines.item.part.fields.size.expr(), OrderSchema.lines.item.part.fields.brand.expr()
    return nested.select(OrderSchema.key.expr(), F.array_max(sizes).alias("largest"), F.size(F.array_distinct(brands)).cast("long").alias("brands"))


class RegionSchema(Schema):
    key = Column[int](spark_name="r_regionkey")
    rates = FlatDict[float](spark_name="rate")


@model(schema=RegionSchema)
class Region:
    key: int
    rates: dict[str, float]


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with keys chosen at run time as columns, joined to the regions."""
    context = Context().bind(RegionSchema.rates, ["low", "high"])
    rates = RegionSchema.to_frame_many(Region, [Region(k, {"low": k / 2} if k % 2 else {"low": k / 2, "high": k * 2.0}) for k in range(5)], context=context, spark=spark)
    return spark.read.parquet(f"{sf_dir}/region.parquet").join(rates.withColumn("r_regionkey", F.col("r_regionkey").cast("int")), "r_regionkey")


class PlaceSchema(Schema):
    name = Column[str]()
    region = Column[int]()


class LetterSchema(Schema):
    letter = Column[str]()
    at = Column[int]()


class NationSchema(Schema):
    key = Column[int](spark_name="n_nationkey")
    place = FlatStruct[PlaceSchema](spark_name="p")
    letters = FlatListStruct[LetterSchema](spark_name="l")
    bounds = FlatTuple[int](spark_name="b")


@model(schema=PlaceSchema)
class Place:
    name: str
    region: int


class Letter(NamedTuple):
    letter: str
    at: int


@model(schema=NationSchema, strict=True)
class Nation:
    key: int
    place: Place
    letters: list[Letter]
    bounds: tuple[int, ...]


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as records with flat structs, lists of structs and tuples, to a frame, back and there again; and what
    the schema says of them."""
    context = Context().bind(NationSchema.bounds, ["low", "high"])
    assert context.signature == Context().bind(NationSchema.bounds, ["low", "high"]).signature and isinstance(NationSchema.bounds, ContextFieldProtocol)
    builder = Builder.for_model(Nation, schema=NationSchema)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    records = [Nation(r.n_nationkey, Place(r.n_name, r.n_regionkey), [Letter(r.n_name[i], i) for i in (0, 1)], (r.n_nationkey, r.n_nationkey * 2)) for r in nations]
    frame = builder.to_frame_many(records, context=context, spark=spark)
    assert frame.schema.names == NationSchema.model_schema(Nation, context).names == NationSchema.spark_schema(context).names == list(builder.physical_plan_for(context).schema.names)
    again = [NationSchema.from_dict(Nation, NationSchema.to_dict(r, by_spark_name=True, context=context), by_spark_name=True) for r in builder.iter_frame(frame, strict_schema=True)]
    one = builder.from_frame(builder.to_frame(again[0], context=context, spark=spark))
    back = NationSchema.to_frame_many(Nation, [one, *again[1:]], context=context, spark=spark)
    letters = NationSchema.letters.item
    return back.select(
        "n_nationkey", NationSchema.place.fields.name.expr().alias("name"), NationSchema.place.fields.region.expr().alias("region"), F.array_join(letters.letter.expr(), "").alias("letters"),
        F.array_max(letters.at.expr()).alias("last"), NationSchema.bounds.key_expr("low").alias("low"), NationSchema.bounds.key_expr("high").alias("high"),
    )


QUERIES = {"typed_paths": paths, "typed_flat_dict": flat, "typed_flat_records": spread}
ORACLE_SQL = {
    "typed_paths": "SELECT l_orderkey AS o_orderkey, CAST(max(p_size) AS BIGINT) AS largest, count(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "typed_flat_records": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS name, CAST(n_regionkey AS BIGINT) AS region, substr(n_name, 1, 2) AS letters, CAST(1 AS BIGINT) AS last, CAST(n_nationkey AS BIGINT) AS low, CAST(n_nationkey * 2 AS BIGINT) AS high FROM nation",
    "typed_flat_dict": "SELECT r_regionkey, r_name, r_regionkey / 2.0::DOUBLE AS rate_low, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey * 2.0::DOUBLE END AS rate_high FROM region",
}
