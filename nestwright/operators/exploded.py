"""Lists as rows: pairs and similarities whose cost doesn't fall on one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.functions.similarity import _decay


def explode_combinations(df: DataFrame, column: str, *, skip_self: bool = False, skip_null: bool = False) -> DataFrame:
    """df with a row for each pair of list_combinations(column, with_index=True), as the columns left_index, right_index,
    left_value and right_value in place of the list. The pairs are made and passed on one by one, within generated
    code, where the expression holds all of a row's pairs at once. Rows whose list is null or empty vanish."""
    rest = [c for c in df.columns if c != column]
    if taken := {"left_index", "right_index", "left_value", "right_value"} & set(rest):
        raise ValueError(f"columns are named like the result's: {', '.join(sorted(taken))}")
    own = "_list"
    while own in df.columns:
        own += "_"
    left = df.select(*rest, F.col(column).alias(own), F.posexplode(column).alias("left_index", "left_value"))
    # Of an element only the list's end from it on is gone through.
    rest_of = F.slice(own, F.col("left_index") + 1, F.size(own))
    both = left.select(*rest, "left_index", "left_value", F.posexplode(rest_of).alias("right_index", "right_value")).withColumn("right_index", F.col("left_index") + F.col("right_index"))
    out = both.where(F.col("left_index") < F.col("right_index") if skip_self else F.col("left_index") <= F.col("right_index"))
    if skip_null:
        out = out.where("left_value is not null and right_value is not null")
    return out.select(*rest, "left_index", "right_index", "left_value", "right_value")


def similarity_of_long_lists(df: DataFrame, key: str, a: str, b: str, p: float = 0.9) -> DataFrame:
    """(key, score): list_similarity(a, b, p) for lists of any length, with one shuffle by key and item and one of
    sums by key, where the expression's cost grows with the square of the length. Keys must be unique; a null list on
    either side scores null, and two lists without items score 1. Items must be scalars of one type on both sides; floats
    are compared by their text, as list_similarity does."""
    p = _decay(p)
    kinds = [df.select(c).schema[0].dataType for c in (a, b)]
    if not all(isinstance(k, T.ArrayType) and not isinstance(k.elementType, (T.ArrayType, T.StructType, T.MapType)) for k in kinds):
        raise TypeError("lists must be arrays of scalars")
    if kinds[0].elementType != kinds[1].elementType and not any(isinstance(k.elementType, T.NullType) for k in kinds):
        raise TypeError(f"lists must have the same element type: {kinds[0].simpleString()}, {kinds[1].simpleString()}")
    text = any(isinstance(k.elementType, (T.FloatType, T.DoubleType)) for k in kinds)
    known = df.select(F.col(key).alias("_k"), F.col(a).alias("_a"), F.col(b).alias("_b"))

    def items(column: str, a_side: bool) -> DataFrame:
        rows = known.where("_a is not null and _b is not null").select("_k", F.posexplode(column).alias("_i", "_x")).where("_x is not null")
        rows = rows.withColumn("_x", F.col("_x").cast("string")) if text else rows
        place: Column = F.col("_i")
        return rows.select("_k", "_x", *((place if own else F.lit(None).cast("int")).alias(n) for n, own in (("_pa", a_side), ("_pb", not a_side))))

    places = items("_a", True).union(items("_b", False)).groupBy("_k", "_x").agg(F.min("_pa").alias("_pa"), F.min("_pb").alias("_pb"))
    weight = lambda c: F.coalesce(F.pow(F.lit(float(p)), F.col(c)), F.lit(0.0))
    sums = places.groupBy("_k").agg(F.sum(F.least(weight("_pa"), weight("_pb"))).alias("_n"), F.sum(F.greatest(weight("_pa"), weight("_pb"))).alias("_d"))
    out = known.select("_k", (F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("_there")).join(sums, "_k", "left")
    score = F.when(F.col("_there"), F.when(F.coalesce("_d", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_n") / F.col("_d")))
    return out.select(F.col("_k").alias(key), score.alias("score"))
