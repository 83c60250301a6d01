import math
import random

import pytest
from pyspark.sql import functions as F

from nestwright import functions as N
from nestwright.operators import explode_combinations, similarity_of_long_lists


def test_exploded_pairs_are_those_of_the_expression(spark):
    df = spark.createDataFrame([(1, [3, None, 5]), (2, []), (3, None), (4, [7])], "id int, a array<int>")
    for options in ({}, {"skip_self": True}, {"skip_null": True}):
        got = sorted(map(str, explode_combinations(df, "a", **options).collect()))
        want = df.select("id", F.explode(N.list_combinations("a", with_index=True, **options)).alias("p")).select("id", "p.*")
        assert got == sorted(map(str, want.collect()))
    plan = explode_combinations(df, "a")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_long_lists_score_as_short_ones(spark):
    rng = random.Random(1)
    some = lambda: None if rng.random() < 0.1 else [None if rng.random() < 0.1 else rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
    df = spark.createDataFrame([(i, some(), some()) for i in range(80)], "id int, a array<int>, b array<int>")
    want = {r.id: r.s for r in df.select("id", N.list_similarity("a", "b", 0.8).alias("s")).collect()}
    for r in similarity_of_long_lists(df, "id", "a", "b", 0.8).collect():
        assert (r.score is None and want[r.id] is None) or math.isclose(r.score, want[r.id], abs_tol=1e-12)


def test_functions_apply_to_streams(spark, tmp_path):
    spark.createDataFrame([([1, 2], [2, 1])], "a array<bigint>, b array<bigint>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a array<bigint>, b array<bigint>").parquet(str(tmp_path / "in"))
    query = stream.select(N.list_similarity("a", "b").alias("s"), F.size(N.list_combinations("a")).alias("n")).writeStream.format("memory").queryName("scores").start()
    try:
        query.processAllAvailable()
        assert [(round(r.s, 6), r.n) for r in spark.table("scores").collect()] == [(round(1.8 / 2, 6), 3)]
    finally:
        query.stop()


def test_names_and_types_are_checked(spark):
    df = spark.createDataFrame([(1, [3, 4], "x")], "_list int, a array<int>, left_index string")
    with pytest.raises(ValueError, match="left_index"):
        explode_combinations(df, "a")
    assert explode_combinations(df.drop("left_index"), "a").count() == 3
    lists = spark.createDataFrame([(1, [1], ["1"], [[1]], [0.0], [-0.0])], "id int, a array<int>, b array<string>, c array<array<int>>, d array<double>, e array<double>")
    for a, b in (("a", "b"), ("c", "c"), ("id", "a")):
        with pytest.raises(TypeError):
            similarity_of_long_lists(lists, "id", a, b)
    with pytest.raises(ValueError):
        similarity_of_long_lists(lists, "id", "a", "a", 2)
    assert similarity_of_long_lists(lists, "id", "d", "e").first().score == 0.0
