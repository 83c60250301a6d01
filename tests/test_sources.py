import pyarrow as pa
import pytest

from nestwright.sources import batch_source, dfs_to_lazy_df

SCHEMA = "id bigint, name string, score double"


def batches(spark):
    return [spark.createDataFrame([("1", "a", 0.5)], "id string, name string, extra double"), spark.createDataFrame([(2.0, 2, "b")], "score double, id int, name string"), spark.createDataFrame([(3, "c", 3.5)], SCHEMA)]


def test_batches_take_the_declared_schema(spark):
    df = dfs_to_lazy_df(iter(batches(spark)), SCHEMA)
    assert df.schema.simpleString() == "struct<id:bigint,name:string,score:double>"
    for _ in range(2):  # the iterator is used up, the result isn't
        assert sorted(map(tuple, df.collect())) == [(1, "a", None), (2, "b", 2.0), (3, "c", 3.5)]
    assert df.where("id > 1").select("name").count() == 2 and df.limit(2).count() == 2
    assert dfs_to_lazy_df([], SCHEMA, spark).columns == ["id", "name", "score"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        dfs_to_lazy_df([spark.createDataFrame([("x",)], "id string")], SCHEMA).collect()


def test_filters_and_columns_reach_the_files(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(i, "a", 0.5)], SCHEMA).write.parquet(str(tmp_path / str(i)))
    df = dfs_to_lazy_df([spark.read.parquet(str(tmp_path / str(i))) for i in range(2)], SCHEMA).where("id = 1").select("name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(id,1)") == 2 and "score" not in plan.split("ReadSchema")[1]


def test_makers_run_on_the_executors(spark):
    def maker(i):
        return lambda: [pa.table({"id": [i, i + 10], "name": ["x", "y"]})]

    df = batch_source(spark, [maker(i) for i in range(3)], SCHEMA, batch_size=1)
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 10, 11, 12] and df.where("score is null").count() == 6
    with pytest.raises(ValueError):
        batch_source(spark, [], SCHEMA, batch_size=0)


def test_filters_are_applied_where_batches_are_made(spark):
    table = pa.table({"id": [1, 2, None, 4], "name": ["ab", None, "cd", "ad"], "score": [0.5, 1.5, 2.5, None]})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = batch_source(spark, [lambda: [table]], SCHEMA)
        for where, ids in (("id > 1", [2, 4]), ("id is null", [None]), ("name like 'a%' and id in (1, 2)", [1]), ("not id = 1", [2, 4]), ("score > 1", [2, None]), ("name <=> null", [2]), ("id not in (2, 4)", [1])):
            assert [r.id for r in df.where(where).collect()] == ids, where
        plan = df.where("id > 1")._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan.replace("isnotnull(id", "") or "(id#" not in plan.split("Filter")[1].split("\n")[0].replace("isnotnull(id#", "")
        assert batch_source(spark, [lambda: [table]], SCHEMA, columns=["score", "id"]).columns == ["score", "id"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert batch_source(spark, [], SCHEMA).collect() == [] and batch_source(spark, [], SCHEMA).columns == ["id", "name", "score"]
