"""The functions against values and models written out here."""

import json
import math
import random
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F

from nestwright import functions as N


def rows(df, column="x"):
    def plain(v):
        if hasattr(v, "asDict"):
            return tuple(plain(x) for x in v)
        return [plain(x) for x in v] if isinstance(v, list) else v

    return [plain(r[column]) for r in df.collect()]


LISTS = "a array<bigint>, b array<bigint>"


def test_zip_cuts_to_the_shortest_or_pads(spark):
    df = spark.createDataFrame([([1, 2], [10, 20]), ([3], [30, 35]), (None, [40]), ([None], [35]), ([], [7])], LISTS).coalesce(1)
    assert rows(df.select(N.list_zip("a", "b").alias("x"))) == [[(1, 10), (2, 20)], [(3, 30)], None, [(None, 35)], []]
    assert rows(df.select(N.list_zip("a", "b", pad=True, fields=["l", "r"]).alias("x"))) == [[(1, 10), (2, 20)], [(3, 30), (None, 35)], None, [(None, 35)], [(None, 7)]]
    assert df.select(N.list_zip("a", "b")).columns == ["a"]
    assert df.select(N.list_zip("a", "b", fields=["l", "r"])).schema[0].dataType.elementType.names == ["l", "r"]


def test_zip_checks_its_arguments():
    for error, options in ((ValueError, {"fields": ["a"]}), (TypeError, {"fields": "ab"}), (TypeError, {"fields": ["a", 1]}), (ValueError, {"fields": ["a", "a"]}), (TypeError, {"pad": 1})):
        with pytest.raises(error):
            N.list_zip("a", "b", **options)
    with pytest.raises(ValueError, match="at least two"):
        N.list_zip("a")
    with pytest.raises(ValueError, match="unique"):
        N.list_zip("a", "a")


def pairs_model(xs, ys=None, start=0, skip_null=False):
    if xs is None or ys is None and start is None:
        return None
    out = [(i, j, x, y) for i, x in enumerate(xs) for j, y in enumerate(xs if ys is None else ys) if ys is not None or j >= i + start]
    return [p for p in out if not skip_null or p[2] is not None and p[3] is not None]


@pytest.mark.parametrize("skip_self", [False, True])
@pytest.mark.parametrize("skip_null", [False, True])
def test_combinations(spark, skip_self, skip_null):
    data = [[10, 20, 30], [1], [], None, [None, 2], [0, None, 1, 2, None], [5, 5]]
    df = spark.createDataFrame([(d,) for d in data], "a array<bigint>").coalesce(1)
    got = rows(df.select(N.list_combinations("a", with_index=True, skip_self=skip_self, skip_null=skip_null).alias("x")))
    assert got == [pairs_model(d, start=int(skip_self), skip_null=skip_null) for d in data]


def test_combinations_to(spark):
    data = [([1, 2], ["a", "b"]), ([], ["c"]), (None, ["d"]), ([], None), ([None, 3], ["e", None])]
    df = spark.createDataFrame(data, "a array<bigint>, b array<string>").coalesce(1)
    got = rows(df.select(N.list_combinations_to("a", "b", left_index="i").alias("x")))
    assert got == [None if a is None or b is None else pairs_model(a, b) for a, b in data]
    kind = df.select(N.list_combinations_to("a", "b", left_index="i").alias("x")).schema[0].dataType.elementType
    assert kind.names == ["i", "right_index", "left_value", "right_value"] and kind["i"].dataType.typeName() == "integer"
    assert rows(df.select(N.list_combinations_to("a", "b", skip_null=True).alias("x")))[-1] == [(3, "e")]


def test_combinations_check_names():
    with pytest.raises(TypeError, match="field names"):
        N.list_combinations("a", left_value=1)
    with pytest.raises(ValueError, match="unique"):
        N.list_combinations("a", left_value="x", right_value="x")
    with pytest.raises(TypeError):
        N.list_combinations("a", skip_self="no")


def near(got, want):
    if got is None or want is None:
        return got is want
    return all(map(near, got, want)) and len(got) == len(want) if isinstance(want, list) else math.isclose(got, want, abs_tol=1e-12)


def test_similarity_known_values(spark):
    data = [([1, 2, 3], [1, 2, 3], 1.0), ([1, 2, 3], [2, 1, 3], 2.61 / 2.81), ([1], [2], 0.0), (None, [1], None), ([], [], 1.0), ([None], [], 1.0), ([None, 1], [1], 0.9)]
    df = spark.createDataFrame([d[:2] for d in data], LISTS).coalesce(1)
    assert all(map(near, rows(df.select(N.list_similarity("a", "b").alias("x"))), [d[2] for d in data]))
    floats = spark.createDataFrame([([0.0], [-0.0]), ([math.nan], [math.nan])], "a array<double>, b array<double>").coalesce(1)
    assert rows(floats.select(N.list_similarity("a", "b").alias("x"))) == [0.0, 1.0]


def test_similarity_against_the_plain_one(spark):
    rng = random.Random(1)
    some = lambda: None if rng.random() < 0.05 else [None if rng.random() < 0.15 else rng.randint(0, 6) for _ in range(rng.randint(0, 8))]
    data = [(some(), some()) for _ in range(200)]
    df = spark.createDataFrame(data, LISTS).coalesce(1)
    for p in (0.9, 0.5, 1):
        want = [None if a is None or b is None else N.py_list_similarity(a, b, p) for a, b in data]
        assert all(map(near, rows(df.select(N.list_similarity("a", "b", p).alias("x"))), want))


def test_similarity_errors(spark):
    df = spark.createDataFrame([([1], ["1"])], "a array<int>, b array<string>")
    with pytest.raises(Exception, match="DATATYPE_MISMATCH|same element type"):
        df.select(N.list_similarity("a", "b")).collect()
    wide = spark.createDataFrame([([1], [1])], "a array<int>, b array<bigint>")
    with pytest.raises(Exception, match="same element type"):
        wide.select(N.list_similarity("a", "b")).collect()
    for p, error in ((True, TypeError), ("x", TypeError), (0, ValueError), (1.5, ValueError), (math.nan, ValueError)):
        with pytest.raises(error):
            N.list_similarity("a", "b", p)
    with pytest.raises(TypeError, match="py_list_similarity"):
        N.list_similarity([1], "b")
    with pytest.raises(TypeError):
        N.py_list_similarity([1], ["a"])
    with pytest.raises(TypeError):
        N.py_list_similarity([True], [1])
    assert N.py_list_similarity([1, 2, 3], [1, 2, 4, 5], 1) == 2 / 5


def test_mean_similarities_against_the_plain_one(spark):
    rng = random.Random(2)
    inner = lambda: None if rng.random() < 0.15 else [rng.randint(0, 4) for _ in range(rng.randint(0, 4))]
    some = lambda: None if rng.random() < 0.1 else [inner() for _ in range(rng.randint(0, 5))]
    data = [*[(some(), some()) for _ in range(120)], ([[1]], None), ([[1, 2]], [None])]
    df = spark.createDataFrame(data, "a array<array<bigint>>, b array<array<bigint>>").coalesce(1)

    def mean(x, others):
        others = [o for o in others if o is not None]
        return None if x is None or not others else sum(N.py_list_similarity(x, o) for o in others) / len(others)

    own = [None if a is None else [mean(x, a[:i] + a[i + 1 :]) for i, x in enumerate(a)] for a, _ in data]
    to = [None if a is None else [mean(x, b or []) for x in a] for a, b in data]
    assert all(map(near, rows(df.select(N.list_mean_similarity("a").alias("x"))), own))
    assert all(map(near, rows(df.select(N.list_mean_similarity_to("a", "b").alias("x"))), to))


GAME = "g array<array<struct<probability:double,value:double,next_state:bigint>>>"


def test_games(spark):
    games = [[], [[]], [[(1.0, 5.0, 1)], []], [[(0.5, 10.0, 1), (0.5, 5.0, 2)], [], []], [[(0.5, 2.0, 1)], [(0.25, 2.0, 2)], []], [[(1.0, 9.0, 5)]]]

    def value(game):
        if len(game) < 2:
            return 0.0
        v = [0.0] * len(game)
        for i in range(len(game) - 2, -1, -1):
            v[i] = sum(p * (x + v[n]) for p, x, n in game[i])
        return v[0]

    df = spark.createDataFrame([(g,) for g in games], GAME).coalesce(1)
    assert rows(df.select(N.expected_value_of_game("g").alias("x"))) == [value(g) for g in games]


@pytest.mark.parametrize("game,message", [([[(1.0, 1.0, 0)], []], "next_state"), ([[], [(1.0, 1.0, 1)]], "final state"), (None, "null"), ([None, []], "null"), ([[(None, 1.0, 1)], []], "null"), ([[(1.0, 1.0, 2)], []], "next_state")])
def test_wrong_games(spark, game, message):
    with pytest.raises(Exception, match=message):
        spark.createDataFrame([(game,)], GAME).select(N.expected_value_of_game("g")).collect()


JSONS = [
    '{"text":"hello","number":12.5,"boolean":true,"null":null}', '{"array":[1,"x"],"object":{"nested":false}}', "{}", "[]", '["a",1,null,{"b": [2]}]', '{"z":"привет","a":"\\u263a"}', '{"k":1,"j":2,"k":3}',
    None, "null", '"text"', "42", "true", "{invalid", "", "  ", '{"a":1} x', "{'a':1}", "[NaN]", '{"a":NaN}', "[1],[2]", "1],[2", '{"a":1}}', ' {"a": 1} ', "[1]]", '{"a"}', "[,]",
]


def json_model(text, kind):
    def refuse(_):
        raise ValueError

    try:
        value = json.loads(text, parse_constant=refuse)
    except (TypeError, ValueError):
        return None
    if not isinstance(value, kind):
        return None
    told = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return [(k, told(v)) for k, v in value.items()] if kind is dict else [told(v) for v in value]


@pytest.mark.parametrize("exact", [False, True])
def test_json(spark, exact):
    df = spark.createDataFrame([(t,) for t in JSONS], "j string").coalesce(1)
    assert rows(df.select(N.json_object_items("j", exact=exact).alias("x"))) == [json_model(t, dict) for t in JSONS]
    assert rows(df.select(N.json_array_values("j", exact=exact).alias("x"))) == [json_model(t, list) for t in JSONS]


def test_strict_json(spark):
    good = spark.createDataFrame([("{}",), ("null",), ("[1]",), (None,)], "j string").coalesce(1)
    assert rows(good.select(N.json_object_items("j", strict=True).alias("x"))) == [[], None, None, None]
    bad = spark.createDataFrame([("{bad",)], "j string")
    for function in (N.json_object_items, N.json_array_values):
        with pytest.raises(Exception, match="invalid JSON"):
            bad.select(function("j", strict=True)).collect()
        with pytest.raises(TypeError):
            function("j", strict="yes")
    with pytest.raises(Exception, match="expected a string"):
        spark.range(1).select(N.json_array_values("id")).collect()


def test_query_strings(spark):
    df = spark.createDataFrame([("Ada Lovelace", 2, True, None, ["python", "polar s"]), ("Grace & Hopper", 3, False, None, [])], "name string, page bigint, active boolean, missing string, tags array<string>").coalesce(1)
    s = df.select(F.struct("name", "page", "active", "missing").alias("x"))
    want = ["name=Ada+Lovelace&page=2&active=True&missing=None", "name=Grace+%26+Hopper&page=3&active=False&missing=None"]
    assert rows(N.with_url_query(s, "x")) == want
    assert rows(s.select(N.url_query_encode("x"))) == want
    assert rows(df.select(N.url_query_encode({c: c for c in ("name", "page", "active", "missing")}).alias("x"))) == want
    t = df.select(F.struct("tags").alias("x"))
    for doseq, text in ((True, ["tags=python&tags=polar+s", ""]), (False, ["tags=%5B%27python%27%2C+%27polar+s%27%5D", "tags=%5B%5D"])):
        assert rows(N.with_url_query(t, "x", doseq=doseq)) == text
        assert rows(t.select(N.url_query_encode("x", doseq=doseq))) == text
    items = spark.createDataFrame([('{"tag":"a b","page":2,"missing":null}',), (None,)], "j string").coalesce(1).select(N.json_object_items("j").alias("x"))
    for query in (N.with_url_query(items, "x"), items.select(N.url_query_encode("x", kind="pairs").alias("x")), items.select(N.url_query_encode("x"))):
        assert rows(query) == ["tag=a+b&page=2&missing=None", None]
    floats = spark.createDataFrame([((1e20, "é~*"),), (None,)], "x struct<v:double,`ключ`:string>").coalesce(1)
    assert rows(N.with_url_query(floats, "x")) == ["v=1e%2B20&" + quote_plus("ключ") + "=%C3%A9~%2A", None]
    with pytest.raises(Exception, match="keys must not be null"):
        spark.sql("select array(named_struct('key', cast(null as string), 'value', 'x')) x").select(N.url_query_encode("x", kind="pairs")).collect()
    with pytest.raises(TypeError):
        N.url_query_encode("x", doseq=1)


def url_model(scheme, netloc, path, params, query, fragment):
    tail = (path or "") + (f";{params}" if params else "")
    if netloc or scheme and tail.startswith("//"):
        tail = "//" + (netloc or "") + ("/" if tail and tail[0] != "/" else "") + tail
    return (f"{scheme}:" if scheme else "") + tail + (f"?{query}" if query else "") + (f"#{fragment}" if fragment else "")


def test_urls(spark):
    rng = random.Random(3)
    data = [tuple(rng.choice(v) for v in (["https", "", None], ["x.org", "", None], ["/a", "b", "//c", "", None], ["p", "", None], ["q=1", None], ["f", None])) for _ in range(150)]
    names = ["scheme", "netloc", "path", "params", "query", "fragment"]
    df = spark.createDataFrame(data, ", ".join(f"{n} string" for n in names)).coalesce(1)
    assert rows(df.select(N.url_build(**{n: n for n in names})), "url") == [url_model(*d) for d in data]
    assert rows(spark.range(1).select(N.url_build()), "url") == [""]
    with pytest.raises(Exception, match="must be strings"):
        spark.range(1).select(N.url_build(path="id")).collect()


def test_install_adds_and_keeps(spark):
    from pyspark.sql.classic.column import Column

    before = vars(Column).get("list")
    try:
        assert N.install() == ["list", "str"] and N.install() == []
        df = spark.createDataFrame([([1, 2], "[1]")], "a array<bigint>, j string")
        assert rows(df.select(F.col("a").list.combinations(skip_self=True).alias("x"))) == [[(1, 2)]]
        assert rows(df.select(F.col("j").str.json_array_values().alias("x"))) == [["1"]]
        with pytest.raises(TypeError):
            N.install(overwrite=1)
    finally:
        from nestwright.functions.install import METHODS, _owners

        for owner in _owners():
            for name in METHODS:
                if name in vars(owner) and before is None:
                    delattr(owner, name)


def test_plans_have_no_python(spark):
    df = spark.createDataFrame([([1], [2], "{}", [[1]])], "a array<bigint>, b array<bigint>, j string, l array<array<bigint>>")
    made = [N.list_zip("a", "b"), N.list_combinations("a"), N.list_similarity("a", "b"), N.list_mean_similarity("l"), N.json_object_items("j"), N.json_array_values("j"), N.url_build(path="j")]
    out = df.select(*(c.alias(f"x{i}") for i, c in enumerate(made)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_the_url_query_keeps_long_paths(spark, tmp_path):
    from nestwright.plans.queries import QUERIES

    urls = ["https://a.b/" + "x/" * 1500 + "end?q=1#f", "https://a.b/p", "https://a.b/", "https://a.b//p"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [r.url for r in QUERIES["url_build"](spark, str(tmp_path)).orderBy("page_id").collect()] == urls


def test_zip_tells_columns_of_one_name_apart(spark):
    for first, second in (("a", F.col("a")), (F.col("a"), F.col("a")), (F.col("b").alias("a"), F.col("t.a"))):
        with pytest.raises(ValueError, match="unique"):
            N.list_zip(first, second)
    df = spark.createDataFrame([([1], [2])], LISTS)
    assert rows(df.select(N.list_zip(F.col("a"), F.col("b")).alias("x"))) == [[(1, 2)]]


def test_similarity_takes_scalars_only(spark):
    df = spark.createDataFrame([([[1]], [[[1]]], [(1,)])], "a array<array<int>>, b array<array<array<int>>>, c array<struct<x:int>>")
    for score in (N.list_similarity("a", "a"), N.list_similarity("c", "c"), N.list_mean_similarity("b"), N.list_mean_similarity_to("b", "b")):
        with pytest.raises(Exception, match="must be scalars"):
            df.select(score).collect()
    empty = spark.createDataFrame([([1, 2],)], "a array<int>")
    assert rows(empty.select(N.list_similarity("a", F.array()).alias("x"))) == [0.0]


def test_mappings_and_pairs_write_lists_and_floats_as_python_does(spark):
    df = spark.createDataFrame([(["a", "b"], 1e10, 2.5, None)], "t array<string>, x double, y float, n int")
    assert rows(df.select(N.url_query_encode({"t": "t", "x": "x", "n": "n"}, doseq=True).alias("x"))) == ["t=a&t=b&x=10000000000.0&n=None"]
    assert rows(df.select(N.url_query_encode({"t": "t"}).alias("x"))) == ["t=%5B%27a%27%2C+%27b%27%5D"]
    assert rows(df.select(N.url_query_encode({"n": "n", "s": F.lit("a b")}, kind="plain").alias("x"))) == ["n=None&s=a+b"]
    pairs = F.array(F.struct(F.lit("k").alias("key"), F.col("x").alias("value")))
    assert rows(df.select(N.url_query_encode(pairs, kind="pairs").alias("x"))) == ["k=10000000000.0"]
    plan = spark.range(1).select(N.url_query_encode(F.array(F.struct(F.lit("k").alias("key"), F.col("id").alias("value"))), kind="pairs"))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan
