"""The library's own queries by name, and SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright import functions as N
from nestwright.sources import dfs_to_lazy_df
from nestwright.typed import queries as typed

FLAGSHIP = "list_zip_trunc"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A total order of an order's lines.
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, ls): every order's lines as structs in order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*LINE).alias("l"))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l")).alias("ls"))


def _zipped(pad: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = lines(spark, sf_dir).select("l_orderkey", F.col("ls.l_partkey").alias("parts"), F.filter(F.col("ls.l_suppkey"), lambda s: s % 2 == 0).alias("even"))
        pairs = own.select("l_orderkey", F.posexplode(N.list_zip("parts", "even", pad=pad, fields=["part", "supp"])).alias("pos", "z"))
        return pairs.select("l_orderkey", "pos", F.col("z.part").alias("part"), F.col("z.supp").alias("supp"))

    return query


_ORDERED = f"""l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE)}) - 1 AS i FROM lineitem),
e AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1 AS i FROM l WHERE l_suppkey % 2 = 0)"""


def _pairs(**options) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        holes = F.transform(F.col("ls.l_partkey"), lambda x: F.when(x % 5 != 0, x))
        own = lines(spark, sf_dir).select("l_orderkey", N.list_combinations(holes, with_index=True, **options).alias("ps"))
        return own.select("l_orderkey", F.explode("ps").alias("p")).select("l_orderkey", "p.*")

    return query


def _pairs_sql(where: str) -> str:
    return f"""WITH {_ORDERED}, h AS (SELECT l_orderkey, i, CASE WHEN l_partkey % 5 <> 0 THEN l_partkey END AS x FROM l)
SELECT a.l_orderkey, CAST(a.i AS INT) AS left_index, CAST(b.i AS INT) AS right_index, a.x AS left_value, b.x AS right_value
FROM h a JOIN h b ON a.l_orderkey = b.l_orderkey WHERE {where}"""


def pairs_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).select("l_orderkey", N.list_combinations_to("ls.l_partkey", "ls.l_suppkey", with_index=True, left_value="part", right_value="supp").alias("ps"))
    return own.select("l_orderkey", F.explode("ps").alias("p")).select("l_orderkey", "p.*")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, lists, ended): every customer's orders in order, each as its suppliers modulo 50 in order, and those of
    the orders with status F."""
    own = lines(spark, sf_dir).select("l_orderkey", F.transform(F.col("ls.l_suppkey"), lambda s: s % 50).alias("s"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(own, F.col("o_orderkey") == F.col("l_orderkey"))
    held = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "s"))).alias("held"))
    return held.select("o_custkey", F.col("held.s").alias("lists"), F.filter("held", lambda x: x["o_orderstatus"] == "F")["s"].alias("ended"))


_WEIGHTS = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {line}) - 1 AS i FROM lineitem),
w AS (SELECT l_orderkey AS k, l_suppkey % 50 AS x, pow({p}, min(i)) AS w FROM l GROUP BY 1, 2)"""


def _similar(p: float) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = lines(spark, sf_dir).select("l_orderkey", F.transform(F.col("ls.l_suppkey"), lambda s: s % 50).alias("s"))
        both = own.join(own.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("s").alias("following")), "l_orderkey")
        return both.select("l_orderkey", F.round(N.list_similarity("s", "following", p), 6).alias("score"))

    return query


def _similar_sql(p: float) -> str:
    return f"""WITH {_WEIGHTS.format(line=', '.join(LINE), p=p)},
pair AS (SELECT a.k, b.k AS n FROM (SELECT DISTINCT k FROM w) a JOIN (SELECT DISTINCT k FROM w) b ON b.k = a.k + 1),
u AS (SELECT pair.k, w.x, w.w AS a, 0.0 AS b FROM pair JOIN w ON w.k = pair.k UNION ALL SELECT pair.k, w.x, 0.0, w.w FROM pair JOIN w ON w.k = pair.n),
s AS (SELECT k, x, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1, 2)
SELECT k AS l_orderkey, round(sum(least(a, b)) / sum(greatest(a, b)), 6) AS score FROM s GROUP BY 1"""


def _means(to: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = customers(spark, sf_dir)
        score = N.list_mean_similarity_to("lists", "ended") if to else N.list_mean_similarity("lists")
        return own.select("o_custkey", F.posexplode(score).alias("pos", "score")).select("o_custkey", "pos", F.round("score", 6).alias("score"))

    return query


def _means_sql(to: bool) -> str:
    other = "b.o_orderstatus = 'F'" if to else "a.pos <> b.pos"
    return f"""WITH {_WEIGHTS.format(line=', '.join(LINE), p=0.9)},
o AS (SELECT o_custkey, o_orderstatus, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_orderkey IN (SELECT k FROM w)),
t AS (SELECT k, sum(w) AS total FROM w GROUP BY 1),
pair AS (SELECT a.o_custkey, a.pos, a.k AS ka, b.k AS kb, b.pos AS other FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND {other}),
m AS (SELECT pair.o_custkey, pair.pos, pair.other, sum(least(x.w, y.w)) AS shared FROM pair JOIN w x ON x.k = ka JOIN w y ON y.k = kb AND y.x = x.x GROUP BY ALL),
s AS (SELECT pair.o_custkey, pair.pos, coalesce(shared, 0) / (ta.total + tb.total - coalesce(shared, 0)) AS score FROM pair JOIN t ta ON ta.k = ka JOIN t tb ON tb.k = kb LEFT JOIN m ON m.o_custkey = pair.o_custkey AND m.pos = pair.pos AND m.other = pair.other)
SELECT o.o_custkey, CAST(o.pos AS INT) AS pos, round(avg(score), 6) AS score FROM o LEFT JOIN s ON s.o_custkey = o.o_custkey AND s.pos = o.pos GROUP BY 1, 2"""


def game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a state; its one action leads to the next line with probability 0.5, and a last state ends it."""
    own = lines(spark, sf_dir)
    states = F.transform("ls", lambda l, i: F.array(F.struct(F.lit(0.5).alias("probability"), l["l_quantity"].alias("value"), (i + 1).cast("long").alias("next_state"))))
    nothing = F.transform(F.array(F.lit(0)), lambda _: F.filter(states[0], lambda a: F.lit(False)))
    return own.select("l_orderkey", F.round(N.expected_value_of_game(F.concat(states, nothing)), 6).alias("value"))


def game_of_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a state with two actions: on to the next line with probability 0.5, or to the end with 0.25."""
    own = lines(spark, sf_dir)
    action = lambda p, v, n: F.struct(F.lit(p).alias("probability"), v.alias("value"), n.cast("long").alias("next_state"))
    states = F.transform("ls", lambda l, i: F.array(action(0.5, l["l_quantity"], i + 1), action(0.25, 100 * l["l_discount"], F.size("ls"))))
    nothing = F.transform(F.array(F.lit(0)), lambda _: F.filter(states[0], lambda a: F.lit(False)))
    return own.select("l_orderkey", F.round(N.expected_value_of_game(F.concat(states, nothing)), 6).alias("value"))


def plain_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of list_similarity by the function on plain sequences, a batch of rows at a time."""
    own = lines(spark, sf_dir).select("l_orderkey", F.transform(F.col("ls.l_suppkey"), lambda s: s % 50).alias("s"))
    both = own.join(own.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("s").alias("following")), "l_orderkey")

    def score(batches):
        for batch in batches:
            scores = [N.py_list_similarity(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["l_orderkey", "score"])

    return both.mapInArrow(score, "l_orderkey long, score double").select("l_orderkey", F.round("score", 6).alias("score"))


def installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list_zip_pad by the methods that install() adds to columns."""
    N.install()
    own = lines(spark, sf_dir).select("l_orderkey", F.col("ls.l_partkey").alias("parts"), F.filter(F.col("ls.l_suppkey"), lambda s: s % 2 == 0).alias("even"))
    pairs = own.select("l_orderkey", F.posexplode(F.col("parts").list.zip(F.col("even"), pad=True, fields=["part", "supp"])).alias("pos", "z"))
    return pairs.select("l_orderkey", "pos", F.col("z.part").alias("part"), F.col("z.supp").alias("supp"))


def _entries(text: Column) -> Column:
    return F.explode(N.json_object_items(text))


def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "props")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), F.array(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("l"))).alias("props"))
    return events.union(orders).select("id", _entries(F.col("props")).alias("e")).select("id", "e.key", "e.value")


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.array(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string")))
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(N.json_array_values(text)).alias("pos", "value"))
    return found.union(table(spark, sf_dir, "events").select("event_id", F.posexplode_outer(N.json_array_values("props")).alias("pos", "value")))


def query_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), (F.col("p_size") > 25).alias("big"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("type")).alias("q"))
    return N.with_url_query(own, "q").select("p_partkey", F.col("q").alias("query"))


def query_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A struct column of an unknown type, and a mapping with a list and a float."""
    own = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice", F.struct(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 25).alias("big")).alias("q"))
    mapping = {"t": F.split("p_type", " "), "price": F.col("p_retailprice")}
    return own.select("p_partkey", N.url_query_encode("q").alias("query"), N.url_query_encode(mapping, doseq=True).alias("mapped"))


def query_doseq(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.split("p_type", " ").alias("t"), F.col("p_brand").alias("b")).alias("q"))
    both = N.with_url_query(N.with_url_query(own, "q", "query", doseq=True), "q", "plain")
    return both.select("p_partkey", "query", "plain")


def query_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (("name", "n_name"), ("k~*", "n_nationkey"), ("name", "n_regionkey"))))
    return table(spark, sf_dir, "nation").select("n_nationkey", N.url_query_encode(pairs, kind="pairs").alias("query"))


def url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    part = lambda what: F.try_parse_url(F.col("url"), F.lit(what))
    return pages.select("page_id", N.url_build(scheme=part("PROTOCOL"), netloc=part("AUTHORITY"), path=F.regexp_replace(part("PATH"), "^/(?=[^/])", ""), query=part("QUERY"), fragment=part("REF")).alias("url"))


def union_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in three batches: whole and typed otherwise, reordered with one column less, and with one more."""
    orders = table(spark, sf_dir, "orders")
    batches = [
        orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_totalprice", "o_orderpriority"),
        orders.where("o_orderstatus = 'F'").select("o_orderpriority", "o_orderkey"),
        orders.where("o_orderstatus not in ('O', 'F')").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_custkey"),
    ]
    return dfs_to_lazy_df(batches, T.StructType.fromDDL("o_orderkey bigint, o_orderpriority string, o_totalprice double"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "list_zip_trunc": _zipped(False),
    "list_zip_pad": _zipped(True),
    "list_combinations": _pairs(),
    "list_combinations_skip_self": _pairs(skip_self=True),
    "list_combinations_skip_null": _pairs(skip_null=True),
    "list_combinations_to": pairs_to,
    "list_similarity": _similar(0.9),
    "list_similarity_p1": _similar(1.0),
    "list_mean_similarity": _means(False),
    "list_mean_similarity_to": _means(True),
    "py_list_similarity": plain_similarity,
    "installed_methods": installed,
    "expected_value_of_game": game,
    "expected_value_of_game_actions": game_of_actions,
    "json_object_items": json_items,
    "json_array_values": json_values,
    "url_query_encode_struct": query_struct,
    "url_query_encode_column": query_column,
    "url_query_encode_doseq": query_doseq,
    "url_query_encode_pairs": query_pairs,
    "url_build": url,
    "dfs_to_lazy_df": union_of_batches,
    **typed.QUERIES,
}

_QUOTED = "replace(url_encode({0}), '%20', '+')"
_PADDED = f"WITH {_ORDERED} SELECT l.l_orderkey, CAST(l.i AS INT) AS pos, l.l_partkey AS part, e.l_suppkey AS supp FROM l LEFT JOIN e ON e.l_orderkey = l.l_orderkey AND e.i = l.i"
ORACLE_SQL: dict[str, str] = {
    "list_zip_trunc": f"WITH {_ORDERED} SELECT l.l_orderkey, CAST(l.i AS INT) AS pos, l.l_partkey AS part, e.l_suppkey AS supp FROM l JOIN e ON e.l_orderkey = l.l_orderkey AND e.i = l.i",
    "list_zip_pad": _PADDED,
    "list_combinations": _pairs_sql("a.i <= b.i"),
    "list_combinations_skip_self": _pairs_sql("a.i < b.i"),
    "list_combinations_skip_null": _pairs_sql("a.i <= b.i AND a.x IS NOT NULL AND b.x IS NOT NULL"),
    "list_combinations_to": f"WITH {_ORDERED} SELECT a.l_orderkey, CAST(a.i AS INT) AS left_index, CAST(b.i AS INT) AS right_index, a.l_partkey AS part, b.l_suppkey AS supp FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey",
    "list_similarity": _similar_sql(0.9),
    "list_similarity_p1": _similar_sql(1.0),
    "py_list_similarity": _similar_sql(0.9),
    "installed_methods": _PADDED,
    "list_mean_similarity": _means_sql(False),
    "list_mean_similarity_to": _means_sql(True),
    "expected_value_of_game": f"WITH {_ORDERED} SELECT l_orderkey, round(sum(pow(0.5, i + 1) * l_quantity), 6) AS value FROM l GROUP BY 1",
    "expected_value_of_game_actions": f"WITH {_ORDERED} SELECT l_orderkey, round(sum(pow(0.5, i) * (0.5 * l_quantity + 25 * l_discount)), 6) AS value FROM l GROUP BY 1",
    "json_object_items": """WITH t AS (SELECT event_id AS id, props::JSON AS j FROM events UNION ALL SELECT o_orderkey, json_object('c', o_custkey, 'p', o_orderpriority, 'l', [o_orderstatus, o_orderpriority]) FROM orders)
SELECT t.id, e.key, e.value->>'$' AS value FROM t, json_each(t.j) e""",
    "json_array_values": """SELECT o_orderkey, CAST(i AS INT) AS pos, [o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)][i + 1] AS value FROM orders, unnest([0, 1, 2]) u(i)
UNION ALL SELECT event_id, NULL, NULL FROM events""",
    "url_query_encode_struct": f"SELECT p_partkey, 'name=' || {_QUOTED.format('p_name')} || '&size=' || p_size || '&big=' || CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END || '&type=' || CASE WHEN p_size > 10 THEN {_QUOTED.format('p_type')} ELSE 'None' END AS query FROM part",
    "url_query_encode_column": f"""SELECT p_partkey, 'name=' || {_QUOTED.format('p_name')} || '&price=' || p_retailprice || '&big=' || CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS query,
list_aggregate(list_transform(string_split(p_type, ' '), lambda x: 't=' || {_QUOTED.format('x')}), 'string_agg', '&') || '&price=' || p_retailprice AS mapped FROM part""",
    "url_query_encode_doseq": f"""SELECT p_partkey, list_aggregate(list_transform(string_split(p_type, ' '), lambda x: 't=' || {_QUOTED.format('x')}), 'string_agg', '&') || '&b=' || {_QUOTED.format('p_brand')} AS query,
't=' || {_QUOTED.format("('[' || list_aggregate(list_transform(string_split(p_type, ' '), lambda x: '''' || x || ''''), 'string_agg', ', ') || ']')")} || '&b=' || {_QUOTED.format('p_brand')} AS plain FROM part""",
    "url_query_encode_pairs": f"SELECT n_nationkey, 'name=' || {_QUOTED.format('n_name')} || '&k~%2A=' || n_nationkey || '&name=' || n_regionkey AS query FROM nation",
    "url_build": "SELECT page_id, url FROM pages",
    "dfs_to_lazy_df": "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS o_totalprice FROM orders",
    **typed.ORACLE_SQL,
}
