"""Queries over the relational tables: selection, aggregation, windows, sets, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import aggregate, combinatorics, graph, select
from quillspark.operators.cluster import connected_components

from .registry import query


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _compare(op: str, sign: str):
    @query(f"idx_filter_{op}", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity {sign} 25")
    def run(spark, sf_dir):
        return select.where_compare(read(spark, sf_dir, "lineitem"), "l_quantity", op, 25.0).select("l_orderkey", "l_linenumber")

    return run


for _op, _sign in (("gt", ">"), ("lt", "<"), ("eq", "="), ("gte", ">="), ("lte", "<=")):
    _compare(_op, _sign)


@query("quantile_filter", "SELECT event_id, value FROM events WHERE value > (SELECT quantile_cont(value, 0.2) FROM events)")
def quantile_filter(spark, sf_dir):
    return select.above_quantile(read(spark, sf_dir, "events").select("event_id", "value"), "value", 0.2)


@query(
    "quantile_segment",
    """SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.33) AS lo, quantile_cont(value, 0.67) AS hi FROM events)
    WHERE value >= lo AND value < hi""",
)
def quantile_segment(spark, sf_dir):
    return select.quantile_segment(read(spark, sf_dir, "events").select("event_id", "value"), "value", 0.33, 0.67)


@query("select_when", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 3 THEN 0 ELSE l_quantity END AS v FROM lineitem")
def select_when(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", select.select_when(F.col("l_quantity") < 3, F.lit(0.0), F.col("l_quantity")).alias("v"))


@query("slice_rows", "SELECT i AS pos, c_custkey, c_name FROM range(60) r(i) JOIN customer ON c_custkey = (i * 7) % 40 + 1")
def slice_rows(spark, sf_dir):
    wanted = spark.range(60).select(F.col("id").alias("pos"), (F.col("id") * 7 % 40 + 1).alias("idx"))
    return select.slice_rows(read(spark, sf_dir, "customer"), F.broadcast(wanted), "c_custkey").select("pos", "c_custkey", "c_name")


@query("scatter_rows", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def scatter_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return select.scatter(rows, rows.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(-1.0)), "c_custkey", "c_acctbal")


@query("any_all", "SELECT bool_or(l_discount > 0.09) AS \"any\", bool_and(l_quantity > 0) AS \"all\" FROM lineitem")
def any_all(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.agg(F.bool_or(F.col("l_discount") > 0.09).alias("any"), F.bool_and(F.col("l_quantity") > 0).alias("all"))


@query("nonzeros", """WITH e AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding) AS v FROM embeddings)
    SELECT i, CAST(j AS INT) AS j, round(CAST(v AS DOUBLE), 6) AS v FROM e WHERE v <> 0""")
def nonzeros(spark, sf_dir):
    return select.nonzeros(read(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("i", "j", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("mode_by_group", """WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_quantity) AS r FROM c)
    SELECT l_returnflag, l_quantity AS mode, n FROM r WHERE r = 1""")
def mode_by_group(spark, sf_dir):
    return aggregate.mode(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query("mode_first_by_group", """WITH c AS (SELECT event_type, user_id, count(*) AS n, min(event_id) AS p FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, p) AS r FROM c)
    SELECT event_type, user_id AS mode, n FROM r WHERE r = 1""")
def mode_first_by_group(spark, sf_dir):
    return aggregate.mode_first(read(spark, sf_dir, "events"), ["event_type"], "user_id", "event_id")


@query("mode_with_fallback", """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM c),
    a AS (SELECT c_mktsegment AS whole FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)
    SELECT n.c_nationkey, coalesce(c_mktsegment, whole) AS mode FROM (SELECT CAST(k AS INT) AS c_nationkey FROM range(32) x(k)) n LEFT JOIN r ON r.c_nationkey = n.c_nationkey AND r = 1, a""")
def mode_with_fallback(spark, sf_dir):
    # some groups have no customers
    groups = spark.range(32).select(F.col("id").cast("int").alias("c_nationkey"))
    return aggregate.mode_with_fallback(read(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", groups)


@query("upper_median", """WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, o_totalprice AS median FROM r WHERE r = n // 2 + 1""")
def upper_median(spark, sf_dir):
    return aggregate.upper_median(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


@query("histogram_edges", """SELECT CASE WHEN value >= 0 AND value < 10 THEN 0 WHEN value >= 10 AND value < 20 THEN 1 WHEN value >= 20 AND value < 50 THEN 2
    WHEN value = 50 THEN 3 ELSE -1 END AS bin, count(*) AS n FROM events GROUP BY 1""")
def histogram_edges(spark, sf_dir):
    return aggregate.histogram(read(spark, sf_dir, "events"), "value", [0, 10, 20, 50])


@query("cumsum", """SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS cumsum FROM events""")
def cumsum(spark, sf_dir):
    rows = aggregate.cumulative_sum(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value")
    return rows.select("event_id", "user_id", F.round("cumsum", 4).alias("cumsum"))


@query("rolling", """SELECT event_id, count(value) OVER w AS rolling_n, round(sum(value) OVER w, 4) AS rolling_sum, round(avg(value) OVER w, 4) AS rolling_mean
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling(spark, sf_dir):
    rows = aggregate.rolling(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value", 5)
    return rows.select("event_id", "rolling_n", F.round("rolling_sum", 4).alias("rolling_sum"), F.round("rolling_mean", 4).alias("rolling_mean"))


def _extreme(name: str, order: str, greatest: bool):
    @query(name, f"""WITH r AS (SELECT l_returnflag, l_extendedprice, l_orderkey AS position,
        row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice {order}, l_orderkey) AS r FROM lineitem)
        SELECT l_returnflag, l_extendedprice, position FROM r WHERE r = 1""")
    def run(spark, sf_dir):
        return aggregate.arg_extreme(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_orderkey", greatest=greatest)

    return run


_extreme("argmin_first", "", False)
_extreme("argmax_first", "DESC", True)


@query("unique_rows", """WITH u AS (SELECT l_returnflag, l_linestatus, min(l_orderkey) AS ia FROM lineitem GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (ORDER BY l_returnflag, l_linestatus) - 1 AS INT) AS ic FROM u""")
def unique_rows(spark, sf_dir):
    return select.unique_rows(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey")


@query("unique_members", """SELECT member FROM (SELECT c_nationkey AS member FROM customer UNION SELECT s_nationkey FROM supplier)""")
def unique_members(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.array("c_nationkey").alias("a"))
    return select.unique_members(a.union(read(spark, sf_dir, "supplier").select(F.array("s_nationkey"))), "a")


@query("sort_with_index", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank, o_totalprice, o_orderkey AS ix FROM orders")
def sort_with_index(spark, sf_dir):
    return select.sort_with_index(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


@query("sortrows_desc", """SELECT row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal DESC, c_custkey DESC) - 1 AS rank, c_custkey FROM customer""")
def sortrows_desc(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", "c_custkey")
    return select.sort_rows(rows, rows.columns, descending=True).select("rank", "c_custkey")


@query("group_sum", "SELECT l_suppkey, round(sum(l_quantity), 2) AS sum FROM lineitem GROUP BY l_suppkey")
def group_sum(spark, sf_dir):
    coo = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))
    return select_sum(aggregate.sparse_sum(coo, 1))


def select_sum(df):
    return df.select(F.col("j").alias("l_suppkey"), F.round("sum", 2).alias("sum"))


@query("std_by_col", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd_quantity, round(stddev_samp(l_extendedprice), 4) AS sd_price FROM lineitem GROUP BY l_returnflag")
def std_by_col(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return rows.agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd_quantity"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd_price"))


@query("moments", """SELECT event_type, count(value) AS n, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
    round(avg(value * value), 4) AS moment2, round(stddev_samp(value) / sqrt(count(value)), 6) AS error,
    round(sum(user_id * value), 2) AS weighted_sum, round(sum(user_id * value) / sum(user_id), 6) AS weighted_mean FROM events GROUP BY event_type""")
def moments(spark, sf_dir):
    found = aggregate.moments(read(spark, sf_dir, "events"), ["event_type"], "value", "user_id")
    places = {"sum": 4, "mean": 6, "moment2": 4, "error": 6, "weighted_sum": 2, "weighted_mean": 6}
    return found.withColumns({c: F.round(c, n) for c, n in places.items()})


@query("shape_moments", """SELECT event_type, round((avg(power(value - m, 3))) / power(avg(power(value - m, 2)), 1.5), 4) AS skewness,
    round(avg(power(value - m, 4)) / power(avg(power(value - m, 2)), 2) - 3, 4) AS kurtosis
    FROM events JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) USING (event_type) GROUP BY event_type""")
def shape_moments(spark, sf_dir):
    found = aggregate.shape(read(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"))


@query("tail_values", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS rank FROM events)
    SELECT event_type, value, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def tail_values(spark, sf_dir):
    return aggregate.tail(read(spark, sf_dir, "events"), ["event_type"], "value", 5)


@query("intersect_multiplicity", "SELECT s_nationkey AS k FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def intersect_multiplicity(spark, sf_dir):
    a = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return select.intersect_with_multiplicity(a, read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), "k")


@query("repmat", "SELECT n_nationkey + 25 * c AS n_nationkey, n_name FROM nation, range(3) r(c)")
def repmat(spark, sf_dir):
    return select.repmat(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), 3, "n_nationkey", 25)


@query("densify", """WITH c AS (SELECT n_regionkey AS i, n_nationkey AS j, 1.0 AS v FROM nation)
    SELECT a.i, b.j, coalesce(c.v, 0.0)::DOUBLE AS v FROM range(5) a(i) CROSS JOIN range(25) b(j) LEFT JOIN c ON c.i = a.i AND c.j = b.j""")
def densify(spark, sf_dir):
    coo = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("i"), F.col("n_nationkey").cast("long").alias("j"), F.lit(1.0).alias("v"))
    return select.densify(coo, 5, 25)


@query("subsets", """SELECT [a.r_regionkey, b.r_regionkey, c.r_regionkey] AS members FROM region a, region b, region c
    WHERE a.r_regionkey < b.r_regionkey AND b.r_regionkey < c.r_regionkey""")
def subsets(spark, sf_dir):
    return combinatorics.subset_rows(read(spark, sf_dir, "region"), "r_regionkey", 3)


@query("graph_degree", "SELECT o_custkey AS src, count(*) AS degree FROM orders GROUP BY o_custkey")
def graph_degree(spark, sf_dir):
    return graph.degrees(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")))


@query("graph_bandwidth", "SELECT max(abs(o_custkey - o_orderkey)) AS bandwidth FROM orders")
def graph_bandwidth(spark, sf_dir):
    return graph.bandwidth(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")))


def _spread(steps: int) -> str:
    """c<n>: the least label within n steps."""
    out = ["c0 AS MATERIALIZED (SELECT DISTINCT a AS id, a AS c FROM u)"]
    for n in range(steps):
        out.append(f"c{n + 1} AS MATERIALIZED (SELECT x.id, least(any_value(x.c), min(y.c)) AS c FROM c{n} x JOIN u ON u.a = x.id JOIN c{n} y ON y.id = u.b GROUP BY x.id)")
    return ", ".join(out)


@query(
    "graph_components",
    f"""WITH e AS MATERIALIZED (SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem), u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
    {_spread(16)} SELECT id, c AS component FROM c16""",
)
def graph_components(spark, sf_dir):
    """Suppliers and parts that orders link; sixteen steps of labels reach as far as these components do."""
    rows = read(spark, sf_dir, "lineitem")
    return connected_components(rows.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")).distinct())


@query(
    "graph_components_orders",
    """SELECT id, min(c) OVER (PARTITION BY k) AS component FROM (SELECT o_custkey AS id, o_custkey AS c, o_custkey AS k FROM (SELECT DISTINCT o_custkey FROM orders)
        UNION ALL SELECT o_orderkey + 10000000, o_orderkey + 10000000, o_custkey FROM orders)""",
)
def graph_components_orders(spark, sf_dir):
    """Each customer with all orders: stars, some of them large."""
    rows = read(spark, sf_dir, "orders")
    return connected_components(rows.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 10000000).alias("dst")))
