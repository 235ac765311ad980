"""The table program: selection, order, arithmetic, concatenation, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select
from ..plans.table import TablePipeline, information
from .registry import query, table

POLYGON = [(5.0, 1000.0), (40.0, 950.0), (45.0, 1400.0), (25.0, 1150.0), (10.0, 1500.0)]
_WIND = " + ".join(
    f"CASE WHEN y >= {y1} AND y < {y2} AND ({x2}-({x1}))*(y-({y1}))-(x-({x1}))*({y2}-({y1})) > 0 THEN 1 WHEN y >= {y2} AND y < {y1} AND ({x2}-({x1}))*(y-({y1}))-(x-({x1}))*({y2}-({y1})) < 0 THEN -1 ELSE 0 END"
    for (x1, y1), (x2, y2) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]])
)


@query("table_pipeline", "SELECT l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice * (1.0 - l_discount), 6) AS net FROM lineitem WHERE l_quantity >= 5 AND l_quantity < 25 ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC LIMIT 10")
def table_pipeline(spark, sf_dir):
    """Range, sort, head and a computed column in one pipeline."""
    p = TablePipeline(columns=["l_orderkey,l_linenumber,l_extendedprice", "arith l_extendedprice 1.0 l_discount - x"], ranges=[("l_quantity", 5, 25)], sort="l_extendedprice", descending=True, head=10)
    df = table(spark, sf_dir, "lineitem")
    ordered = df.orderBy(F.desc("l_extendedprice"), F.desc("l_orderkey"), F.desc("l_linenumber"))
    out = TablePipeline(columns=p.columns, ranges=p.ranges, head=10).run(ordered)
    return out.withColumnRenamed("ARITH_1", "net").withColumn("net", F.round("net", 6))


@query("table_project", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem")
def table_project(spark, sf_dir):
    return TablePipeline(columns=["1", "/^l_(part|supp)key$/", "l_quantity"]).run(table(spark, sf_dir, "lineitem"))


@query("table_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount >= 0.02 AND l_discount < 0.06")
def table_range(spark, sf_dir):
    return TablePipeline(columns=["l_orderkey,l_linenumber"], ranges=[("l_quantity", 10, 20), ("l_discount", 0.02, 0.06)]).run(table(spark, sf_dir, "lineitem"))


@query("table_equal", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (1, 2, 3, 5, 7, 11, 13)")
def table_equal(spark, sf_dir):
    return TablePipeline(columns=["o_orderkey"], equal=[("o_orderstatus", "F", "P"), ("o_custkey", 1, 2, 3, 5, 7, 11, 13)]).run(table(spark, sf_dir, "orders"))


@query("table_notequal", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O')")
def table_notequal(spark, sf_dir):
    return TablePipeline(columns=["o_orderkey"], notequal=[("o_orderstatus", "O")]).run(table(spark, sf_dir, "orders"))


@query("table_inpolygon", f"SELECT p_partkey FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part) WHERE ({_WIND}) <> 0")
def table_inpolygon(spark, sf_dir):
    return TablePipeline(columns=["p_partkey"], inpolygon=("p_size", "p_retailprice", POLYGON)).run(table(spark, sf_dir, "part"))


@query("table_outpolygon", f"SELECT p_partkey FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part) WHERE ({_WIND}) = 0")
def table_outpolygon(spark, sf_dir):
    return TablePipeline(columns=["p_partkey"], outpolygon=("p_size", "p_retailprice", POLYGON)).run(table(spark, sf_dir, "part"))


@query("table_sort_tail", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def table_sort_tail(spark, sf_dir):
    return TablePipeline(columns=["o_orderkey,o_totalprice"], sort="o_totalprice", ties=["o_orderkey"], tail=25).run(table(spark, sf_dir, "orders"))


@query("table_sort_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def table_sort_head(spark, sf_dir):
    return TablePipeline(columns=["o_orderkey,o_totalprice"], sort="o_totalprice", ties=["o_orderkey"], head=25).run(table(spark, sf_dir, "orders"))


@query("table_catcolumn", 'SELECT a.o_orderkey, a.o_totalprice, c.c_name AS "c_name-1" FROM orders a LEFT JOIN customer c ON a.o_custkey = c.c_custkey')
def table_catcolumn(spark, sf_dir):
    """All orders beside a table of as many rows: the names of their customers, in the same order."""
    orders = table(spark, sf_dir, "orders")
    named = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")
    return TablePipeline(columns=["o_orderkey", "o_totalprice"], concat=[(named, ["c_name"])], concat_key="o_orderkey").run(orders)


@query("table_noblank", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 30")
def table_noblank(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.when(F.col("l_quantity") <= 30, F.col("l_quantity")))
    return TablePipeline(columns=["l_orderkey,l_linenumber,l_quantity"], noblank=["l_quantity"]).run(df)


@query("table_metadata", "SELECT l_orderkey AS order_id, l_quantity AS amount FROM lineitem")
def table_metadata(spark, sf_dir):
    p = TablePipeline(columns=["l_orderkey,l_quantity"], metadata=[("l_orderkey", "order_id", "count", "key"), ("2", "amount", "pieces", "quantity")])
    return p.run(table(spark, sf_dir, "lineitem"))


_LINEITEM = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


@query("table_information", "SELECT CAST(k AS INTEGER) AS \"column\", name, type, '' AS unit, '' AS comment FROM (VALUES " + ", ".join(f"({k}, '{n.split()[0]}', '{n.split()[1]}')" for k, n in enumerate(_LINEITEM.split(", "), 1)) + ") t(k, name, type)")
def table_information(spark, sf_dir):
    return information(table(spark, sf_dir, "lineitem"))


@query("table_search_ignorecase", "SELECT c_custkey, c_acctbal FROM customer")
def table_search_ignorecase(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select(*[n for a in ("C_CUSTKEY", "C_ACCTBAL") for n in select.resolve(df, a, ignorecase=True)])
