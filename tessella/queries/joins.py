"""Positional matching and queries by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sky
from ..operators import match as mt
from ..plans.remote import RemoteQuery
from .registry import query, table


def _pair_sql(left: str, right: str, dist: str, limit: float) -> str:
    """Each right row keeps its nearest left row; each left row the nearest of the right rows that chose it."""
    return (
        f"WITH a AS ({left}), b AS ({right}), p AS (SELECT a.id AS a_id, b.id AS b_id, a.c0 AS a0, b.c0 AS b0, {dist} AS r FROM a, b WHERE {dist} < {limit}),"
        " q AS (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY r, a0, a_id) AS k FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY r, b0, b_id) AS m FROM q WHERE k = 1)"
    )


_A1 = "SELECT s_suppkey AS id, s_acctbal AS c0 FROM supplier"
_B1 = "SELECT c_custkey AS id, c_acctbal AS c0 FROM customer"
_A2 = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS c0, p_retailprice / 10 AS c1 FROM part WHERE p_partkey % 2 = 0"
_B2 = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS c0, p_retailprice / 10 AS c1 FROM part WHERE p_partkey % 2 = 1"
_A3 = "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS c0, CAST(embedding[2] AS DOUBLE) AS c1, CAST(embedding[3] AS DOUBLE) AS c2 FROM embeddings WHERE label % 2 = 0"
_B3 = _A3.replace("% 2 = 0", "% 2 = 1")
_D1 = "abs(a.c0 - b.c0)"
_D2 = "sqrt((a.c0-b.c0)*(a.c0-b.c0)+(a.c1-b.c1)*(a.c1-b.c1))"
_D3 = "sqrt((a.c0-b.c0)*(a.c0-b.c0)+(a.c1-b.c1)*(a.c1-b.c1)+(a.c2-b.c2)*(a.c2-b.c2))"
_OUT = " SELECT a_id, b_id, round(r, 9) AS dist FROM s WHERE m = 1"


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("c0"), (F.col("p_retailprice") / 10).alias("c1"))
    return p.where("id % 2 = 0"), p.where("id % 2 = 1")


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[k].cast("double").alias(f"c{k}") for k in range(3)])
    return e.where("label % 2 = 0"), e.where("label % 2 = 1")


def _rounded(m):
    return m.withColumn("dist", F.round("dist", 9))


@query("match_1d", _pair_sql(_A1, _B1, _D1, 0.8) + _OUT)
def match_1d(spark, sf_dir):
    return _rounded(mt.match(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), ["s_acctbal"], ["c_acctbal"], "s_suppkey", "c_custkey", [0.8]))


@query("match_2d_circle", _pair_sql(_A2, _B2, _D2, 0.9) + _OUT)
def match_2d_circle(spark, sf_dir):
    a, b = _parts(spark, sf_dir)
    return _rounded(mt.match(a, b, ["c0", "c1"], ["c0", "c1"], "id", "id", [0.9]))


@query("match_2d_ellipse", _pair_sql(_A2, _B2, "sqrt((a.c0-b.c0)*(a.c0-b.c0)+(a.c1-b.c1)*(a.c1-b.c1)*16)", 1.2) + _OUT)
def match_2d_ellipse(spark, sf_dir):
    a, b = _parts(spark, sf_dir)
    return _rounded(mt.match(a, b, ["c0", "c1"], ["c0", "c1"], "id", "id", [1.2, 0.3]))


@query("match_2d_rotated", _pair_sql(_A2, _B2, "sqrt(pow((a.c0-b.c0)*cos(radians(30.0))+(a.c1-b.c1)*sin(radians(30.0)),2)+pow(((a.c1-b.c1)*cos(radians(30.0))-(a.c0-b.c0)*sin(radians(30.0)))/0.5,2))", 1.5) + _OUT)
def match_2d_rotated(spark, sf_dir):
    a, b = _parts(spark, sf_dir)
    return _rounded(mt.match(a, b, ["c0", "c1"], ["c0", "c1"], "id", "id", [1.5, 0.5, 30]))


@query("match_3d_sphere", _pair_sql(_A3, _B3, _D3, 0.12) + _OUT)
def match_3d_sphere(spark, sf_dir):
    a, b = _vectors(spark, sf_dir)
    return _rounded(mt.match(a, b, ["c0", "c1", "c2"], ["c0", "c1", "c2"], "id", "id", [0.12]))


@query("match_3d_ellipsoid", _pair_sql(_A3, _B3, "sqrt((a.c0-b.c0)*(a.c0-b.c0)+(a.c1-b.c1)*(a.c1-b.c1)*4+(a.c2-b.c2)*(a.c2-b.c2)*16)", 0.2) + _OUT)
def match_3d_ellipsoid(spark, sf_dir):
    a, b = _vectors(spark, sf_dir)
    return _rounded(mt.match(a, b, ["c0", "c1", "c2"], ["c0", "c1", "c2"], "id", "id", [0.2, 0.1, 0.05]))


@query("match_notmatched", _pair_sql(_A2, _B2, _D2, 0.9) + " SELECT id, 'a' AS side FROM a WHERE id NOT IN (SELECT a_id FROM s WHERE m = 1) UNION ALL SELECT id, 'b' FROM b WHERE id NOT IN (SELECT b_id FROM s WHERE m = 1)")
def match_notmatched(spark, sf_dir):
    a, b = _parts(spark, sf_dir)
    m = mt.match(a, b, ["c0", "c1"], ["c0", "c1"], "id", "id", [0.9])
    left = mt.not_matched(a, "id", m, "a_id").select("id", F.lit("a").alias("side"))
    return left.unionByName(mt.not_matched(b, "id", m, "b_id").select("id", F.lit("b").alias("side")))


@query("match_merged_columns", _pair_sql(_A1, _B1, _D1, 0.8) + " SELECT s_name, c_name, c_acctbal, round(r, 9) AS dist FROM s JOIN supplier ON s_suppkey = a_id JOIN customer ON c_custkey = b_id WHERE m = 1")
def match_merged_columns(spark, sf_dir):
    a, b = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    m = mt.match(a, b, ["s_acctbal"], ["c_acctbal"], "s_suppkey", "c_custkey", [0.8])
    return _rounded(mt.merged(a, b, m, "s_suppkey", "c_custkey", ["as_name", "bc_name", "bc_acctbal"]))


@query("match_point", f"SELECT id AS a_id, round(sqrt((c0-20)*(c0-20)+(c1-100)*(c1-100)), 9) AS dist FROM ({_A2}) WHERE sqrt((c0-20)*(c0-20)+(c1-100)*(c1-100)) < 5 ORDER BY dist, c0, id LIMIT 1")
def match_point(spark, sf_dir):
    return _rounded(mt.match_point(_parts(spark, sf_dir)[0], ["c0", "c1"], "id", [20, 100], [5]))


@query("nearest_neighbour", f"SELECT a_id, b_id, dist FROM (SELECT a.id AS a_id, b.id AS b_id, round({_D2}, 9) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.c0, b.id) AS k FROM ({_A2}) a, ({_B2}) b) WHERE k = 1")
def nearest_neighbour(spark, sf_dir):
    a, b = _parts(spark, sf_dir)
    return _rounded(mt.nearest_neighbour(a, b, ["c0", "c1"], ["c0", "c1"], "id", "id", 1.0))


_RADEC = "SELECT c_custkey, (c_custkey * 7.3) % 360 AS ra, (c_acctbal % 90) AS dec FROM customer"


def _positions(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * F.lit(7.3) % 360).alias("ra"), (F.col("c_acctbal") % 90).alias("dec"))


@query("cone_search", f"SELECT c_custkey FROM ({_RADEC}) WHERE degrees(2*asin(sqrt(least(1.0, pow(sin(radians(dec-30)/2),2)+cos(radians(dec))*cos(radians(30.0))*pow(sin(radians(ra-180)/2),2))))) < 15")
def cone_search(spark, sf_dir):
    return _positions(spark, sf_dir).where(sky.in_cone(F.col("ra"), F.col("dec"), 180.0, 30.0, 15.0)).select("c_custkey")


@query("box_search_closed_range", f"SELECT c_custkey FROM ({_RADEC}) WHERE abs(ra - 180) <= 20 AND abs(dec - 30) <= 10")
def box_search_closed_range(spark, sf_dir):
    p = _positions(spark, sf_dir)
    return p.where(sky.in_box(F.col("ra"), F.col("dec"), 180.0, 30.0, 40.0, 20.0) & F.col("dec").between(20.0, 40.0)).select("c_custkey")


@query("remote_query_on_table", f"SELECT c_custkey, round(CAST(ra AS DOUBLE), 6) AS ra FROM ({_RADEC}) WHERE degrees(2*asin(sqrt(least(1.0, pow(sin(radians(dec-30)/2),2)+cos(radians(dec))*cos(radians(30.0))*pow(sin(radians(ra-180)/2),2))))) < 25 AND dec >= 20 AND dec <= 40")
def remote_query_on_table(spark, sf_dir):
    q = RemoteQuery("edr3", center=(180.0, 30.0), radius=25.0, columns=["c_custkey", "ra"], ranges=[("dec", 20, 40)])
    return q.on(_positions(spark, sf_dir)).withColumn("ra", F.round("ra", 6))


@query("remote_query_text", "SELECT 'SELECT ra, dec FROM gaiaedr3.gaia_source WHERE 1=CONTAINS(POINT(''ICRS'', ra, dec), BOX(''ICRS'', 180, 45, 360, 90)) AND parallax>=' || CAST(min(c_nationkey) AS VARCHAR) || ' AND parallax<=' || CAST(max(c_nationkey) AS VARCHAR) AS text FROM customer")
def remote_query_text(spark, sf_dir):
    """The query for what lies around a table's own positions and values."""
    from ..plans.remote import around

    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 0 + F.when(F.col("c_custkey") % 2 == 0, 0.0).otherwise(360.0)).alias("ra"), F.when(F.col("c_custkey") % 3 == 0, 0.0).otherwise(90.0).alias("dec"), F.col("c_nationkey").alias("parallax"))
    q = around(c, "edr3", "ra", "dec", columns=["ra", "dec"], ranges=["parallax"])
    return spark.createDataFrame([(q.text(),)], "text string")
