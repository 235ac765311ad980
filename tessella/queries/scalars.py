"""One query for each token of column arithmetic, over lineitem."""

from __future__ import annotations

from ..functions import rpn, sky
from .registry import ORACLES, QUERIES, table

#: name -> (tokens, SQL of the result rounded as the query rounds it)
F8 = "round({}, 6)"
TOKENS: dict[str, tuple[str, str]] = {
    "plus": ("$l_quantity $l_tax +", F8.format("l_quantity + l_tax")),
    "minus": ("$l_extendedprice $l_quantity -", F8.format("l_extendedprice - l_quantity")),
    "multiply": ("l_extendedprice 1.0 l_discount - x", F8.format("l_extendedprice * (1.0 - l_discount)")),
    "divide": ("l_extendedprice l_quantity / 1000000 x int64", "CAST(trunc(l_extendedprice / l_quantity * 1000000) AS BIGINT)"),
    "divide_integers": ("l_partkey l_linenumber /", "CAST(l_partkey // l_linenumber AS BIGINT)"),
    "modulo": ("l_partkey 7 %", "CAST(l_partkey % 7 AS BIGINT)"),
    "abs": ("l_quantity 25 - abs", F8.format("abs(l_quantity - 25)")),
    "pow": ("l_discount 2 pow", F8.format("pow(l_discount, 2)")),
    "sqrt": ("l_extendedprice sqrt", F8.format("sqrt(l_extendedprice)")),
    "log": ("l_extendedprice log", F8.format("ln(l_extendedprice)")),
    "log10": ("l_extendedprice log10", F8.format("log10(l_extendedprice)")),
    "lt": ("l_quantity 10 lt", "CAST(l_quantity < 10 AS INTEGER)"),
    "le": ("l_quantity 10 le", "CAST(l_quantity <= 10 AS INTEGER)"),
    "gt": ("l_quantity 10 gt", "CAST(l_quantity > 10 AS INTEGER)"),
    "ge": ("l_quantity 10 ge", "CAST(l_quantity >= 10 AS INTEGER)"),
    "eq": ("l_linenumber 3 eq", "CAST(l_linenumber = 3 AS INTEGER)"),
    "ne": ("l_linenumber 3 ne", "CAST(l_linenumber <> 3 AS INTEGER)"),
    "and": ("l_linenumber 1 - l_discount and", "CAST(l_linenumber <> 1 AND l_discount <> 0 AS INTEGER)"),
    "or": ("l_linenumber 1 eq l_linenumber 3 eq or", "CAST(l_linenumber = 1 OR l_linenumber = 3 AS INTEGER)"),
    "not": ("l_linenumber 2 % not", "CAST(l_linenumber % 2 = 0 AS INTEGER)"),
    "isblank": ("l_quantity l_quantity 40 gt nan where isblank", "CAST(l_quantity > 40 AS INTEGER)"),
    "where": ("l_quantity l_discount 0.05 gt 0 where", F8.format("CASE WHEN l_discount > 0.05 THEN 0 ELSE l_quantity END")),
    "bitand": ("l_partkey 12 bitand", "CAST(l_partkey & 12 AS BIGINT)"),
    "bitor": ("l_partkey 12 bitor", "CAST(l_partkey | 12 AS BIGINT)"),
    "bitxor": ("l_partkey 12 bitxor", "CAST(xor(l_partkey, 12) AS BIGINT)"),
    "lshift": ("l_linenumber 3 lshift", "CAST(l_linenumber * 8 AS BIGINT)"),
    "rshift": ("l_partkey 2 rshift", "CAST(l_partkey // 4 AS BIGINT)"),
    "bitnot": ("l_linenumber uint8 bitnot", "CAST(255 - l_linenumber AS BIGINT)"),
    "uint8": ("l_extendedprice uint8", "CASE WHEN l_extendedprice BETWEEN 0 AND 255 THEN CAST(trunc(l_extendedprice) AS SMALLINT) END"),
    "int8": ("l_quantity int8", "CAST(trunc(l_quantity) AS TINYINT)"),
    "uint16": ("l_extendedprice uint16", "CASE WHEN l_extendedprice BETWEEN 0 AND 65535 THEN CAST(trunc(l_extendedprice) AS INTEGER) END"),
    "int16": ("l_extendedprice int16", "CASE WHEN l_extendedprice BETWEEN -32768 AND 32767 THEN CAST(trunc(l_extendedprice) AS SMALLINT) END"),
    "uint32": ("l_extendedprice uint32", "CAST(trunc(l_extendedprice) AS BIGINT)"),
    "int32": ("l_extendedprice int32", "CAST(trunc(l_extendedprice) AS INTEGER)"),
    "int64": ("l_extendedprice int64", "CAST(trunc(l_extendedprice) AS BIGINT)"),
    "uint64": ("l_extendedprice uint64 int64", "CAST(trunc(l_extendedprice) AS BIGINT)"),
    "float32": ("l_linenumber float32", "CAST(l_linenumber AS FLOAT)"),
    "float64": ("l_linenumber float64", "CAST(l_linenumber AS DOUBLE)"),
    "named_stack": ("l_quantity set-q q q x q +", F8.format("l_quantity * l_quantity + l_quantity")),
    "distance_flat": ("l_quantity l_linenumber 3 4 distance-flat", F8.format("sqrt((l_quantity-3)*(l_quantity-3)+(l_linenumber-4)*(l_linenumber-4))")),
    "distance_on_sphere": (
        "l_quantity l_linenumber 3 4 distance-on-sphere",
        F8.format("degrees(2*asin(sqrt(least(1.0, pow(sin(radians(l_linenumber-4.0)/2),2)+cos(radians(CAST(l_linenumber AS DOUBLE)))*cos(radians(4.0))*pow(sin(radians(l_quantity-3)/2),2)))))"),
    ),
    "ra_roundtrip": ("l_quantity 7.03 x degree-to-ra ra-to-degree 1000 x 0.5 + int64", "CAST(trunc(l_quantity * 7.03 * 1000 + 0.5) AS BIGINT)"),
    "dec_roundtrip": ("l_quantity 1.61 x 40 - degree-to-dec dec-to-degree 40 + 1000 x 0.5 + int64", "CAST(trunc(l_quantity * 1.61 * 1000 + 0.5) AS BIGINT)"),
}


def _register(name: str, tokens: str, sql: str) -> None:
    from pyspark.sql import functions as F

    def run(spark, sf_dir):
        df = table(spark, sf_dir, "lineitem")
        c = rpn.evaluate(df, tokens)[-1]
        return df.select("l_orderkey", "l_linenumber", (F.round(c, 6) if sql.startswith("round(") else c).alias("result"))

    QUERIES[f"rpn_{name}"] = run
    ORACLES[f"rpn_{name}"] = f"SELECT l_orderkey, l_linenumber, {sql} AS result FROM lineitem"


for _name, (_tokens, _sql) in TOKENS.items():
    _register(_name, _tokens, _sql)


def rpn_world_image(spark, sf_dir):
    """A pixel position to the sky and back."""
    from pyspark.sql import functions as F

    plane = sky.TangentPlane.scaled((50.0, 50.0), (180.0, 30.0), (-0.01, 0.01))
    df = table(spark, sf_dir, "lineitem")
    x, y = rpn.evaluate(df, "l_quantity l_linenumber imgtowcs wcstoimg", plane)
    return df.select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


QUERIES["rpn_world_image"] = rpn_world_image
ORACLES["rpn_world_image"] = "SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS x, round(CAST(l_linenumber AS DOUBLE), 6) AS y FROM lineitem"
