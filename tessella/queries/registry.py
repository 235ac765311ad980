"""The two dictionaries, and the decorator that fills them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its SQL if it has any."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def clip_sql(rows: str, keys: list[str], multiple: float, rounds: int) -> str:
    """CTEs, the last of them ``clipped`` (keys, number, median, mean, std), of sigma clipping by a number of rounds; rows: keys and v."""
    k = ", ".join(keys)
    stats = f"SELECT {k}, count(v) AS size, median(v) AS med, avg(v) AS mean, stddev_pop(v) AS std FROM {{}} GROUP BY {k}"
    inside = f"v > med - {multiple} * std AND v < med + {multiple} * std"
    out = [f"r0 AS (SELECT * FROM ({rows}) WHERE v IS NOT NULL)", f"s0 AS ({stats.format('r0')})"]
    for i in range(1, rounds):
        out += [f"r{i} AS (SELECT r{i - 1}.* FROM r{i - 1} JOIN s{i - 1} USING ({k}) WHERE {inside})", f"t{i} AS ({stats.format(f'r{i}')})"]
        # a group with nothing left keeps its last values
        out.append(f"s{i} AS (SELECT {k}, coalesce(t.size, s.size) AS size, coalesce(t.med, s.med) AS med, coalesce(t.mean, s.mean) AS mean, coalesce(t.std, s.std) AS std FROM s{i - 1} s LEFT JOIN t{i} t USING ({k}))")
    last = rounds - 1
    out.append(f"e AS (SELECT {k}, count(*) AS n FROM r{last} JOIN s{last} USING ({k}) WHERE {inside} GROUP BY {k})")
    out.append(f"clipped AS (SELECT {k}, CASE WHEN size = 1 THEN 1 ELSE coalesce(n, 0) END AS number, med AS median, mean, std FROM s{last} LEFT JOIN e USING ({k}))")
    return "WITH " + ", ".join(out)
