"""Joins whose rows may crowd on a few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds more than one in so many rows (or one in as many as there are shuffle partitions) is dealt out.
HOT = 256


def hot_keys(rows: DataFrame, key: str, counts: DataFrame | None = None, total: int | None = None) -> list[tuple]:
    """(key, deals) of the keys with more than their share of ``rows``, and over how many tasks each is dealt.

    There are at most as many such keys as the share's denominator, so they may be collected and broadcast.
    ``counts`` (key, _n) and ``total`` are given where they are known already.
    """
    parts = max(HOT, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = rows.count() if total is None else total
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")) if counts is None else counts
    counts = counts.where((F.col("_n") * parts > total) & F.col(key).isNotNull())
    found = counts.select(key, F.ceil(F.col("_n") * parts / F.lit(max(total, 1))).cast("int")).collect()
    return [tuple(r) for r in found if r[1] > 1]


def _listed(rows: DataFrame, key: str, hot: list[tuple], name: str) -> DataFrame:
    return rows.sparkSession.createDataFrame(hot, f"`{key}` {rows.schema[key].dataType.simpleString()}, {name} int")


def spread_join(rows: DataFrame, side: DataFrame, key: str, deal_by: str, how: str = "inner", counts: DataFrame | None = None, total: int | None = None, hot: list[tuple] | None = None) -> DataFrame:
    """``rows`` joined with ``side`` on ``key``, in which hot keys of ``rows`` are dealt out by ``deal_by``.

    ``hot`` are the ``hot_keys`` of rows that are joined again and again.  Without it and ``counts``, ``rows`` is read
    twice and should be cheap to read.  ``side`` is repeated only for hot keys, as often as they are dealt; the list
    of these keys is bounded and broadcast.
    """
    hot = hot_keys(rows, key, counts, total) if hot is None else hot
    if not hot:
        return rows.join(side, key, how)
    listed = F.broadcast(_listed(rows, key, hot, "_deals"))
    deals = F.coalesce(F.col("_deals"), F.lit(1))
    left = rows.join(listed, key, "left").withColumn("_deal", F.pmod(F.xxhash64(deal_by), deals).cast("int")).drop("_deals")
    right = side.join(listed, key, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_deals")
    return left.join(right, [key, "_deal"], how).drop("_deal")


def counted_join(rows: DataFrame, side: DataFrame, key: str, deal_by: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` on ``key``, where both tell in ``_n`` how many of ``total`` rows have had their key.

    Hot keys of ``rows`` are dealt out by ``deal_by`` as in ``spread_join``, but each row knows its deals by itself, so
    none meets a list of hot keys.  ``rows`` may have lost rows since they were counted.
    """
    parts = max(HOT, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    deals = F.greatest(F.ceil(F.col("_n") * parts / F.lit(max(total, 1))), F.lit(1)).cast("int")
    left = rows.withColumn("_deal", F.pmod(F.xxhash64(deal_by), deals).cast("int"))
    right = side.withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_n")
    return left.join(right, [key, "_deal"], how).drop("_deal")


def spread_both(left: DataFrame, right: DataFrame, key: str, by_left: str, by_right: str) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, where either side may crowd on it.

    A hot key's rows are dealt out on a grid, those of ``left`` by rows and those of ``right`` by columns, and repeated
    along the other axis, so that each pair meets once.  Both sides are read twice and should be cheap to read.
    """
    of_left, of_right = hot_keys(left, key), hot_keys(right, key)
    if not of_left and not of_right:
        return left.join(right, key)
    hot = F.broadcast(_listed(left, key, of_left, "_rows").join(_listed(right, key, of_right, "_columns"), key, "full"))  # two bounded lists
    rows, columns = F.coalesce(F.col("_rows"), F.lit(1)), F.coalesce(F.col("_columns"), F.lit(1))
    own = lambda by, n: F.pmod(F.xxhash64(by), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = left.join(hot, key, "left").withColumn("_row", own(by_left, rows)).withColumn("_column", every(columns)).drop("_rows", "_columns")
    b = right.join(hot, key, "left").withColumn("_column", own(by_right, columns)).withColumn("_row", every(rows)).drop("_rows", "_columns")
    return a.join(b, [key, "_row", "_column"]).drop("_row", "_column")
