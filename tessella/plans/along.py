"""Known values along an ordered column: their numbers, and the two that each blank lies between, for groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut, scratch

#: Known points of a block that is looked along, or solved, in one task.
BLOCK = 1 << 14


def placed(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """``df`` with ``_k``, the number from 0 of the last known point up to each row (-1 before the first).

    Rows are dealt out by range and the ranges' sums added up, so no task sees a whole group.
    """
    dealt = cut(df.repartitionByRange(*[F.col(f"`{c}`") for c in (*by, x)]).withColumn("_part", F.spark_partition_id()), "ranges")
    known = F.col(y).isNotNull().cast("long")
    sums = dealt.groupBy("_part", *by).agg(F.sum(known).alias("_s"))
    ahead = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(F.col("_part").alias("_p"), *[F.col(f"`{b}`").alias(f"_by{i}") for i, b in enumerate(by)], F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        on = on & F.col(f"`{b}`").eqNullSafe(F.col(f"_by{i}"))
    own = dealt.withColumn("_own", F.sum(known).over(W.partitionBy("_part", *by).orderBy(x).rowsBetween(W.unboundedPreceding, 0)))
    return own.join(before, on).select(*df.columns, (F.col("_before") + F.col("_own") - 1).alias("_k"))


def fill_between(df: DataFrame, x: str, y: str, by: Sequence[str], value: Callable[[Column, Column, Column], Column], slope: Callable[[Callable[[int], Column]], Column] | None = None, reach: int = 0, block: int | None = None) -> DataFrame:
    """Blanks of ``y`` between two known points become ``value(x, a, b)`` of these, structs of x, y and, from ``slope(at)``, s.

    ``at(k)`` is the k-th known point after the one whose slope is asked, a NULL struct beyond the ends; k is ``reach`` at most.
    Known points are looked along by blocks, each with those around it that its slopes reach; blanks alone then meet the
    two points they lie between, and those beyond the known ones stay blank.
    """
    by, block = list(by), max(block or BLOCK, reach + 1)
    with scratch() as keep:
        rows = keep(cut(placed(df, x, y, by), "placed"))
    keys = [f"_by{i}" for i in range(len(by))]
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)], F.col("_k").alias("_a"), point.alias("n0"))
    own, place = F.floor(F.col("_a") / block), F.col("_a") % block
    blocks = F.array_compact(F.array(own, F.when((place <= reach) & (own > 0), own - 1), F.when(place >= block - reach, own + 1)))
    order = W.partitionBy(*keys, "_block").orderBy("_a")
    d = points.withColumn("_block", F.explode(blocks))
    if slope is not None:
        d = d.withColumns({f"n{k}": (F.lead("n0", k) if k > 0 else F.lag("n0", -k)).over(order) for k in range(-reach, reach + 1) if k})
        d = d.select(*keys, "_a", "_block", F.struct("n0.x", "n0.y", slope(lambda k: F.col(f"n{k}")).alias("s")).alias("n0"))
    spans = d.withColumn("n1", F.lead("n0").over(order)).where(F.col("_block") == F.floor(F.col("_a") / block)).select(*keys, "_a", "n0", "n1")
    on = F.col("_k") == F.col("_a")
    for b, k in zip(by, keys):
        on = on & F.col(f"`{b}`").eqNullSafe(F.col(k))
    whole = lambda c: [c.cast("double").alias(n) if n == y else F.col(f"`{n}`") for n in df.columns]
    filled = rows.where(F.col(y).isNull()).join(spans, on, "left").select(*whole(value(F.col(x), F.col("n0"), F.col("n1"))))
    return rows.where(F.col(y).isNotNull()).select(*whole(F.col(y))).unionByName(filled)
