"""Polygons as arrays of (x, y) structs, in any order of traversal unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import select
from .generators import polygon_area

POINTS = "array<struct<x:double,y:double>>"


def turns(vertices: Column) -> Column:
    """The cross product at each vertex: positive where the polygon turns left."""
    n = F.size(vertices)
    at = lambda i: F.get(vertices, F.pmod(i, n))
    return F.transform(vertices, lambda p, i: (p["x"] - at(i - 1)["x"]) * (at(i + 1)["y"] - p["y"]) - (p["y"] - at(i - 1)["y"]) * (at(i + 1)["x"] - p["x"]))


def is_convex(vertices: Column) -> Column:
    """Whether it never turns both ways."""
    t = turns(vertices)
    return ~(F.exists(t, lambda c: c > 0) & F.exists(t, lambda c: c < 0))


def is_counterclockwise(vertices: Column) -> Column:
    return polygon_area(vertices) > 0


def sort_counterclockwise(vertices: Column) -> Column:
    """The vertices by their angle about their mean."""
    mean = lambda d: F.aggregate(vertices, F.lit(0.0), lambda s, p: s + p[d]) / F.size(vertices)
    keyed = F.transform(vertices, lambda p: F.struct(F.atan2(p["y"] - mean("y"), p["x"] - mean("x")).alias("a"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda k: k["p"])


def clipped(subject: Iterable[tuple[float, float]], window: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    """What of a polygon lies inside a convex, counter-clockwise window, cut by one side after another."""
    points, window = list(subject), list(window)
    for (x1, y1), (x2, y2) in zip(window, window[1:] + window[:1]):
        side = lambda p: (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)  # noqa: B023, E731
        kept = []
        for a, b in zip(points, points[1:] + points[:1]):
            da, db = side(a), side(b)
            if da >= 0:
                kept.append(a)
            if da * db < 0:
                t = da / (da - db)
                kept.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        points = kept
    return points


def clip(subject: Column, window: Column) -> Column:
    """``clipped`` of two columns."""

    @F.pandas_udf(POINTS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = lambda ps: [(p["x"], p["y"]) for p in ps]
        return pd.Series([[{"x": x, "y": y} for x, y in clipped(pairs(s), pairs(w))] for s, w in zip(a, b)])

    return run(subject, window)


def section(cells: DataFrame, text: str, dims: Iterable[str] = ("x", "y")) -> DataFrame:
    """The part of an array that a section such as ``3:10,5:*`` names, counted from 1 again; ``*`` is the array's end, ``*-k`` k before it."""
    dims = list(dims)
    spans = [s.split(":") for s in text.split(",")]
    if len(spans) != len(dims) or any(len(s) != 2 for s in spans):
        raise ValueError(f"not a section of {len(dims)} axes: {text!r}")
    ends = cells.agg(*[F.max(d).alias(d) for d in dims]).head()

    def at(token: str, d: str, default: int) -> int:
        token = token.strip() or str(default)
        return (ends[d] or 0) + int(token[1:] or 0) if token.startswith("*") else int(token)

    for d, (low, high) in zip(dims, spans):
        first = at(low, d, 1)
        cells = cells.where(F.col(d).between(first, at(high, d, ends[d] or 0))).withColumn(d, F.col(d) - (first - 1))
    return cells


def polygon(cells: DataFrame, vertices: list[tuple[float, float]], outside: bool = False) -> DataFrame:
    """The bounding box of a polygon, with blanks where cells lie outside it; or all cells, with blanks inside it."""
    xs, ys = zip(*vertices)
    inside = select.in_polygon(F.col("x").cast("double"), F.col("y").cast("double"), vertices)
    if outside:
        return cells.withColumn("v", F.when(~inside, F.col("v")))
    box = F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys))
    return cells.where(box).withColumn("v", F.when(inside, F.col("v")))


def mosaic(images: list[tuple[DataFrame, int, int]]) -> DataFrame:
    """(x, y, v) of images laid on one plane, each moved by its own steps; where several meet, the first that isn't blank is seen."""
    laid = None
    for k, (cells, dx, dy) in enumerate(images):
        own = cells.select((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), "v", F.lit(k).alias("_k"))
        laid = own if laid is None else laid.unionByName(own)
    return laid.groupBy("x", "y").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("_k"))).alias("v"))
