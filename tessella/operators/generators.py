"""Profiles on a grid, noise, and transformations of values and shapes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut


def grid(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """All cells (x, y) from 1, made by one range."""
    return spark.range(nx * ny).select((F.col("id") % nx + 1).cast("int").alias("x"), (F.floor(F.col("id") / nx) + 1).cast("int").alias("y"))


def elliptical_radius(dx: Column, dy: Column, q: Column, pa: Column) -> Column:
    c, s = F.cos(F.radians(pa)), F.sin(F.radians(pa))
    along, across = dx * c + dy * s, (dy * c - dx * s) / q
    return F.sqrt(along * along + across * across)


def sersic_b(n: Column) -> Column:
    return 2 * n - 1.0 / 3 + 0.009876 / n


def profile_value(kind: Column, r: Column, width: Column, n: Column) -> Column:
    """Unnormalised value at elliptical radius ``r``: width is the effective radius, or the full width at half maximum."""
    gauss = F.exp(-r * r / (2 * F.pow(width / (2 * math.sqrt(2 * math.log(2))), F.lit(2.0))))
    alpha = width / (2 * F.sqrt(F.pow(F.lit(2.0), 1 / n) - 1))
    moffat = F.pow(1 + F.pow(r / alpha, F.lit(2.0)), -n)
    sersic = F.exp(-sersic_b(n) * (F.pow(r / width, 1 / n) - 1))
    return F.when(kind == "gaussian", gauss).when(kind == "moffat", moffat).when(kind == "sersic", sersic).when(kind.isin("flat", "circum"), F.lit(1.0)).when(kind == "distance", r)


def profiles(catalogue: DataFrame, nx: int, ny: int, zeropoint: float = 0.0, circum_width: float = 1.0, replace: bool = False, custom: Sequence[tuple[float, float, float]] = ()) -> DataFrame:
    """(x, y, v): the profiles of (id, cx, cy, kind, width, n, pa, q, mag, trunc) merged on a canvas.

    Each profile makes its own box of pixels by arithmetic, so no profile meets pixels it doesn't touch.
    Each is scaled to the brightness of its magnitude; ``trunc`` is in units of the width.  The kind custom has
    the value of the first of the rings ``custom`` (from, to, value) that the radius falls in, and 0 elsewhere.
    """
    reach = F.when(F.col("kind") == "point", F.lit(0.0)).otherwise(F.col("width") * F.col("trunc"))
    c = catalogue.withColumn("reach", reach)
    span = lambda mid, most: F.sequence(F.greatest(F.ceil(F.col(mid) - F.col("reach") - 0.5), F.lit(1)).cast("int"), F.least(F.floor(F.col(mid) + F.col("reach") + 0.5), F.lit(most)).cast("int"))
    inside = c.where((F.col("cx") + F.col("reach") + 0.5 >= 1) & (F.col("cx") - F.col("reach") - 0.5 <= nx) & (F.col("cy") + F.col("reach") + 0.5 >= 1) & (F.col("cy") - F.col("reach") - 0.5 <= ny))

    def pixels(c: DataFrame) -> DataFrame:
        """Each profile's pixels, with their unnormalised values."""
        p = c.withColumn("x", F.explode(span("cx", nx))).withColumn("y", F.explode(span("cy", ny)))
        p = p.withColumn("r", elliptical_radius(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("q"), F.col("pa")))
        point = (F.col("kind") == "point") & (F.col("x") == F.round("cx")) & (F.col("y") == F.round("cy"))
        p = p.where(F.when(F.col("kind") == "point", point).when(F.col("kind") == "circum", (F.col("r") <= F.col("reach")) & (F.col("r") > F.col("reach") - circum_width)).otherwise(F.col("r") <= F.col("reach")))
        ring = F.lit(0.0)
        for low, high, value in reversed(custom):
            ring = F.when((F.col("r") >= low) & (F.col("r") < high), F.lit(float(value))).otherwise(ring)
        p = p.withColumn("raw", F.when(F.col("kind") == "custom", ring))
        return p.withColumn("raw", F.coalesce("raw", profile_value(F.col("kind"), F.col("r"), F.col("width"), F.col("n")), F.lit(1.0)))

    parts = int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few profiles make many pixels
    totals = pixels(inside.repartition(parts, "id")).groupBy("id").agg(F.sum("raw").alias("total"))
    brightness = F.pow(F.lit(10.0), (zeropoint - F.col("mag")) / 2.5)
    value = F.when(F.col("kind") == "distance", F.col("raw")).otherwise(F.col("raw") * F.col("scale"))
    # the catalogue meets the totals, not its pixels, and lies by place, so that overlapping pixels are summed where they are made
    scaled = cut(inside.join(totals, "id").withColumn("scale", brightness / F.col("total")).repartitionByRange(parts, "cy", "cx"), "profiles")
    each = pixels(scaled).select("x", "y", "id", value.alias("v"))
    return each.groupBy("x", "y").agg((F.max_by("v", "id") if replace else F.sum("v")).alias("v"))


def add_noise(cells: DataFrame, sigma: float | None = None, background: float = 0.0, instrumental: float = 0.0, seed: int = 1) -> DataFrame:
    """Gaussian noise of a fixed deviation, or of the background, the instrument and the signal."""
    z = F.randn(seed)
    v = F.col("v") + z * sigma if sigma is not None else F.lit(background) + F.col("v") + z * F.sqrt(F.greatest(instrumental**2 + background + F.col("v"), F.lit(0.0)))
    return cells.withColumn("v", v)


def change_values(c: Column, changes: Sequence[tuple[float, float]], low: float | None = None, high: float | None = None, after: bool = False) -> Column:
    """Values mapped one to another and truncated to a range, in either order."""

    def changed(x: Column) -> Column:
        out = F.when(F.lit(False), x)
        for a, b in changes:
            out = out.when(x == a, F.lit(b))
        return out.otherwise(x)

    def truncated(x: Column) -> Column:
        x = F.when(x < low, F.lit(low)).otherwise(x) if low is not None else x
        return F.when(x > high, F.lit(high)).otherwise(x) if high is not None else x

    return changed(truncated(c)) if after else truncated(changed(c))


def to_byte(cells: DataFrame, maxbyte: int = 255, inverted: bool = False) -> DataFrame:
    """Values scaled to 0..maxbyte; blanks become 0, or the maximum when inverted."""
    ends = cells.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    scaled = ((F.col("v") - F.col("_lo")) * maxbyte / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).cast("int")
    scaled = F.coalesce(scaled, F.lit(0))
    return cells.join(F.broadcast(ends)).withColumn("v", maxbyte - scaled if inverted else scaled).drop("_lo", "_hi")


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (0..360), saturation and value (0..1) of colours from 0 to 1."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    d = F.nullif(most - least, F.lit(0.0))
    hue = F.when(most == r, F.pmod((g - b) / d, F.lit(6.0))).when(most == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return F.coalesce(hue, F.lit(0.0)), F.coalesce((most - least) / F.nullif(most, F.lit(0.0)), F.lit(0.0)), most


def polygon_area(vertices: Column) -> Column:
    """Signed area of an array of (x, y) structs; counter-clockwise is positive."""
    n = F.size(vertices)
    cross = F.transform(vertices, lambda p, i: p["x"] * F.get(vertices, (i + 1) % n)["y"] - F.get(vertices, (i + 1) % n)["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, t: s + t) / 2


def box_overlap(a: Sequence[Column], b: Sequence[Column]) -> tuple[list[Column], Column]:
    """(x1, x2, y1, y2) common to two boxes, and whether there is any."""
    out = [F.greatest(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.least(a[3], b[3])]
    return out, (out[0] <= out[1]) & (out[2] <= out[3])


def crop_catalogue(cells: DataFrame, centres: DataFrame, width: int) -> DataFrame:
    """(id, x, y, v) of the box around each centre (id, cx, cy), by an equality on the boxes' cells."""
    half = width // 2
    span = lambda c: F.explode(F.sequence((F.round(c) - half).cast("int"), (F.round(c) + (width - half) - 1).cast("int")))
    wanted = centres.withColumn("x", span("cx")).withColumn("y", span("cy")).select("id", "x", "y")
    return wanted.join(cells, ["x", "y"]).select("id", "x", "y", "v")


# warping


def warp_matrix(steps: Sequence[tuple]) -> list[list[float]]:
    """The 3x3 matrix of steps applied in order: rotate, scale, flip, shear, translate, project or matrix."""
    m = [[float(i == j) for j in range(3)] for i in range(3)]
    for name, *v in steps:
        if name == "rotate":
            c, s = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
            t = [[c, -s, 0], [s, c, 0], [0, 0, 1]]
        elif name == "scale":
            t = [[v[0], 0, 0], [0, v[-1], 0], [0, 0, 1]]
        elif name == "flip":
            t = [[-1 if v[0] else 1, 0, 0], [0, -1 if v[-1] else 1, 0], [0, 0, 1]]
        elif name == "shear":
            t = [[1, v[0], 0], [v[-1], 1, 0], [0, 0, 1]]
        elif name == "translate":
            t = [[1, 0, v[0]], [0, 1, v[-1]], [0, 0, 1]]
        elif name == "project":
            t = [[1, 0, 0], [0, 1, 0], [v[0], v[-1], 1]]
        elif name == "matrix":
            t = v[0]
        else:
            raise ValueError(f"unknown step {name}")
        m = [[sum(t[i][k] * m[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return m


def warp_scale(cells: DataFrame, sx: float, sy: float, covered: float = 1.0) -> DataFrame:
    """Area-weighted resampling by an axis-aligned scale; a cell less than ``covered`` by input cells is blank.

    Every input cell is dealt to the output cells it overlaps with the overlapping area as its weight.
    """
    lo = lambda c, s: (F.col(c) - 1) * s
    hi = lambda c, s: F.col(c) * s
    cellspan = lambda c, s: F.explode(F.sequence((F.floor(lo(c, s)) + 1).cast("int"), F.greatest(F.ceil(hi(c, s)), F.floor(lo(c, s)) + 1).cast("int")))
    d = cells.withColumn("ox", cellspan("x", sx)).withColumn("oy", cellspan("y", sy))
    part = lambda c, o, s: F.greatest(F.least(hi(c, s), F.col(o)) - F.greatest(lo(c, s), F.col(o) - 1), F.lit(0.0))
    d = d.withColumn("w", part("x", "ox", sx) * part("y", "oy", sy)).where("w > 0")
    area = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    per = 1.0 / (sx * sy)
    return d.groupBy(F.col("ox").alias("x"), F.col("oy").alias("y")).agg(F.when(area >= covered - 1e-9, F.sum(F.col("v") * F.col("w")) * per).alias("v"))


def _clipped_area(xs: np.ndarray, ys: np.ndarray, left: float, low: float) -> float:
    """Area of a convex polygon inside the unit cell with the given corner, cut by its four sides in turn."""
    points = list(zip(xs, ys))
    for axis, side, sign in ((0, left, 1), (0, left + 1, -1), (1, low, 1), (1, low + 1, -1)):
        kept = []
        for a, b in zip(points, points[1:] + points[:1]):
            da, db = sign * (a[axis] - side), sign * (b[axis] - side)
            if da >= 0:
                kept.append(a)
            if da * db < 0:
                t = da / (da - db)
                kept.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        points = kept
        if not points:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def warp(cells: DataFrame, steps: Sequence[tuple], covered: float = 1.0) -> DataFrame:
    """Area-weighted resampling by any of the steps; brightness is kept.

    A cell's corners are mapped, the output cells in their bounding box are the only candidates, and the
    overlap is that of the mapped polygon with each.  Output cells less than ``covered`` are blank.
    """
    m = warp_matrix(steps)

    def mapped(x: Column, y: Column) -> tuple[Column, Column]:
        w = m[2][0] * x + m[2][1] * y + m[2][2]
        return (m[0][0] * x + m[0][1] * y + m[0][2]) / w, (m[1][0] * x + m[1][1] * y + m[1][2]) / w

    corners = [mapped(F.col("x") - i, F.col("y") - j) for i, j in ((1, 1), (0, 1), (0, 0), (1, 0))]
    d = cells.withColumns({"_px": F.array(*[c[0] for c in corners]), "_py": F.array(*[c[1] for c in corners])})
    span = lambda c: F.explode(F.sequence((F.floor(F.array_min(c)) + 1).cast("int"), F.greatest(F.ceil(F.array_max(c)), F.floor(F.array_min(c)) + 1).cast("int")))
    d = d.withColumn("ox", span("_px")).withColumn("oy", span("_py"))

    @F.pandas_udf("double")
    def overlap(px: pd.Series, py: pd.Series, ox: pd.Series, oy: pd.Series) -> pd.Series:
        return pd.Series([_clipped_area(a, b, i - 1, j - 1) for a, b, i, j in zip(px, py, ox, oy)])

    corner = lambda i: F.struct(F.get("_px", F.lit(i)).alias("x"), F.get("_py", F.lit(i)).alias("y"))
    d = d.withColumns({"w": overlap("_px", "_py", "ox", "oy"), "whole": F.abs(polygon_area(F.array(*map(corner, range(4)))))})
    area = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    return d.groupBy(F.col("ox").alias("x"), F.col("oy").alias("y")).agg(F.sum("w").alias("_any"), F.when(area >= covered - 1e-9, F.sum(F.col("v") * F.col("w") / F.col("whole"))).alias("v")).where("_any > 1e-9").drop("_any")


# new arrays and colours


def make_new(spark: SparkSession, sizes: Sequence[int], dims: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """An array of zeros, one row a cell, the first axis running fastest."""
    if not sizes or any(s < 1 for s in sizes) or len(sizes) > len(dims):
        raise ValueError("an array has one to three axes of at least one cell")
    out, below = [], 1
    for d, n in zip(dims, sizes):
        out.append((F.floor(F.col("id") / below) % n + 1).cast("int").alias(d))
        below *= n
    return spark.range(below).select(*out, F.lit(0.0).alias("v"))


def coordinates(index: Column, sizes: Sequence[int]) -> list[Column]:
    """The coordinates, from 0 and fastest last, of a place in an array counted from 0."""
    out, below = [], 1
    for n in reversed(sizes):
        out.append(F.floor(index / below) % n)
        below *= n
    return out[::-1]


def index_of(coords: Sequence[Column], sizes: Sequence[int]) -> Column:
    """The place, from 0, of coordinates from 0 and fastest last."""
    total = F.lit(0).cast("long")
    for c, n in zip(coords, sizes):
        total = total * n + c
    return total


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Colours from 0 to 1 of hue (degrees), saturation and value."""

    def part(k: float) -> Column:
        m = F.pmod(F.lit(k) + h / 60, F.lit(6.0))
        return v - v * s * F.greatest(F.least(m, 4 - m, F.lit(1.0)), F.lit(0.0))

    return part(5.0), part(3.0), part(1.0)


def color_map(c: Column, low: Column, high: Column, name: str = "gray", hues: tuple[float, float] = (0.0, 360.0)) -> tuple[Column, Column, Column]:
    """Red, green and blue (0 to 1) of a value between two others: ``gray``, a circle of hues (``hsv``) or ``heat``."""
    t = F.least(F.greatest((c - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    t = F.coalesce(t, F.lit(0.0))
    if name == "gray":
        return t, t, t
    if name == "hsv":
        return hsv_to_rgb(hues[0] + t * (hues[1] - hues[0]), F.lit(1.0), F.lit(1.0))
    if name == "heat":
        ramp = lambda k: F.least(F.greatest(3 * t - k, F.lit(0.0)), F.lit(1.0))
        return ramp(0), ramp(1), ramp(2)
    raise ValueError(f"no colour map {name!r}")


def permute(df: DataFrame, at: str, order: DataFrame, inverse: bool = False) -> DataFrame:
    """Rows moved: where ``order`` (place, source) says so, a place takes the row of its source; or the other way round."""
    a, b = ("source", "place") if not inverse else ("place", "source")
    return df.join(order.select(F.col(a).alias(at), F.col(b).alias("_to")), at).withColumn(at, F.col("_to")).drop("_to")


def align_steps(cd: Sequence[Sequence[float]]) -> list[tuple]:
    """Warp steps after which the axes of an image with this matrix run along the sky's, first leftward, at the same scale."""
    (a, b), (c, d) = cd
    scale = math.sqrt(abs(a * d - b * c))
    return [("matrix", [[-a / scale, -b / scale, 0.0], [c / scale, d / scale, 0.0], [0.0, 0.0, 1.0]])]
