"""Operators on n-dimensional arrays in long form: one row per cell, integer coordinates, blanks NULL or absent.

Neighbourhoods are reached by sending each cell's value to the cells around it: a narrow explode and one
aggregation by coordinate, so no window spans the array and no cell is joined with all others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import cut, discard
from ..plans.skew import spread_join
from ..plans.table import positions
from .statistics import sigma_clip, sigma_clip_array

XY = ("x", "y")


def offsets(dims: int, connectivity: int | None = None) -> list[tuple[int, ...]]:
    """Steps to neighbours that differ along at most ``connectivity`` axes (all, if None)."""
    return [d for d in product((-1, 0, 1), repeat=dims) if 0 < sum(map(bool, d)) <= (connectivity or dims)]


def box(widths: Sequence[int]) -> list[tuple[int, ...]]:
    """Steps to the cells of a box; an even length looks one further back than ahead."""
    spans = [range(-(w // 2), w - w // 2) for w in widths]
    return list(product(*spans))


def send(cells: DataFrame, steps: Sequence[tuple[int, ...]], dims: Sequence[str] = XY, carry: Sequence[str] = ("v",)) -> DataFrame:
    """Every cell's ``carry`` columns at the cells from which it is seen by one of ``steps``, with the step's number."""
    each = F.explode(F.array(*[F.struct(*[F.lit(int(s)).alias(f"d{i}") for i, s in enumerate(step)], F.lit(k).alias("step")) for k, step in enumerate(steps)]))
    far = cells.select(*dims, *carry, each.alias("_s"))
    return far.select(*[(F.col(d) - F.col(f"_s.d{i}")).alias(d) for i, d in enumerate(dims)], *carry, F.col("_s.step").alias("step"))


def collapse(cells: DataFrame, axis: str, how: str, dims: Sequence[str] = XY, weight: str | None = None) -> DataFrame:
    """One axis reduced by sum, mean (weighted if asked for), number, min or max."""
    v = F.col("v").cast("double")
    w = F.when(v.isNotNull(), F.col(weight)) if weight else None
    how_ = {"sum": F.sum(v), "mean": F.sum(v * w) / F.sum(w) if weight else F.avg(v), "number": F.count(v).cast("int"), "min": F.min("v"), "max": F.max("v")}[how]
    return cells.groupBy(*[d for d in dims if d != axis]).agg(how_.alias("v"))


def moving_filter(cells: DataFrame, widths: Sequence[int], how: str, dims: Sequence[str] = XY, clip: tuple[float, float] = (3.0, 0.2)) -> DataFrame:
    """mean, median, sigclip-mean or sigclip-median of the box around each cell; it is cut off at the edges."""
    seen = send(cells, box(widths), dims).join(cells.select(*dims), list(dims), "left_semi")
    if how in ("mean", "median"):
        return seen.groupBy(*dims).agg((F.avg if how == "mean" else F.median)("v").alias("v"))
    which = how.removeprefix("sigclip-")

    @F.pandas_udf("double")
    def clipped(values):
        import pandas as pd

        k = {"median": 1, "mean": 2}[which]
        return pd.Series([sigma_clip_array(np.asarray(v, dtype=float), *clip)[k] for v in values])

    # a box holds a fixed number of values at most
    return seen.groupBy(*dims).agg(F.collect_list("v").alias("_vs")).select(*dims, F.when(F.size("_vs") > 0, clipped("_vs")).alias("v"))


def erode(cells: DataFrame, connectivity: int = 1, dims: Sequence[str] = XY) -> DataFrame:
    """A set cell (v = 1) that touches an unset one becomes unset; outside the array nothing touches."""
    touched = send(cells.where("v = 0"), offsets(len(dims), connectivity), dims).select(*dims).distinct().withColumn("_t", F.lit(1))
    return cells.join(touched, list(dims), "left").select(*dims, F.when(F.col("_t") == 1, 0).otherwise(F.col("v")).alias("v"))


def dilate(cells: DataFrame, connectivity: int = 1, dims: Sequence[str] = XY) -> DataFrame:
    touched = send(cells.where("v = 1"), offsets(len(dims), connectivity), dims).select(*dims).distinct().withColumn("_t", F.lit(1))
    return cells.join(touched, list(dims), "left").select(*dims, F.when(F.col("_t") == 1, 1).otherwise(F.col("v")).alias("v"))


def opening(cells: DataFrame, depth: int = 1, connectivity: int = 1, dims: Sequence[str] = XY) -> DataFrame:
    for _ in range(depth):
        cells = erode(cells, connectivity, dims)
    for _ in range(depth):
        cells = dilate(cells, connectivity, dims)
    return cells


#: Cells of the blocks that are labelled in one task each, by the number of axes.
BLOCK_CELLS = 4096


def _block_roots(on: np.ndarray, connectivity: int) -> np.ndarray:
    """For each cell of a block the place of the least set cell of its component; the array's size where unset.

    Least places spread to neighbours and jump to their place's place.
    """
    none = on.size
    root = np.where(on, np.arange(on.size).reshape(on.shape), none)
    whole = [slice(1, -1)] * on.ndim
    steps = [tuple(slice(1 + d, n + 1 + d) for d, n in zip(step, on.shape)) for step in offsets(on.ndim, connectivity)]
    while True:
        wide = np.full([n + 2 for n in on.shape], none)
        wide[tuple(whole)] = root
        low = np.minimum.reduce([root, *(wide[s] for s in steps)])
        low = np.append(low.ravel(), none)
        low = np.where(on, low[low[:-1]].reshape(on.shape), none)
        if (low == root).all():
            return root
        root = low


def block_components(on: DataFrame, connectivity: int, dims: Sequence[str], side: int) -> DataFrame:
    """``dims`` and root of the cells of ``on``, each block on its own; blocks are the parallel unit."""
    names = list(dims)
    kinds = {d: on.schema[d].dataType.simpleString() for d in names}
    blocks = [f"_b{k}" for k in range(len(names))]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        origin = [int(g[b].iloc[0]) * side for b in blocks]
        local = tuple(g[d].to_numpy() - o for d, o in zip(reversed(names), reversed(origin)))  # the first axis runs fastest
        cells = np.zeros([side] * len(names), bool)
        cells[local] = True
        place = np.unravel_index(_block_roots(cells, connectivity)[local], cells.shape)
        return g[names].assign(**{f"_r{k}": p + o for k, (p, o) in enumerate(zip(reversed(place), origin))})

    d = on.select(*names, *[F.floor(F.col(n) / side).cast("int").alias(b) for n, b in zip(names, blocks)])
    schema = ", ".join([f"`{n}` {kinds[n]}" for n in names] + [f"_r{k} {kinds[n]}" for k, n in enumerate(names)])
    found = d.groupBy(*blocks).applyInPandas(run, schema)
    return found.select(*names, F.struct(*[F.col(f"_r{k}").alias(n) for k, n in reversed(list(enumerate(names)))]).alias("root"))


def least_linked(links: DataFrame) -> DataFrame:
    """(cell, root): the least cell that each is linked to; ``links`` (cell, from) holds every link both ways.

    Least roots spread along the links and then jump to their root's root, so the rounds grow with the
    logarithm of a chain's length; each round is written, and the next starts from there.
    """
    state = cut(links.select("cell").distinct().select("cell", F.col("cell").alias("root")), "roots")
    total = state.count()
    while True:
        near = links.join(state.select(F.col("cell").alias("from"), F.col("root").alias("near")), "from").groupBy("cell").agg(F.min("near").alias("near"))
        lower = cut(state.join(near, "cell", "left").select("cell", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")), "roots")
        jump = lower.select(F.col("cell").alias("root"), F.col("root").alias("further"))
        # one component may hold most cells
        jumped = cut(spread_join(lower, jump, "root", "cell", total=total).select("cell", "old", F.col("further").alias("root")), "roots")
        discard(state, lower)
        state = jumped
        if state.where("old <> root").isEmpty():
            return state.select("cell", "root")


def label_components(on: DataFrame, connectivity: int | None = None, dims: Sequence[str] = XY, side: int | None = None) -> DataFrame:
    """``dims`` and root, the least cell of the component in raster order, for the cells of ``on``.

    Blocks of ``side`` cells along each axis are labelled on their own.  What meets across their rims links
    the blocks' components.
    """
    names = list(dims)
    side = side or max(2, int(BLOCK_CELLS ** (1 / len(names))))
    own = cut(block_components(on, connectivity or len(names), names, side), "blocks")
    at = lambda n: F.pmod(F.col(n), F.lit(side))
    rim = own.where(reduce(lambda x, y: x | y, [(at(n) == 0) | (at(n) == side - 1) for n in names]))
    seen = send(rim.withColumnRenamed("root", "from"), offsets(len(names), connectivity), names, ("from",))
    links = cut(seen.join(rim, names).where("from <> root").select(F.col("root").alias("cell"), "from").distinct(), "links")
    if links.isEmpty():
        return own
    state = least_linked(links)
    joined = spread_join(own.withColumnRenamed("root", "cell"), state.select("cell", "root"), "cell", names[0], "left")
    return joined.select(*names, F.coalesce("root", "cell").alias("root"))


def connected_components(cells: DataFrame, connectivity: int | None = None, dims: Sequence[str] = XY) -> DataFrame:
    """``dims`` and label: components of the set cells numbered from 1 in raster order, 0 elsewhere."""
    names = list(dims)
    rooted = label_components(cells.where("v = 1"), connectivity, dims)
    roots = rooted.select("root").distinct()
    raster = [F.col("root").getField(d) for d in reversed(list(dims))]  # the first axis runs fastest
    numbered = positions(roots.withColumns({f"_{k}": c for k, c in enumerate(raster)}), [f"_{k}" for k in range(len(raster))]).select("root", F.col("_at").alias("label"))
    named = spread_join(rooted, numbered, "root", names[0]).select(*dims, "label")
    return cells.select(*dims).join(named, list(dims), "left").select(*dims, F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def fill_holes(cells: DataFrame, connectivity: int = 1, dims: Sequence[str] = XY, most: int | None = None) -> DataFrame:
    """Unset components that don't reach the array's edge become set; at most of the size ``most``, if given."""
    ends = cells.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    rooted = label_components(cells.where("v = 0"), connectivity, dims).join(F.broadcast(ends))
    edge = None
    for d in dims:
        at = (F.col(d) == F.col(f"lo_{d}")) | (F.col(d) == F.col(f"hi_{d}"))
        edge = at if edge is None else edge | at
    holes = rooted.groupBy("root").agg(F.max(edge).alias("open"), F.count("*").alias("size")).where("not open")
    if most is not None:
        holes = holes.where(F.col("size") <= most)
    filled = rooted.join(holes, "root", "left_semi").select(*dims).withColumn("_h", F.lit(1))
    return cells.join(filled, list(dims), "left").select(*dims, F.when(F.col("_h") == 1, 1).otherwise(F.col("v")).alias("v"))


def invert(c: Column, bits: int) -> Column:
    """The greatest value of an unsigned type minus ``c``."""
    return F.lit(2**bits - 1) - c


def interpolate_neighbours(cells: DataFrame, number: int, how: str, dims: Sequence[str] = XY, metric: str = "radial", only_blank: bool = True, start: int = 2, values: Sequence[str] = ("v",)) -> DataFrame:
    """Blanks become the min, max or median of their ``number`` nearest non-blank cells.

    All of ``values`` are blank where the first is, and filled from the same cells.

    The radius doubles until a blank has enough cells within it, or until it spans the array; boxes as
    wide as the radius make the search an equality.
    """
    names = list(dims)
    agg = {"min": F.min, "max": F.max, "median": F.median}[how]
    full = cut(cells.where(F.col(values[0]).isNotNull()).select(*names, *values), "full")
    todo = cut((cells.where(F.col(values[0]).isNull()) if only_blank else cells).select(*names), "blanks")
    ends = cells.agg(*[(F.max(d) - F.min(d)).alias(d) for d in names]).head()
    span = sum(int(ends[d] or 0) for d in names) + 1
    number = min(number, full.count())
    done, half = None, start
    steps = list(product((-1, 0, 1), repeat=len(names)))
    while number and not todo.isEmpty():
        # boxes as wide as the radius: what a blank may see lies in its own box and those around
        at = lambda d: F.floor(F.col(d) / half)  # noqa: E731, B023
        boxes = F.explode(F.array(*[F.struct(*[(at(d) + F.lit(i)).alias(f"b{k}") for k, (d, i) in enumerate(zip(names, step))]) for step in steps]))
        seen = todo.withColumn("_b", boxes).select(*names, "_b.*")
        near = full.select(*[F.col(d).alias(f"s{k}") for k, d in enumerate(names)], *values, *[at(d).alias(f"b{k}") for k, d in enumerate(names)])
        apart = [F.abs(F.col(d) - F.col(f"s{k}")).cast("double") for k, d in enumerate(names)]
        r = F.sqrt(sum((x * x for x in apart), F.lit(0.0))) if metric == "radial" else sum(apart, F.lit(0.0))
        found = seen.join(near, [f"b{k}" for k in range(len(names))]).withColumn("r", r).where(F.col("r") <= half)
        ranked = found.withColumn("k", F.row_number().over(W.partitionBy(*names).orderBy("r", *[f"s{k}" for k in range(len(names))]))).where(F.col("k") <= number)
        got = cut(ranked.groupBy(*names).agg(*[agg(v).alias(v) for v in values], F.count("*").alias("n")).where(F.col("n") >= number).drop("n"), "filled")
        done = got if done is None else done.unionByName(got)
        if half > span:
            break
        rest = cut(todo.join(got.select(*names), names, "left_anti"), "blanks")
        discard(todo)
        todo = rest
        half *= 2
    if done is None:
        return cells
    fill = done.withColumnsRenamed({v: f"_{v}" for v in values})
    out = cells.join(fill, names, "left")
    return out.select(*names, *[(F.coalesce(v, f"_{v}") if only_blank else F.coalesce(f"_{v}", v)).alias(v) for v in values])


def interpolate_region(cells: DataFrame, how: str, connectivity: int | None = None, dims: Sequence[str] = XY) -> DataFrame:
    """Every connected region of blanks gets the min or max of the cells that touch it."""
    names = list(dims)
    regions = label_components(cells.where(F.col("v").isNull()), connectivity, dims)
    rim = send(cells.where(F.col("v").isNotNull()), offsets(len(names), connectivity), names).join(regions, names)
    fill = rim.groupBy("root").agg((F.min if how == "min" else F.max)("v").alias("_f"))
    filled = regions.join(fill, "root", "left").select(*names, "_f")
    return cells.join(filled, names, "left").select(*names, F.coalesce("v", "_f").alias("v"))


def convolve(cells: DataFrame, kernel: dict[tuple[int, ...], float], dims: Sequence[str] = XY, edge_correction: bool = True, flip: bool = True) -> DataFrame:
    """The kernel-weighted mean around each cell; blanks and what lies outside are left out of the weights."""
    steps = list(kernel)
    weights = F.array(*[F.lit(float(kernel[s])) for s in steps])
    looked = [tuple(-x for x in s) for s in steps] if flip else steps
    seen = send(cells.where(F.col("v").isNotNull()), looked, dims).withColumn("w", F.element_at(weights, F.col("step") + 1))
    total = F.sum(F.col("v") * F.col("w"))
    out = seen.groupBy(*dims).agg((F.try_divide(total, F.sum("w")) if edge_correction else total / float(sum(kernel.values()))).alias("v"))
    return cells.select(*dims).join(out, list(dims), "left")


def tile_id(widths: Sequence[int], dims: Sequence[str] = XY, first: int = 1) -> Column:
    """Which tile of a regular tessellation a cell lies in, as text of the tile's coordinates."""
    return F.concat_ws(",", *[F.floor((F.col(d) - first) / w).cast("string") for d, w in zip(dims, widths)])


def tile_statistics(cells: DataFrame, widths: Sequence[int], aggregates: Sequence[Column], dims: Sequence[str] = XY) -> DataFrame:
    t = [F.floor((F.col(d) - 1) / w).alias(f"t{d}") for d, w in zip(dims, widths)]
    return cells.select(*t, "v").groupBy(*[f"t{d}" for d in dims]).agg(*aggregates)


def sky(cells: DataFrame, widths: Sequence[int], clip: tuple[float, float] = (3.0, 0.2), most: float = 0.005, neighbours: int = 5, smooth: int = 3, dims: Sequence[str] = XY, least_fraction: float | None = None) -> DataFrame:
    """Background and its deviation by tiles: (tx, ty, sky, std).

    A tile serves if its mean lies at nearly the quantile of its median; it is sigma-clipped, the others
    are filled from their neighbours, and the tiles smoothed by a flat box.  With ``least_fraction`` the
    cells carry ``detected``, and a tile serves if enough of it is undetected.
    """
    tiles = [f"t{d}" for d in dims]
    own = cells.select(*[F.floor((F.col(d) - 1) / w).alias(t) for d, w, t in zip(dims, widths, tiles)], "v", *(["detected"] if least_fraction is not None else []))
    everywhere = own.select(*tiles).distinct()
    if least_fraction is not None:
        free = own.groupBy(*tiles).agg((F.count(F.when(~F.col("detected"), 1)) / F.count("*")).alias("share")).where(F.col("share") > least_fraction)
        good = own.where(~F.col("detected")).join(free, tiles, "left_semi")
    else:
        mean = own.groupBy(*tiles).agg(F.avg("v").alias("m"), F.count("v").alias("n"))
        below = own.join(mean, tiles).groupBy(*tiles).agg((F.count(F.when(F.col("v") <= F.col("m"), 1)) / F.greatest(F.first("n"), F.lit(1))).alias("q")).where(F.abs(F.col("q") - 0.5) <= most)
        good = own.join(below, tiles, "left_semi")
    clipped = sigma_clip(good, tiles, "v", *clip).where(F.col("std") > 0)
    out = everywhere
    for source, name in (("mean", "sky"), ("std", "std")):
        layer = everywhere.join(clipped.select(*tiles, F.col(source).alias("v")), tiles, "left")
        layer = interpolate_neighbours(layer, neighbours, "median", tiles, start=1)
        layer = moving_filter(layer, [smooth] * len(tiles), "mean", tiles) if smooth > 1 else layer
        out = out.join(layer.withColumnRenamed("v", name), tiles, "left")
    return out


def stack(images: Sequence[DataFrame], dims: Sequence[str] = XY, axis: str = "z") -> DataFrame:
    """Images as the slices of a new axis, counted from 1."""
    out = None
    for k, image in enumerate(images, 1):
        layer = image.select(*dims, F.lit(k).alias(axis), "v")
        out = layer if out is None else out.unionByName(layer)
    return out


def combine(images: Sequence[DataFrame], how: str, dims: Sequence[str] = XY, q: float = 0.5, clip: tuple[float, float] = (3.0, 0.2)) -> DataFrame:
    """Cell by cell over images: min, max, number, sum, mean, std, median, quantile or a sigclip- statistic."""
    v = F.col("v")
    simple: dict[str, Callable[[], Column]] = {"min": lambda: F.min(v), "max": lambda: F.max(v), "number": lambda: F.count(v), "sum": lambda: F.sum(v), "mean": lambda: F.avg(v), "std": lambda: F.stddev_pop(v), "median": lambda: F.median(v)}
    cells = stack(images, dims)
    if how in simple:
        return cells.groupBy(*dims).agg(simple[how]().alias("v"))
    if how == "quantile":
        ordered = cells.where(v.isNotNull()).groupBy(*dims).agg(F.sort_array(F.collect_list("v")).alias("_vs"))  # as many as images
        return ordered.select(*dims, F.element_at("_vs", (F.ceil((F.size("_vs") - 1) * q - 0.5) + 1).cast("int")).alias("v"))
    return sigma_clip(cells, list(dims), "v", *clip).select(*dims, F.col(how.removeprefix("sigclip-")).alias("v"))


def contour(cells: DataFrame, level: float, dims: Sequence[str] = XY) -> DataFrame:
    """Cells above a level that touch one at or below it."""
    low = send(cells.where(F.col("v") <= level), offsets(len(dims), 1), dims).select(*dims).distinct()
    return cells.where(F.col("v") > level).join(low, list(dims), "left_semi")
