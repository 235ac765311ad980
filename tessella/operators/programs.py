"""Detection and segmentation as whole programs, on images of any size.

The image lies in blocks that are multiples of the tiles, so that thresholds, backgrounds and the opening of
pseudo-detections are maps; morphology and convolution share rims; components, their signal to noise and what becomes
of them are small tables by label.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, discard
from ..plans.table import positions
from . import grid, statistics
from .blocks import Arrays, Blocks, Place, dilated, eroded, of_cells, opened, reach, tiles_of, weighted, without_holes
from .detect import tile_outliers_local
from .watershed import flood, named, rivers, significance, spread

Kernel = dict[tuple[int, int], float]


@dataclass(frozen=True)
class Detection:
    """Settings of ``detections``."""

    tile: Sequence[int] = (50, 50)
    large: Sequence[int] = (200, 200)  # tiles in which holes of pseudo-detections are filled and these opened
    kernel: Kernel | None = None
    most: float = 0.005  # a tile serves if its mean's quantile is so near one half
    q: float = 0.3
    no_erode: float = 0.99
    grow_q: float = 0.9  # 1: no growth
    outlier_sigma: float = 10.0
    outlier_clip: tuple[float, float] = (3.0, 0.2)
    neighbours: int = 15
    smooth: int = 3
    erode: int = 2
    erode_reach: int = 1  # 1: four neighbours, 2: eight
    opening: int = 1
    opening_reach: int = 2
    least: float = 0.0  # deviations above the background that make a pseudo-detection
    hole_reach: int = 2
    pseudo_opening: int = 1
    pseudo_opening_reach: int = 2
    pseudo_reach: int = 2
    area: int = 10
    sn_q: float = 0.99
    cpscorr: float = 1.0
    hole_cells: int = 100
    clean: bool = True  # grown detections below the bound go
    free: float = 0.7  # a tile has a background of its own if more of it is undetected
    clip: tuple[float, float] = (3.0, 0.2)


def _quantile(sorted_: np.ndarray, q: float) -> float:
    return float(sorted_[statistics.rank_of_quantile(len(sorted_), q)])


def _quantile_of(sorted_: np.ndarray, at: float) -> float:
    """The quantile of a value within the range of sorted ones: that of the nearest element, ties upward."""
    below = int(np.searchsorted(sorted_, at, "right"))
    if below == len(sorted_):
        return np.inf
    index = below if sorted_[below] - at <= at - sorted_[below - 1] else below - 1
    return index / (len(sorted_) - 1)


def _filled(tiles: DataFrame, values: Sequence[str], s: Detection) -> DataFrame:
    """Blank tiles from their neighbours, then all smoothed by a flat box."""
    keys = ["tx", "ty"]
    full = cut(grid.interpolate_neighbours(tiles, s.neighbours, "median", keys, start=2, values=values), "tiles")
    if s.smooth <= 1:
        return full
    seen = grid.send(full, grid.box([s.smooth] * 2), keys, values).join(full.select(*keys), keys, "left_semi")
    return cut(seen.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values]), "tiles")


def _to_blocks(b: Blocks, tiles: DataFrame, s: Detection) -> DataFrame:
    """``tiles`` with bx, by of their blocks and i, j within them."""
    per = [b.layout.sx // s.tile[0], b.layout.sy // s.tile[1]]
    where = [F.floor(F.col(t) / n).cast("int").alias(n_) for t, n, n_ in zip(("tx", "ty"), per, ("bx", "by"))]
    within = [(F.col(t) % n).cast("int").alias(n_) for t, n, n_ in zip(("tx", "ty"), per, ("i", "j"))]
    return tiles.select("*", *where, *within)


def _per_cell(told: pd.DataFrame, names: Sequence[str], shape: tuple[int, int], tile: Sequence[int]) -> list[np.ndarray]:
    """The values of a block's tiles at each of its cells; blank where a tile has none."""
    out = []
    for n in names:
        a = np.full((-(-shape[0] // tile[1]), -(-shape[1] // tile[0])), np.nan)
        a[told["j"], told["i"]] = told[n]
        out.append(np.repeat(np.repeat(a, tile[1], axis=0), tile[0], axis=1)[: shape[0], : shape[1]])
    return out


def thresholded(b: Blocks, value: str, s: Detection) -> Blocks:
    """With the layers ``over`` (0, 1 above the tile's threshold, 2 above that of cells never eroded) and ``grows``."""
    names = ["t1", "t2", "t3"]

    def quantiles(a: Arrays, p: Place) -> pd.DataFrame:
        out = []
        for i, j, at in tiles_of(a[value].shape, s.tile):
            v = np.sort(a[value][at][~np.isnan(a[value][at])])
            good = len(v) > 1 and abs(_quantile_of(v, v.mean()) - 0.5) < s.most
            out.append((p.x // s.tile[0] + i, p.y // s.tile[1] + j, *([_quantile(v, q) for q in (s.q, s.no_erode, s.grow_q)] if good else [None] * 3)))
        return pd.DataFrame(out, columns=["tx", "ty", *names]).astype({n: float for n in names})

    tiles = cut(b.rows(quantiles, "tx int, ty int, t1 double, t2 double, t3 double"), "tiles")
    sound = tile_outliers_local(tiles.select("tx", "ty", "t1"), "t1", s.neighbours, s.outlier_sigma, s.outlier_clip)
    kept = sound.join(tiles.drop("t1"), ["tx", "ty"]).select("tx", "ty", "t1", *[F.when(F.col("t1").isNotNull(), F.col(n)).alias(n) for n in names[1:]])
    full = _filled(cut(kept, "tiles"), names, s)

    def apply(a: Arrays, p: Place, t: pd.DataFrame) -> Arrays:
        low, firm, grow = _per_cell(t, names, a[value].shape, s.tile)
        v = a[value]
        return {"over": np.where(v > low, 1 + (v > firm), 0), "grows": v > grow}

    return b.told(_to_blocks(b, full, s), apply, {"over": "u1", "grows": "u1"})


def with_background(b: Blocks, detected: str, s: Detection) -> tuple[Blocks, DataFrame]:
    """With the layers ``sky`` and ``std`` of each cell's tile, from its undetected cells; and these by tile."""

    def clipped(a: Arrays, p: Place) -> pd.DataFrame:
        out = []
        for i, j, at in tiles_of(a["v"].shape, s.tile):
            v = a["v"][at][(a[detected][at] == 0) & ~np.isnan(a["v"][at])]
            sky = std = None
            if len(v) > s.free * a["v"][at].size:
                _, _, sky, std = statistics.sigma_clip_array(v, *s.clip)
                sky, std = (sky, std) if std > 0 else (None, None)
            out.append((p.x // s.tile[0] + i, p.y // s.tile[1] + j, sky, std))
        return pd.DataFrame(out, columns=["tx", "ty", "sky", "std"]).astype({"sky": float, "std": float})

    tiles = cut(b.rows(clipped, "tx int, ty int, sky double, std double"), "tiles")
    full = _filled(tiles, ["sky", "std"], s)
    return b.told(_to_blocks(b, full, s), lambda a, p, t: dict(zip(("sky", "std"), _per_cell(t, ["sky", "std"], a["v"].shape, s.tile))), {"sky": "f8", "std": "f8"}), full


def pseudo_detections(b: Blocks, within: str, on_sky: bool, s: Detection) -> Blocks:
    """With the layer ``pseudo``: labels of what stands above the background, its holes filled and opened tile by tile.

    On the sky the detections count as set, so that what touches them can be told apart.
    """

    def find(a: Arrays, p: Place) -> Arrays:
        bright = a["v"] - a["sky"] > s.least * a["std"]
        on = (bright | (a[within] > 0) if on_sky else bright & (a[within] > 0)) & ~np.isnan(a["v"])
        out = np.zeros(on.shape, bool)
        for _, _, at in tiles_of(on.shape, s.large):
            out[at] = opened(without_holes(on[at], s.hole_reach), s.pseudo_opening, s.pseudo_opening_reach)
        return {"_on": out}

    return b.mapped(find, {"_on": "u1"}, tag="pseudo").labelled(lambda a: a["_on"] > 0, s.pseudo_reach, "pseudo")


def signal_to_noise(b: Blocks, label: str, tiles: DataFrame, s: Detection, but: str | None = None) -> DataFrame:
    """(label, sn) of labels large and bright enough; the deviation is that of the tile at the label's centre of flux.

    Labels that touch the labels ``but`` are left out.
    """

    def parts(a: Arrays, p: Place) -> pd.DataFrame:
        lab, v = a[label], a["v"]
        y, x = np.nonzero(lab > 0)
        over = (v - a["sky"])[y, x]
        known = ~np.isnan(over)
        up = np.where(known & (over > 0), over, 0.0)
        d = pd.DataFrame({"label": lab[y, x], "area": known.astype(np.int64), "flux": np.where(known, over, 0.0), "up": up, "ux": up * (x + p.x), "uy": up * (y + p.y), "other": (a[but][y, x] > 0).astype(np.int64) if but else np.zeros(len(y), np.int64)})
        return d.groupby("label", as_index=False).sum()

    sums = b.rows(parts, "label long, area long, flux double, up double, ux double, uy double, other long").groupBy("label").agg(*[F.sum(n).alias(n) for n in ("area", "flux", "up", "ux", "uy", "other")])
    ave = F.col("flux") / F.col("area")
    near = lambda c: F.floor(c) + (c - F.floor(c) > 0.5).cast("int")  # noqa: E731  (halves down)
    good = sums.where((F.col("other") == 0) & (F.col("area") > s.area) & (ave > 0) & (F.col("up") > 0))
    at = [F.floor(near(F.col(f"u{d}") / F.col("up")) / w).cast("int").alias(f"t{d}") for d, w in zip("xy", s.tile)]
    placed = good.select("label", "area", ave.alias("ave"), *at).join(tiles.select("tx", "ty", "std"), ["tx", "ty"])
    return placed.select("label", (F.sqrt(F.col("area") / s.cpscorr) * F.col("ave") / F.sqrt(F.col("ave") + F.col("std") * F.col("std"))).alias("sn"))


def _grown(b: Blocks, kept: str, s: Detection) -> Blocks | None:
    """With the layer ``label``: detections grown into all touching cells above the growth threshold, dilated and their small holes filled; None if none is."""
    more = b.rows(lambda a, p: pd.DataFrame({"n": [int(((a[kept] == 0) & (a["grows"] > 0) & ~np.isnan(a["v"])).sum())]}), "n long")
    if s.grow_q >= 1 or not more.agg(F.sum("n")).first()[0]:
        return None
    wide = b.labelled(lambda a: (a[kept] > 0) | (a["grows"] > 0), 2, "_region")
    holds = wide.rows(lambda a, p: pd.DataFrame({"label": (u := np.unique(a["_region"][a[kept] > 0]))[u > 0]}), "label long").distinct()
    wide = wide.painted("_region", holds.select("label", F.lit(1).alias("value")), "_grown", "u1")
    wide = wide.mapped(lambda a, p: {"_grown": dilated(a["_grown"] > 0, 1, p.outside(a["_grown"].shape))}, {"_grown": "u1"}, 1, ["_grown"], drop=["_region"])
    whole = wide.filled(lambda a: a["_grown"] > 0, 1, s.hole_cells, "_grown")
    out = whole.labelled(lambda a: a["_grown"] > 0, 2, "label")
    return out.mapped(lambda a, p: {"label": np.where(np.isnan(a["v"]), 0, a["label"])}, {"label": "i8"}, drop=["_grown"], tag="grown")


def detections(cells: DataFrame, s: Detection = Detection()) -> DataFrame:
    """x, y, label, sky, std: the detections of an image (x, y, v), numbered from 1 in raster order, and its background.

    Cells of the convolved image above their tile's quantile are eroded, but for those above the quantile of
    certain ones, and opened.  On the image itself, what stands above the background where nothing was detected gives
    the signal to noise that chance makes; a first detection stays if it holds a pseudo-detection above the
    quantile of that.  What stays grows down to a third quantile, and grown detections below the bound go.  Without
    any pseudo-detection on the sky there is no bound.  Blanks are never detected.
    """
    b = of_cells(cells, ["v"], [s.tile, s.large])
    if b is None:
        return cells.sparkSession.createDataFrame([], "x int, y int, label long, sky double, std double")
    value, wide = "v", reach(s.kernel)
    if s.kernel:
        b = b.mapped(lambda a, p: {"c": weighted(a["v"], s.kernel)}, {"c": "f8"}, wide, ["v"], tag="convolved")
        value = "c"
    b = thresholded(b, value, s)

    def first(a: Arrays, p: Place) -> Arrays:
        outside = p.outside(a["over"].shape)
        on, firm = a["over"] > 0, a["over"] == 2
        for _ in range(s.erode):
            on = eroded(on, s.erode_reach, outside, firm)
        return {"first": p.core(opened(on, s.opening, s.opening_reach, outside)) & ~np.isnan(a["v"])}

    b = b.mapped(first, {"first": "u1"}, max(1, s.erode + 2 * s.opening), ["over"], drop=["over", *(["c"] if s.kernel else [])], tag="first")
    b = b.labelled(lambda a: a["first"] > 0, 2, "label")
    b, tiles = with_background(b, "first", s)
    noise = cut(signal_to_noise(pseudo_detections(b, "label", True, s), "pseudo", tiles, s, but="label"), "noise")
    bound = statistics.quantiles(noise, "sn", [s.sn_q]).head() if not noise.isEmpty() else None
    bound = None if bound is None else bound["value"]
    above = F.col("sn").isNotNull() if bound is None else F.col("sn") > bound
    on = pseudo_detections(b, "label", False, s)
    true = on.painted("pseudo", signal_to_noise(on, "pseudo", tiles, s).where(above).select("label", F.lit(1).alias("value")), "true", "u1")
    holds = true.rows(lambda a, p: pd.DataFrame({"label": (u := np.unique(a["label"][a["true"] > 0]))[u > 0]}), "label long").distinct()
    b = b.painted("label", holds.select("label", F.lit(1).alias("value")), "kept", "u1")
    grown = _grown(b, "kept", s)
    b = grown or b.mapped(lambda a, p: {"label": np.where(a["kept"] > 0, a["label"], 0)}, {"label": "i8"}, tag="kept")
    last = signal_to_noise(b, "label", tiles, s).where(above).select("label") if s.clean else b.rows(lambda a, p: pd.DataFrame({"label": (u := np.unique(a["label"]))[u > 0]}), "label long").distinct()
    b = b.painted("label", positions(last, "label").select("label", F.col("_at").alias("value")), "number", "i8")
    b, _ = with_background(b, "number", s)
    return b.cells(label=("number", "long"), sky=("sky", "double"), std=("std", "double"))


@dataclass(frozen=True)
class Segmentation:
    """Settings of ``segment``."""

    large: Sequence[int] = (200, 200)  # tiles in which noise is flooded
    kernel: Kernel | None = None
    area: int = 15
    q: float = 0.95
    near_river: bool = False  # peaks beside a river may be true
    river: int = 2
    object_sn: float = 1.0
    cpscorr: float = 1.0


def segment(detected: DataFrame, s: Segmentation = Segmentation()) -> DataFrame:
    """x, y, object, clump of every detected cell: objects are numbered from 1, clumps within each from 1, 0 outside them.

    detected: x, y, v, label, std of the whole image.  The noise between detections is flooded tile by tile, which gives
    the significance that chance makes; clumps of detections above its quantile are true.  A detection with at most
    one true clump is one object; else true clumps joined by bright rivers make one, and the other cells go to the
    object that reaches them first.
    """
    schema = "x int, y int, object long, clump long"
    b = of_cells(detected, ["v", "label", "std"], [s.large], {"label": "i8"})
    if b is None:
        return detected.sparkSession.createDataFrame([], schema)
    if s.kernel:
        b = b.mapped(lambda a, p: {"v": np.where(np.isnan(p.core(a["v"])), np.nan, p.core(weighted(a["v"], s.kernel)))}, {"v": "f8"}, reach(s.kernel), ["v"], tag="convolved")
    across = -(-b.layout.nx // s.large[0])

    def noise(a: Arrays, p: Place) -> Arrays:
        y, x = (p.y + np.arange(a["v"].shape[0])) // s.large[1], (p.x + np.arange(a["v"].shape[1])) // s.large[0]
        return {"tile": np.where((a["label"] == 0) & ~np.isnan(a["v"]), y[:, None] * across + x[None, :] + 1, 0)}

    over_noise = flood(b.mapped(noise, {"tile": "i8"}, tag="noise"), "v", "tile")
    chance = cut(significance(over_noise, "v", "clump", "std", s.area), "chance")
    bound = statistics.quantiles(chance, "sn", [s.q]).head() if not chance.isEmpty() else None
    discard(over_noise.df)
    b = flood(b, "v", "label")
    sure = significance(b, "v", "clump", "std", s.area)
    sure = sure.select("clump") if bound is None or bound["value"] is None else sure.where(F.col("sn") > bound["value"]).select("clump")
    if not s.near_river:

        def rimmed(a: Arrays, p: Place) -> pd.DataFrame:
            number = (p.index(a["clump"].shape) + 1)[1:-1, 1:-1]
            wide = a["clump"]
            river = np.zeros(number.shape, bool)
            for dx, dy in grid.offsets(2, 2):
                river |= wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx] == -1
            return pd.DataFrame({"clump": number[(p.core(wide) == number) & river]})

        sure = sure.join(b.rows(rimmed, "clump long", 1, ["clump"]), "clump", "left_anti")
    sure = cut(sure, "sure")
    names = named(b, "label", "clump").select(F.col("peak").alias("clump"), "label")
    links = rivers(b, "v", "clump", "std", s.river, s.object_sn, s.cpscorr)
    links = links.join(sure.withColumnRenamed("clump", "cell"), "cell", "left_semi").join(sure.withColumnRenamed("clump", "from"), "from", "left_semi")
    links = cut(links.select("cell", "from"), "links")
    joined = sure.withColumnRenamed("clump", "cell")
    joined = joined.select("cell", F.col("cell").alias("root")) if links.isEmpty() else joined.join(grid.least_linked(links), "cell", "left").select("cell", F.coalesce("root", "cell").alias("root"))
    parts = cut(joined.join(names.withColumnRenamed("clump", "cell"), "cell"), "parts")  # cell (a true clump), root (its object's first), label
    # objects are numbered by their detections; a detection without two parts is one object whole
    several = parts.groupBy("label").agg(F.count_distinct("root").alias("n")).where("n > 1").select("label")
    whole = b.rows(lambda a, p: pd.DataFrame({"label": (u := np.unique(a["label"]))[u > 0]}), "label long").distinct().join(several, "label", "left_anti")
    all_ = parts.join(several, "label", "left_semi").select("label", "root").distinct().unionByName(whole.select("label", F.lit(0).cast("long").alias("root")))
    objects = cut(positions(all_, ["label", "root"]).select("label", "root", F.col("_at").alias("object")), "objects")
    seeds = parts.join(objects, ["label", "root"]).select(F.col("cell").alias("label"), F.col("object").alias("value"))
    b = b.painted("label", objects.where("root = 0").select("label", F.col("object").alias("value")), "_whole", "i8")
    b = b.painted("clump", seeds, "_seed", "i8")
    b = b.mapped(lambda a, p: {"_seed": np.where(a["_whole"] > 0, a["_whole"], a["_seed"])}, {"_seed": "i8"}, drop=["_whole"], tag="seeds")
    b = spread(b, "label", "_seed", "object")
    own = parts.join(objects, ["label", "root"], "left").join(objects.where("root = 0").select("label", F.col("object").alias("_w")), "label", "left")
    own = own.select("cell", F.coalesce("object", "_w").alias("object"))
    order = positions(own, ["object", "cell"])
    first = order.groupBy("object").agg(F.min("_at").alias("_first"))
    numbers = order.join(first, "object").select(F.col("cell").alias("label"), (F.col("_at") - F.col("_first") + 1).alias("value"))
    b = b.painted("clump", numbers, "number", "i8")
    return b.cells(object=("object", "long"), clump=("number", "long"), _label=("label", "long")).where("_label > 0").drop("_label")
