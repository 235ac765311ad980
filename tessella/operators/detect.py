"""Steps of detection on a grid of single cells: thresholds by tiles, signal to noise, growth, clumps' significance and
pairs, and outliers among tiles.  The watershed and the whole programs work on blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.table import positions
from . import grid, statistics

XY = ["x", "y"]


def tile_thresholds(cells: DataFrame, widths: Sequence[int], q: float, most: float = 0.01, neighbours: int = 5) -> DataFrame:
    """(tx, ty, thresh): the quantile of each tile whose mean lies near its median; the others from their neighbours."""
    own = cells.select(*[F.floor((F.col(d) - 1) / w).alias(f"t{d}") for d, w in zip(XY, widths)], "v")
    keys = ["tx", "ty"]
    stats = own.groupBy(*keys).agg(F.avg("v").alias("m"), F.count("v").alias("n"), F.sort_array(F.collect_list("v")).alias("vs"))  # a tile's size is fixed
    at = F.element_at("vs", (F.ceil((F.col("n") - 1) * q - 0.5) + 1).cast("int"))
    below = F.size(F.filter("vs", lambda v: v <= F.col("m"))) / F.greatest(F.col("n"), F.lit(1))
    tiles = stats.select(*keys, F.when((F.col("n") > 0) & (F.abs(below - 0.5) <= most), at).alias("v"))
    return grid.interpolate_neighbours(tiles, neighbours, "median", keys, start=1).withColumnRenamed("v", "thresh")


def above(cells: DataFrame, thresholds: DataFrame, widths: Sequence[int]) -> DataFrame:
    """1 where a cell exceeds its tile's threshold, 0 elsewhere and at blanks."""
    tiled = cells.withColumns({f"t{d}": F.floor((F.col(d) - 1) / w) for d, w in zip(XY, widths)})
    return tiled.join(thresholds, ["tx", "ty"], "left").select(*XY, F.coalesce((F.col("v") > F.col("thresh")).cast("int"), F.lit(0)).alias("v"))


def initial_detection(cells: DataFrame, widths: Sequence[int], q: float = 0.3, no_erode: float = 0.99, erode: int = 2, opening: int = 1, most: float = 0.2) -> DataFrame:
    """(x, y, label): thresholded, eroded, cells above the no-erosion quantile put back, opened and labelled."""
    on = above(cells, tile_thresholds(cells, widths, q, most), widths)
    keep = above(cells, tile_thresholds(cells, widths, no_erode, most), widths).where("v = 1").select(*XY).withColumn("_k", F.lit(1))
    for _ in range(erode):
        on = grid.erode(on, 1)
    on = on.join(keep, XY, "left").select(*XY, F.when(F.col("_k") == 1, 1).otherwise(F.col("v")).alias("v"))
    return grid.connected_components(grid.opening(on, opening, 2), 2)


def signal_to_noise(labelled: DataFrame, sky: float, std: float, area: int = 1, cpscorr: float = 1.0) -> DataFrame:
    """(label, area, sn) of labels large and bright enough; labelled: x, y, v, label."""
    each = labelled.where("label > 0").groupBy("label").agg(F.count("v").alias("area"), (F.avg("v") - sky).alias("ave"))
    good = each.where((F.col("area") > area) & (F.col("ave") > 0))
    return good.select("label", "area", (F.sqrt(F.col("area") / cpscorr) * F.col("ave") / F.sqrt(F.col("ave") + std * std)).alias("sn"))


def remove_false(labels: DataFrame, true_cells: DataFrame) -> DataFrame:
    """Labels of which no cell lies on a true pseudo-detection become 0."""
    kept = labels.where("label > 0").join(true_cells.select(*XY), XY, "left_semi").select("label").distinct().withColumn("_k", F.lit(1))
    return labels.join(kept, "label", "left").select(*XY, F.when(F.col("_k") == 1, F.col("label")).otherwise(0).alias("label"))


def grow(cells: DataFrame, labels: DataFrame, least: float, rounds: int) -> DataFrame:
    """Labels spread, a cell a round, into touching unlabelled cells of at least a value; the lower label wins."""
    for _ in range(rounds):
        reach = grid.send(labels.where("label > 0"), grid.offsets(2, 2), XY, ("label",)).groupBy(*XY).agg(F.min("label").alias("_new"))
        free = cells.where(F.col("v") >= least).select(*XY).withColumn("_ok", F.lit(1))
        grown = labels.join(reach, XY, "left").join(free, XY, "left")
        labels = grown.select(*XY, F.when((F.col("label") == 0) & (F.col("_ok") == 1), F.coalesce("_new", F.lit(0))).otherwise(F.col("label")).alias("label"))
    return labels


def clump_significance(flooded: DataFrame, std: float, area: int = 1) -> DataFrame:
    """(label, clump, area, peak, river, significance): how far a peak stands above the river around it."""
    size = flooded.where("clump > 0").groupBy("label", "clump").agg(F.count("*").alias("area"), F.max("v").alias("peak"))
    reach = grid.send(flooded.where("clump > 0"), grid.offsets(2, 2), XY, ("label", "clump")).select("label", "clump", *XY).distinct()
    river = reach.join(flooded.where("clump < 0").select(*XY, "v"), XY).groupBy("label", "clump").agg(F.avg("v").alias("river"))
    return size.where(F.col("area") > area).join(river, ["label", "clump"]).withColumn("significance", (F.col("peak") - F.col("river")) / std)


def clump_pairs(flooded: DataFrame, var: float, least: int = 2, sn: float = 1.0, cpscorr: float = 1.0) -> DataFrame:
    """(label, a, b): clumps whose common river is long and bright enough to make them one object; each pair once."""
    river = flooded.where("clump < 0").select("label", *XY, "v")
    near = grid.send(flooded.where("clump > 0"), grid.offsets(2, 2), XY, ("label", "clump", "v")).withColumnRenamed("v", "nv").drop("step").join(river, ["label", *XY])
    mean = near.groupBy("label", *XY).agg(((F.sum("nv") + F.first("v")) / (F.count("*") + 1)).alias("ave"))
    touch = near.select("label", *XY, "clump").distinct()
    pairs = touch.alias("p").join(touch.alias("q"), ["label", *XY]).where("p.clump < q.clump").select("label", *XY, F.col("p.clump").alias("a"), F.col("q.clump").alias("b"))
    edge = pairs.join(mean, ["label", *XY]).groupBy("label", "a", "b").agg(F.count("*").alias("n"), F.avg("ave").alias("ave"))
    strong = np.sqrt(1 / cpscorr) * F.col("ave") / F.sqrt(F.greatest(F.col("ave") + var, F.lit(1e-12)))
    return edge.where((F.col("n") > least) & (strong > sn)).select("label", "a", "b")


# outliers among tiles


def tile_outliers_global(tiles: DataFrame, value: str = "v", sigma: float = 5.0, clip: tuple[float, float] = (3.0, 0.2)) -> DataFrame:
    """The tiles with those values blanked that lie beyond the first wide gap above the median, or below it.

    A gap is wide if it lies more than ``sigma`` clipped deviations above those of the half of all values before
    it.  Windows of up to two tiles say nothing, and all stay.
    """
    n = tiles.where(F.col(value).isNotNull()).count()
    window = n // 2
    if window <= 2:
        return tiles
    d = tiles.withColumn("_g", F.lit(1))
    low = d.withColumn("_v", -F.col(value))
    high = statistics.outlier_by_distance(d, ["_g"], value, window, sigma, clip).head()["outlier"]
    least = statistics.outlier_by_distance(low, ["_g"], "_v", window, sigma, clip).head()["outlier"]
    keep = F.lit(True)
    keep = keep & (F.col(value) <= high) if high is not None else keep
    keep = keep & (F.col(value) >= -least) if least is not None else keep
    return tiles.withColumn(value, F.when(keep, F.col(value)))


def tile_outliers_local(tiles: DataFrame, value: str = "v", neighbours: int = 8, sigma: float = 5.0, clip: tuple[float, float] = (3.0, 0.2), dims: Sequence[str] = ("tx", "ty")) -> DataFrame:
    """The tiles with those values blanked that lie more than ``sigma`` clipped deviations above the clipped median of their nearest tiles."""
    names = list(dims)
    full = tiles.where(F.col(value).isNotNull()).select(*names, F.col(value).cast("double").alias("_v"))
    reach = int(np.ceil(np.sqrt(neighbours))) + 1
    steps = [s for s in grid.box([2 * reach + 1] * len(names)) if any(s)]
    far = F.element_at(F.array(*[F.lit(float(sum(k * k for k in s))) for s in steps]), F.col("step") + 1)
    near = grid.send(full, steps, names, ("_v",)).withColumn("r", far)

    @F.pandas_udf("double")
    def departure(values: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for near_ones, v in zip(values, own):
            _, med, _, std = statistics.sigma_clip_array(np.array([x["_v"] for x in near_ones][:neighbours], float), *clip)
            out.append((v - med) / std if std > 0 else 0.0)
        return pd.Series(out)

    # a box holds a fixed number of tiles
    sets = near.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("r", "step", "_v"))).alias("_near"))
    gone = full.join(sets, names).where(F.size("_near") >= neighbours).where(departure("_near", "_v") > sigma).select(*names).withColumn("_gone", F.lit(1))
    return tiles.join(gone, names, "left").withColumn(value, F.when(F.col("_gone").isNull(), F.col(value))).drop("_gone")
