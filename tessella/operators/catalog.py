"""Labelled aggregation: the measurement catalogue of labelled pixels.

Input rows are pixels (label, x, y[, z], v[, sky, std, clump]); label and clump count from 1, blanks of v
are NULL.  Every requested column is built of partial sums, which a hash aggregation combines map-side;
only the columns about ordered values need a window over each label.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sky import TangentPlane
from ..plans.lineage import cut
from . import blocks
from .statistics import medians, sigma_clip

PI = math.pi


@dataclass(frozen=True)
class Settings:
    zeropoint: float = 0.0
    pixel_area: float = 1.0  # arcsec^2
    variance: bool = False
    cpscorr: float = 1.0
    sigmaclip: tuple[float, float] = (3.0, 0.2)
    fracmax: tuple[float, float] = (0.25, 0.75)
    wcs: TangentPlane | None = None


def magnitude(total: Column, zeropoint: float) -> Column:
    return F.when(total > 0, -2.5 * F.log10(total) + zeropoint)


def surface_brightness(total: Column, area: Column, s: Settings) -> Column:
    return F.when((total > 0) & (area > 0), magnitude(total, s.zeropoint) + 2.5 * F.log10(area * s.pixel_area))


def sums(dims: Sequence[str], s: Settings) -> dict[str, Column]:
    """Partial aggregates by name."""
    v, sky, std = F.col("v"), F.col("sky"), F.col("std")
    up = v > 0
    clumped = F.col("clump") > 0
    var = (std if s.variance else std * std) + F.abs(v)  # the variance of a pixel: background and its own signal
    out: dict[str, Column] = {
        "n_all": F.count("*"),
        "n_v": F.count(v),
        "s_v": F.sum(v),
        "n_up": F.count(F.when(up, 1)),
        "s_up": F.sum(F.when(up, v)),
        "s_var": F.sum(F.when(v.isNotNull(), var)),
        "s_sky": F.avg(sky),
        "s_std2": F.avg(std if s.variance else std * std),
        "v_min": F.min(v),
        "v_max": F.max(v),
        "n_clumps": F.count_distinct(F.when(clumped, F.col("clump"))),
        "cn_v": F.count(F.when(clumped, v)),
        "cs_v": F.sum(F.when(clumped, v)),
        "cs_up": F.sum(F.when(clumped & up, v)),
        "nxy": F.count_distinct("x", "y"),
        "nxy_v": F.count_distinct(F.when(v.isNotNull(), F.struct("x", "y"))),
    }
    for d in dims:
        c = F.col(d).cast("double")
        out |= {f"g_{d}": F.avg(c), f"w_{d}": F.sum(F.when(up, v * c)), f"min_{d}": F.min(d), f"max_{d}": F.max(d), f"cg_{d}": F.avg(F.when(clumped, c)), f"cw_{d}": F.sum(F.when(clumped & up, v * c))}
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    for name, term in (("xx", x * x), ("yy", y * y), ("xy", x * y)):
        out |= {f"w_{name}": F.sum(F.when(up, v * term)), f"g_{name}": F.avg(term)}
    return out


def _moments(kind: str) -> tuple[Column, Column, Column]:
    """xx, yy, xy about the centre, weighted by positive values or plain."""
    if kind == "g":
        x, y = F.col("g_x"), F.col("g_y")
        return F.col("g_xx") - x * x, F.col("g_yy") - y * y, F.col("g_xy") - x * y
    w = F.nullif(F.col("s_up"), F.lit(0.0))
    x, y = F.col("w_x") / w, F.col("w_y") / w
    return F.col("w_xx") / w - x * x, F.col("w_yy") / w - y * y, F.col("w_xy") / w - x * y


def _semi(kind: str, sign: int) -> Column:
    xx, yy, xy = _moments(kind)
    root = F.sqrt(F.pow((xx - yy) / 2, F.lit(2.0)) + xy * xy)
    return F.sqrt(F.greatest((xx + yy) / 2 + sign * root, F.lit(0.0)))


def _angle(kind: str) -> Column:
    xx, yy, xy = _moments(kind)
    return F.degrees(0.5 * F.atan2(2 * xy, xx - yy))


def _center(d: str) -> Column:
    return F.coalesce(F.col(f"w_{d}") / F.nullif(F.col("s_up"), F.lit(0.0)), F.col(f"g_{d}"))


def _clumps_center(d: str) -> Column:
    return F.coalesce(F.col(f"cw_{d}") / F.nullif(F.col("cs_up"), F.lit(0.0)), F.col(f"cg_{d}"))


def columns(dims: Sequence[str], s: Settings, rivers: bool = False) -> dict[str, Column]:
    """Requested column -> expression over the partial aggregates and the ordered measurements.

    With ``rivers`` the mean of the river around a clump is taken off each of its pixels.
    """
    c = F.col
    own = c("s_v") - F.coalesce("riverave", F.lit(0.0)) * c("n_v") if rivers else c("s_v")
    error = F.sqrt(c("s_var") + F.coalesce("rivervar", F.lit(0.0))) if rivers else F.sqrt("s_var")
    sn = math.sqrt(1 / s.cpscorr) * own / F.nullif(error, F.lit(0.0))
    ratio = _semi("w", -1) / F.nullif(_semi("w", 1), F.lit(0.0))
    radius = lambda area: F.when(ratio >= 1e-6, F.sqrt(area / (ratio * PI)))
    out: dict[str, Column] = {"objid": c("label"), "numclumps": c("n_clumps"), "area": c("n_v"), "geoarea": c("n_all"), "weightarea": c("n_up"), "clumpsarea": c("cn_v"), "areaxy": c("nxy_v"), "geoareaxy": c("nxy")}
    out |= {"brightness": own, "brightnesserr": error, "clumpbrightness": c("cs_v"), "brightnessnoriver": c("s_v"), "mean": own / F.nullif(c("n_v"), F.lit(0)), "median": c("median"), "sky": c("s_sky"), "std": F.sqrt("s_std2")}
    out |= {"magnitude": magnitude(own, s.zeropoint), "clumpsmagnitude": magnitude(c("cs_v"), s.zeropoint), "sn": sn, "magnitudeerr": F.when(sn > 0, 2.5 / (sn * math.log(10)))}
    out |= {"areaarcsec2": c("n_v") * s.pixel_area, "surfacebrightness": surface_brightness(own, c("n_v"), s)}
    if rivers:
        out |= {"hostobjid": c("label"), "idinhostobj": c("clump"), "rivernum": F.coalesce("rivernum", F.lit(0)), "riverave": c("riverave")}
    for d in dims:
        out |= {d: _center(d), f"geo{d}": c(f"g_{d}"), f"min{d}": c(f"min_{d}"), f"max{d}": c(f"max_{d}"), f"clumps{d}": _clumps_center(d), f"clumpsgeo{d}": c(f"cg_{d}"), f"minv{d}": c(f"at_min_{d}"), f"maxv{d}": c(f"at_max_{d}")}
    for kind, pre in (("w", ""), ("g", "geo")):
        major, minor = _semi(kind, 1), _semi(kind, -1)
        out |= {f"{pre}semimajor": major, f"{pre}semiminor": minor, f"{pre}axisratio": minor / F.nullif(major, F.lit(0.0)), f"{pre}positionangle": _angle(kind)}
    out |= {"areaminv": c("n_min"), "areamaxv": c("n_max"), "maximum": c("top"), "halfmaxarea": c("n_half"), "halfmaxsum": c("s_half"), "halfmaxsb": surface_brightness(c("s_half"), c("n_half"), s)}
    out |= {"halfsumarea": c("n_halfsum"), "halfsumsb": surface_brightness(c("s_v") / 2, c("n_halfsum"), s), "fwhmobs": 2 * radius(c("n_half")), "halfradiusobs": radius(c("n_halfsum"))}
    for k in (1, 2):
        out |= {f"fracmaxsum{k}": c(f"s_frac{k}"), f"fracmaxarea{k}": c(f"n_frac{k}"), f"fracmaxradius{k}": radius(c(f"n_frac{k}"))}
    out |= {f"sigclip-{n}": c(f"clip_{n}") for n in ("number", "median", "mean", "std")}
    if s.wcs:
        for pre, of in (("", _center), ("geo", lambda d: c(f"g_{d}")), ("clumps", _clumps_center), ("clumpsgeo", lambda d: c(f"cg_{d}"))):
            w1, w2 = s.wcs.to_world(of("x"), of("y"))
            out |= {f"{pre}w1": w1, f"{pre}w2": w2}
        out |= {"ra": out["w1"], "dec": out["w2"]}
    if "z" in dims:  # a third axis is linear and passes through
        out |= {"w3": _center("z"), "geow3": c("g_z"), "clumpsw3": _clumps_center("z"), "clumpsgeow3": c("cg_z")}
    return out


ORDERED = frozenset("maximum halfmaxarea halfmaxsum halfmaxsb halfsumarea halfsumsb fwhmobs halfradiusobs fracmaxsum1 fracmaxsum2 fracmaxarea1 fracmaxarea2 fracmaxradius1 fracmaxradius2".split())


def extremes(pixels: DataFrame, keys: list[str], dims: Sequence[str]) -> DataFrame:
    """Where a label's least and greatest values lie, and how many pixels have them."""
    ends = pixels.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    at = pixels.join(ends, keys)
    low, high = F.col("v") == F.col("_lo"), F.col("v") == F.col("_hi")
    aggs = [F.count(F.when(low, 1)).alias("n_min"), F.count(F.when(high, 1)).alias("n_max")]
    for d in dims:
        aggs += [F.avg(F.when(low, F.col(d))).alias(f"at_min_{d}"), F.avg(F.when(high, F.col(d))).alias(f"at_max_{d}")]
    return at.groupBy(*keys).agg(*aggs)


def ordered(pixels: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """Measurements of values from bright to faint: the mean of the top three, counts and sums above fractions
    of it, and how many pixels make up half of the sum."""
    down = W.partitionBy(*keys).orderBy(F.col("v").desc(), "x", "y")
    whole = W.partitionBy(*keys)
    p = pixels.where(F.col("v").isNotNull()).select(*keys, "v", F.row_number().over(down).alias("k"), F.count("*").over(whole).alias("n"), F.sum("v").over(whole).alias("total"), F.sum("v").over(down.rowsBetween(W.unboundedPreceding, 0)).alias("run"))
    top = p.where("k <= 3").groupBy(*keys).agg(F.when(F.max("n") > 3, F.avg("v")).otherwise(F.max("v")).alias("top"))
    p = p.join(top, keys)
    above = lambda f: F.col("v") >= f * F.col("top")
    aggs = [F.first("top").alias("top"), F.greatest(F.coalesce(F.min(F.when(F.col("run") > 0.5 * F.col("total"), F.col("k"))) - 1, F.max("n")), F.lit(1)).alias("n_halfsum")]
    for name, f in (("half", 0.5), ("frac1", s.fracmax[0]), ("frac2", s.fracmax[1])):
        first = F.min(F.when(~above(f), F.col("k")))  # the first that is fainter
        n = F.greatest(F.coalesce(first - 1, F.max("n")), F.lit(1))
        aggs += [n.alias(f"n_{name}"), F.coalesce(F.sum(F.when(above(f), F.col("v"))), F.max("v")).alias(f"s_{name}")]
    return p.groupBy(*keys).agg(*aggs)


def catalog(pixels: DataFrame, asked: Sequence[str], settings: Settings = Settings(), keys: Sequence[str] = ("label",), inbetween: bool = False) -> DataFrame:
    """One row per label with the requested columns.  ``inbetween`` keeps labels without pixels.

    With the keys label and clump each clump has a row; pixels of clump below 0 are the rivers between them.
    """
    keys = list(keys)
    rivers = "clump" in keys
    dims = [d for d in ("x", "y", "z") if d in pixels.columns]
    for name, default in (("sky", 0.0), ("std", 0.0), ("clump", 0)):
        if name not in pixels.columns:
            pixels = pixels.withColumn(name, F.lit(default))
    pixels = pixels.where(F.col(keys[0]) > 0)
    around = clump_rivers(pixels, settings) if rivers else None
    pixels = pixels.where("clump > 0") if rivers else pixels
    table = columns(dims, settings, rivers)
    unknown = [a for a in asked if a not in table]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    out = pixels.groupBy(*keys).agg(*[c.alias(n) for n, c in sums(dims, settings).items()])
    if rivers:
        out = out.join(around, keys, "left")
    if "median" in asked:
        out = out.join(medians(pixels, keys, "v"), keys, "left")
    if any(a in ("areaminv", "areamaxv") or a[:4] in ("minv", "maxv") for a in asked):
        out = out.join(extremes(pixels, keys, dims), keys, "left")
    if ORDERED & set(asked):
        out = out.join(ordered(pixels, keys, settings), keys, "left")
    if any(a.startswith("sigclip") for a in asked):
        clip = sigma_clip(pixels, keys, "v", *settings.sigmaclip)
        out = out.join(clip.withColumnsRenamed({n: f"clip_{n}" for n in ("number", "median", "mean", "std")}), keys, "left")
    # columns of parts that weren't measured are never referred to
    out = out.select(*keys, *[table[a].alias(a) for a in asked if a not in keys])
    if inbetween:
        top = pixels.agg(F.max(keys[0])).head()[0] or 0
        out = pixels.sparkSession.range(1, top + 1).select(F.col("id").alias(keys[0])).join(out, keys[0], "left")
    return out


def clump_rivers(pixels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(label, clump, rivernum, riverave, rivervar): the river pixels (clump below 0) of a label that touch each of its clumps, 8-connected."""
    std = F.col("std") if "std" in pixels.columns else F.lit(0.0)
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    reach = pixels.where("clump > 0").select("label", "clump", "x", "y", steps.alias("d")).select("label", "clump", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y")).distinct()
    river = pixels.where("clump < 0").select("label", "x", "y", "v", ((std if s.variance else std * std) + F.abs("v")).alias("_var"))
    return reach.join(river, ["label", "x", "y"]).groupBy("label", "clump").agg(F.count("v").alias("rivernum"), F.avg("v").alias("riverave"), F.sum("_var").alias("rivervar"))


def spectrum(pixels: DataFrame) -> DataFrame:
    """Sums of each label on each slice of the third axis."""
    return pixels.where("label > 0").groupBy("label", "z").agg(F.sum("v").alias("sum"), F.count("v").alias("number"), F.count("*").alias("geonumber"))


#: Pixels of shifted footprints that are looked at together.
SHIFTED = 1 << 20


def upper_limit(pixels: DataFrame, number: int = 100, seed: int = 1, clip: tuple[float, float] = (3.0, 0.2), nsigma: float = 3.0, tries: int = 10, zeropoint: float = 0.0) -> DataFrame:
    """label, upperlimit, upperlimitmag, upperlimitonesigma, upperlimitsigma, upperlimitquantile, upperlimitskew, placed.

    Each label's footprint is placed ``number`` times at random; a placement counts if all of it lies on
    unlabelled, non-blank pixels.  Placements are drawn by a hash of label and trial, so a lost task draws
    the same again; a label with too few of ``number`` * ``tries`` trials has blanks.

    The image lies in blocks, and footprints in pieces, one for each block that holds some of them.  A trial sends its
    shift to the blocks that a shifted piece may touch, four at most, and a piece's pixels go to a block once, whatever the
    number of trials there.
    """
    b = blocks.of_cells(pixels, ["v", "label"], kinds={"label": "i8"})
    if b is None:
        raise ValueError("no pixels")
    lay = b.layout
    x0, x1, y0, y1 = lay.x0, lay.x0 + lay.nx - 1, lay.y0, lay.y0 + lay.ny - 1
    foot = pixels.where("label > 0")
    corner = cut(foot.groupBy("label").agg(F.min("x").alias("fx"), F.min("y").alias("fy"), F.max("x").alias("gx"), F.max("y").alias("gy"), F.count("*").alias("size"), F.sum("v").alias("own")), "corners")
    draw = lambda k, low, high: low + F.pmod(F.xxhash64("label", "trial", F.lit(seed), F.lit(k)), F.greatest(high - low + 1, F.lit(1)))
    drawn = lambda labels, first, last: labels.withColumn("trial", F.explode(F.sequence(F.lit(first), F.lit(last)))).select("label", "trial", (draw(0, F.lit(x0), F.lit(x1) - (F.col("gx") - F.col("fx"))) - F.col("fx")).alias("dx"), (draw(1, F.lit(y0), F.lit(y1) - (F.col("gy") - F.col("fy"))) - F.col("fy")).alias("dy"))

    def pieces_of(a: blocks.Arrays, p: blocks.Place) -> pd.DataFrame:
        out = []
        ys, xs = np.nonzero(a["label"] > 0)
        order = np.argsort(a["label"][ys, xs], kind="stable")
        ys, xs = ys[order] + p.y, xs[order] + p.x
        labels, first = np.unique(a["label"][ys - p.y, xs - p.x], return_index=True)
        for label, x, y in zip(labels.tolist(), np.split(xs, first[1:]), np.split(ys, first[1:])):
            out.append((label, p.x // lay.sx, p.y // lay.sy, int(x.min()), int(x.max()), int(y.min()), int(y.max()), x.astype("i4").tobytes(), y.astype("i4").tobytes()))
        return pd.DataFrame(out, columns=["label", "px", "py", "lx", "hx", "ly", "hy", "xs", "ys"])

    pieces = cut(b.rows(pieces_of, "label long, px int, py int, lx int, hx int, ly int, hy int, xs binary, ys binary"), "pieces")
    at = lambda low, high, shift, side, most: F.sequence(F.greatest(F.floor((F.col(low) + F.col(shift)) / side), F.lit(0)).cast("int"), F.least(F.floor((F.col(high) + F.col(shift)) / side), F.lit(most)).cast("int"))

    def measured(a: blocks.Arrays, p: blocks.Place, told: pd.DataFrame) -> pd.DataFrame:
        free = (a["label"] == 0) & ~np.isnan(a["v"])
        v, (h, w) = np.where(free, a["v"], 0.0), free.shape
        has = told["xs"].notna()
        shape = {(r.label, r.px, r.py): (np.frombuffer(r.xs, "i4"), np.frombuffer(r.ys, "i4")) for r in told[has].itertuples()}
        out = [pd.DataFrame({"label": [], "trial": [], "n": [], "s": []})]
        for key, g in told[~has].groupby(["label", "px", "py"], sort=False):
            xs, ys = shape[key]
            for k in range(0, len(g), step := max(1, SHIFTED // len(xs))):  # some shifts of a piece at once
                d = g.iloc[k : k + step]
                x, y = (at + of.to_numpy("i8")[:, None] - low for at, of, low in ((xs, d["dx"], p.x), (ys, d["dy"], p.y)))
                own = (x >= 0) & (x < w) & (y >= 0) & (y < h)
                x, y = np.where(own, x, 0), np.where(own, y, 0)
                out.append(pd.DataFrame({"label": d["label"], "trial": d["trial"], "n": (free[y, x] & own).sum(1), "s": np.where(own, v[y, x], 0.0).sum(1)}))
        return pd.concat(out).astype({"label": "i8", "trial": "i4", "n": "i8"})

    def placed(trials: DataFrame) -> DataFrame:
        """The trials whose whole footprint is free, with its sum."""
        sent = trials.join(pieces.drop("xs", "ys"), "label").withColumn("bx", F.explode(at("lx", "hx", "dx", lay.sx, (lay.nx - 1) // lay.sx))).withColumn("by", F.explode(at("ly", "hy", "dy", lay.sy, (lay.ny - 1) // lay.sy)))
        sent = cut(sent.select("bx", "by", "label", "px", "py", "trial", "dx", "dy"), "sent")
        shapes = sent.select("bx", "by", "label", "px", "py").distinct().join(pieces.select("label", "px", "py", "xs", "ys"), ["label", "px", "py"])
        table = sent.unionByName(shapes, allowMissingColumns=True)
        parts = b.asked(table, measured, "label long, trial int, n long, s double").groupBy("label", "trial").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        return parts.join(corner.select("label", "size"), "label").where("n = size")

    # most labels find enough places among a few trials; only the others draw the rest
    few = min(2, tries) * number
    sums_ = cut(placed(drawn(corner, 1, few)), "sums")
    lacking = corner.join(sums_.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= number), "label", "left_anti")
    if few < number * tries and not lacking.isEmpty():
        sums_ = sums_.unionByName(placed(drawn(lacking, few + 1, number * tries)))
    kept = sums_.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy("trial"))).where(F.col("k") <= number)
    dist = sigma_clip(kept, ["label"], "s", *clip).withColumnsRenamed({"number": "clipped"})
    rank = kept.join(corner.select("label", "own"), "label").groupBy("label").agg(F.count("*").alias("placed"), F.count(F.when(F.col("s") <= F.col("own"), 1)).alias("below"))
    out = corner.join(dist, "label", "left").join(rank, "label", "left")
    enough = F.coalesce(F.col("placed"), F.lit(0)) >= number
    when = lambda c: F.when(enough, c)
    return out.select("label", when(F.col("std") * nsigma).alias("upperlimit"), when(magnitude(F.col("std") * nsigma, zeropoint)).alias("upperlimitmag"), when(F.col("std")).alias("upperlimitonesigma"), when(F.try_divide(F.col("own"), F.col("std"))).alias("upperlimitsigma"), when(F.col("below") / number).alias("upperlimitquantile"), when(F.try_divide(F.col("mean") - F.col("median"), F.col("std"))).alias("upperlimitskew"), F.coalesce("placed", F.lit(0)).alias("placed"))


Expression = Callable[[Settings], Column]
