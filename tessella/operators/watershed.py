"""Watershed of detections of any size, and what is measured on its clumps.

Cells are visited from bright to faint (ties in raster order).  A cell takes the clump of its brighter
neighbours, becomes river where they are of several, and starts a clump where none of them is of any.  So a cell
depends on brighter neighbours only, and blocks can be flooded side by side: a cell whose brighter neighbours lie
in another block and aren't decided yet waits for a later round, unless two clumps make it a river anyway.
Rounds follow the longest slope in blocks; each is written, and decided cells are never visited again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discard
from ..plans.skew import spread_join
from ..plans.table import positions
from . import grid
from .blocks import Arrays, Blocks, Place, of_cells, shifted

WAITS, RIVER = 0, -1
STEPS = grid.offsets(2, 2)


def _flooded(values: np.ndarray, labels: np.ndarray, clumps: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One round over a block with a rim of one cell: the clumps of its core, as far as they can be told.

    A clump is known by the number of its peak, from 1.
    """
    h, w = values.shape
    on = (labels > 0) & ~np.isnan(values)
    core = np.zeros(values.shape, bool)
    core[1:-1, 1:-1] = True
    todo = np.flatnonzero((on & core & (clumps == WAITS)).ravel())
    v, lab, own, num = (a.ravel().tolist() for a in (values, labels, clumps, number))
    live = on.ravel().tolist()
    order = todo[np.lexsort((number.ravel()[todo], -values.ravel()[todo]))]
    jumps = [dy * w + dx for dx, dy in STEPS]
    for c in order.tolist():
        waits, found, river = False, 0, False
        for j in jumps:
            n = c + j
            if not live[n] or lab[n] != lab[c] or v[n] < v[c] or (v[n] == v[c] and num[n] > num[c]):
                continue
            k = own[n]
            if k == WAITS:
                waits = True
            elif k > 0:
                if found and k != found:
                    river = True
                    break
                found = k
        own[c] = RIVER if river else WAITS if waits else found or num[c]
    return np.array(own, np.int64).reshape(h, w)


def flood(b: Blocks, value: str, label: str, out: str = "clump") -> Blocks:
    """With the layer ``out``: the number of the peak of each labelled cell's clump, -1 on rivers, 0 outside."""
    state = b.mapped(lambda a, p: {out: np.zeros(a[label].shape, np.int64)}, {out: "i8"}, tag="flood")
    while True:

        def step(a: Arrays, p: Place) -> Arrays:
            return {out: p.core(_flooded(a[value], a[label], a[out], p.index(a[out].shape) + 1))}

        new = state.mapped(step, {out: "i8"}, 1, [value, label, out], tag="flood")
        discard(state.df)
        state = new
        waiting = state.rows(lambda a, p: pd.DataFrame({"n": [int(((a[out] == WAITS) & (a[label] > 0) & ~np.isnan(a[value])).sum())]}), "n long")
        if not waiting.agg(F.sum("n")).first()[0]:
            return state


def named(b: Blocks, label: str, clump: str) -> DataFrame:
    """(peak, label, clump): the clumps of each label numbered from 1, from the brightest peak on."""

    def peaks(a: Arrays, p: Place) -> pd.DataFrame:
        number = p.index(a[clump].shape) + 1
        at = (a[clump] == number) & (a[label] > 0)
        return pd.DataFrame({"peak": number[at], "label": a[label][at], "v": a["v"][at]})

    found = b.rows(peaks, "peak long, label long, v double").withColumn("_dim", -F.col("v"))
    placed = positions(found, ["label", "_dim", "peak"])
    first = placed.groupBy("label").agg(F.min("_at").alias("_first"))
    return spread_join(placed, first, "label", "peak").select("peak", "label", (F.col("_at") - F.col("_first") + 1).alias("clump"))


def watershed(labelled: DataFrame, side: int | None = None) -> DataFrame:
    """(label, x, y, v, clump) of the cells of positive labels; clumps are numbered within each label, rivers are -1.

    labelled: x, y, v, label; a detection may lie in any number of blocks.
    """
    d = labelled.where("label > 0").select("x", "y", F.col("v").cast("double").alias("v"), F.col("label").cast("long").alias("label")).dropna()
    b = of_cells(d, ["v", "label"], kinds={"label": "i8"}, **({"side": side} if side else {}))
    schema = "label long, x long, y long, v double, clump long"
    if b is None:
        return d.sparkSession.createDataFrame([], schema)
    b = flood(b, "v", "label")
    names = named(b, "label", "clump").select(F.col("peak").alias("label"), F.col("clump").alias("value"))
    b = b.painted("clump", names, "number", "i8", tag="named")
    b = b.mapped(lambda a, p: {"number": np.where(a["clump"] > 0, a["number"], a["clump"])}, {"number": "i8"}, tag="named")
    return b.cells(label=("label", "long"), v=("v", "double"), clump=("number", "long")).select("label", F.col("x").cast("long"), F.col("y").cast("long"), "v", "clump")


def beside(clumps: np.ndarray, p: Place) -> list[np.ndarray]:
    """What the cells of a block's core see around them, in the eight directions."""
    return [p.core(shifted(clumps, dx, dy, 0)) for dx, dy in STEPS]


def significance(b: Blocks, value: str, clump: str, std: str, area: int) -> DataFrame:
    """(clump, sn): how many deviations a clump's peak stands above the brightest river cell beside it.

    Clumps of at most ``area`` cells and those without a river have none.
    """

    def parts(a: Arrays, p: Place) -> pd.DataFrame:
        c, v = p.core(a[clump]), a[value]
        own = c > 0
        size = pd.DataFrame({"clump": c[own], "area": 1, "peak": v[own]}).groupby("clump", as_index=False).agg(area=("area", "sum"), peak=("peak", "max"))
        river = c == RIVER
        seen = [pd.DataFrame({"clump": s[river & (s > 0)], "river": v[river & (s > 0)], "std": a[std][river & (s > 0)]}) for s in beside(a[clump], p)]
        rim = pd.concat(seen).sort_values(["clump", "river"]).drop_duplicates("clump", keep="last")
        return size.merge(rim, on="clump", how="outer").astype({"clump": "int64"})[["clump", "area", "peak", "river", "std"]]

    got = b.rows(parts, "clump long, area double, peak double, river double, std double", 1, [clump])
    whole = got.groupBy("clump").agg(F.sum("area").alias("area"), F.max("peak").alias("peak"), F.max(F.struct("river", "std")).alias("r"))
    return whole.where((F.col("area") > area) & F.col("r.river").isNotNull()).select("clump", ((F.col("peak") - F.col("r.river")) / F.col("r.std")).alias("sn"))


def rivers(b: Blocks, value: str, clump: str, std: str, least: int, sn: float, cpscorr: float = 1.0) -> DataFrame:
    """(cell, from), both ways: clumps whose common river has more than ``least`` cells and is bright enough to make them one object."""

    def parts(a: Arrays, p: Place) -> pd.DataFrame:
        c, v = p.core(a[clump]), a[value]
        at = np.flatnonzero((c == RIVER).ravel())
        seen = np.stack([s.ravel()[at] for s in beside(a[clump], p)], axis=1)
        bright = np.stack([p.core(shifted(v, dx, dy, 0.0)).ravel()[at] for dx, dy in STEPS], axis=1)
        mean = (np.where(seen > 0, bright, 0.0).sum(axis=1) + p.core(v).ravel()[at]) / ((seen > 0).sum(axis=1) + 1)
        noise = a[std].ravel()[at] ** 2
        out = []
        for k, row in enumerate(seen):
            own = np.unique(row[row > 0])
            out += [(int(x), int(y), float(mean[k]), float(noise[k])) for i, x in enumerate(own) for y in own[i + 1 :]]
        return pd.DataFrame(out, columns=["a", "b", "ave", "var"]).groupby(["a", "b"], as_index=False).agg(n=("ave", "size"), ave=("ave", "sum"), var=("var", "sum")).astype({"a": "int64", "b": "int64"})

    got = b.rows(parts, "a long, b long, n long, ave double, var double", 1, [clump, value])
    both = got.groupBy("a", "b").agg(F.sum("n").alias("n"), (F.sum("ave") / F.sum("n")).alias("ave"), (F.sum("var") / F.sum("n")).alias("var"))
    strong = F.sqrt(F.lit(1 / cpscorr)) * F.col("ave") / F.sqrt(F.greatest(F.abs(F.col("ave")) + F.col("var"), F.lit(1e-12)))
    good = both.where((F.col("n") > least) & (strong > sn))
    return good.select(F.col("a").alias("cell"), F.col("b").alias("from")).unionByName(good.select(F.col("b").alias("cell"), F.col("a").alias("from")))


FAR = 1 << 40  # labels lie below it; above it a cell's distance


def spread(b: Blocks, label: str, seed: str, out: str) -> Blocks:
    """With the layer ``out``: each labelled cell has the value of the nearest seed within its label, by steps; of equally near ones the least.

    Distance and value are one number that falls to its least; blocks settle on their own and meet at their rims in rounds.
    """
    none = np.iinfo(np.int64).max // 2
    state = b.mapped(lambda a, p: {out: np.where(a[seed] > 0, a[seed], none)}, {out: "i8"}, tag="spread")
    while True:

        def step(a: Arrays, p: Place) -> Arrays:
            key, lab = np.where(a[out] > 0, a[out], none), a[label]
            inner = np.zeros(key.shape, bool)
            inner[1:-1, 1:-1] = True
            inner &= lab > 0
            before = key.copy()
            while True:
                low = key
                for dx, dy in STEPS:
                    near = np.where(shifted(lab, dx, dy, 0) == lab, shifted(key, dx, dy, none), none)
                    low = np.minimum(low, np.where(near < none, near + FAR, none))
                low = np.where(inner, low, key)
                if (low == key).all():
                    break
                key = low
            return {out: p.core(key), "_moved": np.array(p.core(key != before), np.uint8)}

        new = state.mapped(step, {out: "i8", "_moved": "u1"}, 1, [out, label], tag="spread")
        discard(state.df)
        state = new
        if not state.rows(lambda a, p: pd.DataFrame({"n": [int(a["_moved"].sum())]}), "n long").agg(F.sum("n")).first()[0]:
            return state.mapped(lambda a, p: {out: np.where(a[out] < none, a[out] % FAR, 0)}, {out: "i8"}, drop=["_moved"], tag="spread")
