"""Interpolation between the known values of groups, along an ordered column.

Steffen's and Akima's splines have slopes that depend on a few neighbours alone, which windows over blocks reach.  The natural and
periodic cubic splines solve a system of three diagonals over a group of any size: blocks of known points are
solved side by side, each up to the two values beyond its ends; these, two for each block, make a small system, and its
solution gives every block its own.  The periodic system differs from one of three diagonals by a rank of one.
The polynomial goes through all points of a group and is for few.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.along import BLOCK, fill_between, placed
from ..plans.lineage import cut


def _slope(how: str, at) -> Column:
    """The derivative at a known point from its neighbours; ``at(k)`` is the k-th (x, y) after it, a NULL struct beyond the ends."""
    x, y = (lambda k: at(k)["x"]), (lambda k: at(k)["y"])
    step = lambda k: x(k + 1) - x(k)
    rise = lambda k: F.try_divide(y(k + 1) - y(k), step(k))
    if how == "steffen":
        before, after = rise(-1), rise(0)
        p = F.try_divide(before * step(0) + after * step(-1), step(-1) + step(0))
        middle = (F.signum(before) + F.signum(after)) * F.least(F.abs(before), F.abs(after), 0.5 * F.abs(p))
        return F.coalesce(middle, after, before, F.lit(0.0))
    if how != "akima":
        raise ValueError(f"no local spline {how!r}")
    # beyond an end the slopes go on in a straight line
    m0, m1 = F.coalesce(rise(0), 2 * rise(-1) - rise(-2)), F.coalesce(rise(-1), 2 * rise(0) - rise(1))
    m2 = F.coalesce(rise(1), 2 * m0 - m1)
    m_1 = F.coalesce(rise(-2), 2 * m1 - m0)
    left, right = F.abs(m2 - m0), F.abs(m1 - m_1)
    return F.coalesce(F.when(left + right > 0, F.try_divide(left * m1 + right * m0, left + right)).otherwise((m1 + m0) / 2), m0, m1, F.lit(0.0))


def fill_local(df: DataFrame, x: str, y: str, by: Sequence[str], how: str = "steffen", block: int | None = None) -> DataFrame:
    """Blanks of ``y`` between known values on a spline of local slopes; those beyond the known ones stay blank."""

    def value(at: Column, a: Column, b: Column) -> Column:
        h = b["x"] - a["x"]
        t = (at - a["x"]) / F.nullif(h, F.lit(0.0))
        return a["y"] * (1 + 2 * t) * (1 - t) * (1 - t) + a["s"] * h * t * (1 - t) * (1 - t) + b["y"] * t * t * (3 - 2 * t) - b["s"] * h * t * t * (1 - t)

    return fill_between(df, x, y, by, value, lambda at: _slope(how, at), 2, block)


def cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray, periodic: bool = False) -> np.ndarray:
    """The natural cubic spline of sorted points, or the periodic one, whose last point repeats the first."""
    n = len(x) - 1
    h, rise = np.diff(x), np.diff(y) / np.diff(x)
    if periodic:
        a = np.zeros((n, n))
        for i in range(n):
            a[i, i - 1] += h[i - 1]
            a[i, i] += 2 * (h[i - 1] + h[i])
            a[i, (i + 1) % n] += h[i]
        m = np.linalg.solve(a, 6 * (rise - np.roll(rise, 1)))
        m = np.append(m, m[0])
    else:
        m = np.zeros(n + 1)
        diagonal, right = 2 * (h[:-1] + h[1:]), 6 * np.diff(rise)
        for i in range(1, n - 1):  # the system has three diagonals
            f = h[i] / diagonal[i - 1]
            diagonal[i] -= f * h[i]
            right[i] -= f * right[i - 1]
        for i in range(n - 2, -1, -1):
            m[i + 1] = (right[i] - (h[i + 1] * m[i + 2] if i < n - 2 else 0)) / diagonal[i]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 1)
    a, b = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    return a * y[k] + b * y[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h[k] ** 2 / 6


def polynomial(x: np.ndarray, y: np.ndarray, at: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """The polynomial through all points, by divided differences; for few points.

    x, y: the points along the first axis; with ``of``, those of one group a column, and of which of them each place asks.
    """
    c = y.astype(float).copy()
    for k in range(1, len(x)):
        c[k:] = (c[k:] - c[k - 1 : -1]) / (x[k:] - x[:-k])
    mine = (lambda a: a) if of is None else (lambda a: a[of])
    out = np.full(len(at), mine(c[-1]))
    for k in range(len(x) - 2, -1, -1):
        out = out * (at - mine(x[k])) + mine(c[k])
    return out


def fill_polynomial(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Blanks of ``y`` between known values on the polynomial through all of them; a group must fit in a task.

    Groups lie one behind the other, so many small ones are worked out at once.
    """
    out, by = df.withColumn(y, F.col(y).cast("double")), list(by)
    quoted = [F.col(f"`{b}`") for b in by]
    dealt = out.repartition(*quoted).sortWithinPartitions(*quoted, x)

    def starts(d: pd.DataFrame) -> np.ndarray:
        """Whether each row begins a group."""
        new = np.ones(len(d), bool)
        new[1:] = False
        for b in by:
            now, old = d[b].iloc[1:].reset_index(drop=True), d[b].iloc[:-1].reset_index(drop=True)
            new[1:] |= ~((now == old) | (now.isna() & old.isna())).to_numpy(bool)
        return new

    def run(frames):
        kept: list[pd.DataFrame] = []  # the last group so far, which may go on
        for d in frames:
            if not len(d):
                continue
            joined = pd.concat([kept[-1].iloc[-1:], d], ignore_index=True) if kept else d
            first = np.flatnonzero(starts(joined)[1:] if kept else starts(joined))
            first = first[first > 0] if not kept else first
            if len(first):
                yield filled(pd.concat([*kept, d.iloc[: first[-1]]], ignore_index=True))
                kept = []
            kept.append(d.iloc[first[-1] :] if len(first) else d)
        if kept:
            yield filled(pd.concat(kept, ignore_index=True))

    def filled(d: pd.DataFrame) -> pd.DataFrame:
        if not len(d):
            return d
        group = np.cumsum(starts(d)) - 1
        at, values = d[x].to_numpy(float), d[y].to_numpy(float).copy()
        known = np.flatnonzero(~np.isnan(values))
        count = np.bincount(group[known], minlength=group[-1] + 1)
        first = np.cumsum(count) - count  # of each group, among the known
        xs, ys = at[known], values[known]
        free = np.flatnonzero(np.isnan(values) & (count[group] >= 2))
        low, high = xs[first[group[free]]], xs[first[group[free]] + count[group[free]] - 1]
        free = free[(at[free] > low) & (at[free] < high)]
        for m in np.unique(count[group[free]]):
            rows = free[count[group[free]] == m]
            own, of = np.unique(group[rows], return_inverse=True)
            places = first[own][:, None] + np.arange(m)
            values[rows] = polynomial(xs[places].T, ys[places].T, at[rows], of)
        return d.assign(**{y: values})

    return dealt.mapInPandas(run, out.schema)


ENDS = ["n", "x0", "y0", "x1", "xa", "ya", "xb", "yb"]  # the number of points, the first two and the last two


def _parts(k: np.ndarray, x: np.ndarray, y: np.ndarray, first: int, last: int, e: dict, periodic: bool) -> np.ndarray:
    """The unknowns first .. last of a block as p + w * factor + q * before + r * behind: columns p, w, q, r.

    k, x, y: the block's known points and those beside it, in order.
    """
    n, rows = int(e["n"]), last - first + 1
    j = np.searchsorted(k, np.arange(first, last + 1))
    low, mid, high, right = np.zeros(rows), np.ones(rows), np.zeros(rows), np.zeros((rows, 4))
    inner = np.ones(rows, bool) if periodic else (k[j] > 0) & (k[j] < n - 1)  # a natural spline is straight at its ends
    i = j[inner]
    left = np.maximum(i - 1, 0)
    h, rise = x[i + 1] - x[i], (y[i + 1] - y[i]) / (x[i + 1] - x[i])
    with np.errstate(divide="ignore", invalid="ignore"):
        h0, rise0 = x[i] - x[left], (y[i] - y[left]) / (x[i] - x[left])
    if periodic:
        corner = e["xb"] - e["xa"]
        diagonal = 2 * (corner + e["x1"] - e["x0"])  # of the first row
        start, end = k[i] == 0, k[i] == n - 2
        h0, rise0 = np.where(start, corner, h0), np.where(start, (e["yb"] - e["ya"]) / corner, rise0)
    low[inner], mid[inner], high[inner], right[inner, 0] = h0, 2 * (h0 + h), h, 6 * (rise - rise0)
    if periodic:  # the corners are the product of (-diagonal, 0 .., corner) and (1, 0 .., -corner / diagonal)
        low[start], high[end] = 0, 0
        mid[start] += diagonal
        mid[end] += corner**2 / diagonal
        right[start, 1] -= diagonal
        right[end, 1] += corner
    right[0, 2], right[-1, 3] = -low[0], -high[-1]
    for r in range(1, rows):
        f = low[r] / mid[r - 1]
        mid[r] -= f * high[r - 1]
        right[r] -= f * right[r - 1]
    for r in range(rows - 1, -1, -1):
        right[r] = (right[r] - (high[r] * right[r + 1] if r < rows - 1 else 0)) / mid[r]
    return right


def _reduced(g: pd.DataFrame, e: dict, periodic: bool) -> pd.DataFrame:
    """What each block takes from beside it: its rows' first and last unknowns as affine parts become a system of five diagonals."""
    m = len(g)
    a, right = np.zeros((2 * m, 7)), np.zeros((2 * m, 2))  # diagonals -3 .. 3
    for b, r in enumerate(g.itertuples()):
        for row, (p, w, q, v) in ((2 * b, (r.pf, r.wf, r.qf, r.rf)), (2 * b + 1, (r.pl, r.wl, r.ql, r.rl))):
            a[row, 3] = 1
            if b:
                a[row, 3 + 2 * b - 1 - row] = -q
            if b < m - 1:
                a[row, 3 + 2 * b + 2 - row] = -v
            right[row] = p, w
    for row in range(2 * m):
        for below in range(row + 1, min(row + 4, 2 * m)):
            f = a[below, 3 + row - below] / a[row, 3]
            if f:
                for c in range(row, min(row + 4, 2 * m)):
                    a[below, 3 + c - below] -= f * a[row, 3 + c - row]
                right[below] -= f * right[row]
    for row in range(2 * m - 1, -1, -1):
        for c in range(row + 1, min(row + 4, 2 * m)):
            right[row] -= a[row, 3 + c - row] * right[c]
        right[row] /= a[row, 3]
    factor = 0.0
    if periodic:
        corner = e["xb"] - e["xa"]
        slope = -corner / (2 * (corner + e["x1"] - e["x0"]))
        factor = -(right[0, 0] + slope * right[-1, 0]) / (1 + right[0, 1] + slope * right[-1, 1])
    whole = right[:, 0] + factor * right[:, 1]
    lasts, firsts = whole[1::2], whole[0::2]
    return pd.DataFrame({"_b": g["_b"].to_numpy(), "before": np.append(0.0, lasts[:-1]), "behind": np.append(firsts[1:], firsts[0] if periodic else 0.0), "factor": factor})


def fill_cubic(df: DataFrame, x: str, y: str, by: Sequence[str], periodic: bool = False, block: int | None = None) -> DataFrame:
    """Blanks of ``y`` between known values on the natural cubic spline, or on the periodic one, whose last point repeats the first.

    Groups with fewer than three known points keep theirs, and what lies beyond the known ones stays blank.
    """
    block, by = block or BLOCK, list(by)
    out = df.withColumn(y, F.col(y).cast("double"))
    columns, numbered = out.columns, placed(out, x, y, by)
    counts = out.groupBy(*by).agg(F.count(y).alias("n"))
    keys = [F.col(f"`{b}`").alias(f"_by{i}") for i, b in enumerate(by)]
    renamed = [f"_by{i}" for i in range(len(by))]
    known = numbered.select("*", *keys)
    same = lambda l, r, names: [l[n].eqNullSafe(r[f"_{n}"]) for n in names]  # noqa: E731, E741
    ns = cut(counts.select(*[F.col(f"`{b}`").alias(f"__by{i}") for i, b in enumerate(by)], "n"), "points")
    own = F.floor(F.greatest(F.col("_k"), F.lit(0)) / block).cast("long")
    # a point at a block's end is also beside the next block
    is_known = F.col(y).isNotNull()
    beside = F.array_compact(F.array(F.when(is_known & (F.col("_k") % block == 0) & (F.col("_k") > 0), own - 1), F.when(is_known & (F.col("_k") % block == block - 1), own + 1)))
    rows = cut(known.withColumn("_b", F.explode(F.concat(F.array(own), beside))).withColumn("_beside", F.col("_b") != own), "rows")
    # the first and last two points of each group, by the numbers of its points
    edge = known.where(is_known).select(*renamed, "_k", F.col(x).cast("double").alias("_x"), F.col(y).alias("_y"))
    joined = edge.join(F.broadcast(ns), same(edge, ns, renamed)) if ns.count() <= 100_000 else edge.join(ns, same(edge, ns, renamed))
    pick = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    ends = joined.groupBy(*renamed).agg(F.first("n").alias("n"), pick(0, "_x").alias("x0"), pick(0, "_y").alias("y0"), pick(1, "_x").alias("x1"), pick(F.col("n") - 2, "_x").alias("xa"), pick(F.col("n") - 2, "_y").alias("ya"), pick(F.col("n") - 1, "_x").alias("xb"), pick(F.col("n") - 1, "_y").alias("yb"))
    ends = cut(ends.where("n >= 3"), "ends")
    each = rows.where("NOT _beside").select(*renamed, "_b").distinct()
    others = ends.withColumnsRenamed({n: f"_{n}" for n in renamed})
    told = cut(each.join(others, same(each, others, renamed)).select(*renamed, "_b", *ENDS), "told")
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in renamed)

    def points(g: pd.DataFrame, t: pd.DataFrame):
        """(k, x, y, first, last) of a block's known points; None if it has no unknowns."""
        e = t.iloc[0].to_dict()
        d = g[g[y].notna()].sort_values("_k")
        first = int(t["_b"].iloc[0]) * block
        last = min(first + block, int(e["n"]) - (1 if periodic else 0)) - 1
        return None if last < first else (d["_k"].to_numpy(), d[x].to_numpy(float), d[y].to_numpy(float), first, last, e)

    def reduce(g: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        got = points(g, t) if len(g) and len(t) else None
        if got is None:
            return pd.DataFrame(columns=[*renamed, "_b", *ENDS, "pf", "wf", "qf", "rf", "pl", "wl", "ql", "rl"])
        parts = _parts(*got, periodic)
        return t.assign(**dict(zip(("pf", "wf", "qf", "rf"), parts[0])), **dict(zip(("pl", "wl", "ql", "rl"), parts[-1])))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_b").reset_index(drop=True)
        got = _reduced(g, g.iloc[0].to_dict(), periodic)
        return pd.concat([g[renamed], got, g[ENDS]], axis=1)

    def fill(g: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        mine = g[~g["_beside"].astype(bool)]
        got = points(g, t) if len(mine) and len(t) else None
        if got is None:
            return mine[columns]
        k, xs, ys, first, last, e = got
        parts = _parts(*got, periodic)
        m = parts @ np.array([1.0, e["factor"], e["before"], e["behind"]])
        m = np.append(m, e["behind"])
        values, at_x, at_k = mine[y].to_numpy(float).copy(), mine[x].to_numpy(float), mine["_k"].to_numpy()
        free = np.isnan(values) & (at_k >= 0) & (at_k < e["n"] - 1)
        i = np.searchsorted(k, at_k[free])
        h = xs[i + 1] - xs[i]
        a, b = (xs[i + 1] - at_x[free]) / h, (at_x[free] - xs[i]) / h
        m0, m1 = m[at_k[free] - first], m[at_k[free] - first + 1]
        values[free] = a * ys[i] + b * ys[i + 1] + ((a**3 - a) * m0 + (b**3 - b) * m1) * h**2 / 6
        return mine.assign(**{y: values})[columns]

    numbers = ", ".join(f"{n} {'long' if n == 'n' else 'double'}" for n in ENDS)
    block_keys = [*renamed, "_b"]
    parts = rows.groupBy(*block_keys).cogroup(told.groupBy(*block_keys)).applyInPandas(reduce, f"{kinds}, _b long, {numbers}, pf double, wf double, qf double, rf double, pl double, wl double, ql double, rl double")
    # a row for each block of a group
    beyond = cut(parts.groupBy(*renamed).applyInPandas(solve, f"{kinds}, _b long, before double, behind double, factor double, {numbers}"), "beyond")
    return rows.groupBy(*block_keys).cogroup(beyond.groupBy(*block_keys)).applyInPandas(fill, out.schema)


def fill_whole(df: DataFrame, x: str, y: str, by: Sequence[str], how: str = "cspline") -> DataFrame:
    """Blanks of ``y`` between known values by cspline, periodic or polynomial; groups with too few points keep theirs."""
    if how not in ("cspline", "periodic", "polynomial"):
        raise ValueError(f"no spline {how!r}")
    return fill_polynomial(df, x, y, by) if how == "polynomial" else fill_cubic(df, x, y, by, how == "periodic")
