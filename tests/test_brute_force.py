"""Queries without SQL against plain numpy and Python."""

from __future__ import annotations

import itertools
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.operators import blocks, catalog, detect, frequency, generators, grid, match, polygons, programs, splines, statistics, tessellation, watershed
from tessella.plans import lineage, side_files
from tessella.plans.skew import spread_join
from tessella.plans.table import positions
from tessella.queries import QUERIES, more
from tessella.queries.more import PLANE
from tessella.sources import fits, registry

SF = "/root/testdata/sf0.001"


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def run(spark, name):
    return QUERIES[name](spark, SF).toPandas()


def values_by(name, key, value):
    return {k: np.sort(g[value].to_numpy(float)) for k, g in table(name).groupby(key)}


def image_cells():
    e = table("events")
    g = e.groupby([e["user_id"] % 24 + 1, e["event_id"] // 330 + 1])["value"].sum()
    return {(int(x), int(y)): float(v) for (x, y), v in g.items()}


N4 = [(1, 0), (-1, 0), (0, 1), (0, -1)]
N8 = [d for d in itertools.product((-1, 0, 1), repeat=2) if any(d)]


def components(cells, steps):
    """cell -> number, in raster order."""
    label, n = {}, 0
    for c in sorted(cells, key=lambda c: c[::-1]):
        if c in label:
            continue
        n += 1
        label[c], queue = n, [c]
        while queue:
            x, y = queue.pop()
            for i, j in steps:
                if (d := (x + i, y + j)) in cells and d not in label:
                    label[d] = n
                    queue.append(d)
    return label


# statistics


def test_sigma_clip_tolerance(spark):
    got = run(spark, "stat_sigma_clip_tolerance").set_index("event_type")
    for k, v in values_by("events", "event_type", "value").items():
        assert np.allclose(got.loc[k, ["number", "median", "mean", "std"]].astype(float), statistics.sigma_clip_array(v, 3.0, 0.2))


def test_mode(spark):
    want = {k: statistics.mode_of_sorted(v) for k, v in values_by("lineitem", "l_returnflag", "l_extendedprice").items()}
    got = run(spark, "stat_mode").set_index("l_returnflag")
    assert all(np.allclose(got.loc[k].astype(float), w, equal_nan=True) for k, w in want.items())


def test_mode_of_large_groups(spark):
    """By probes on ranked values, the same as in memory."""
    rng = np.random.default_rng(7)
    groups = {"a": np.append(rng.normal(5, 1, 30000), rng.uniform(5, 15, 6000)).round(3), "b": rng.exponential(1, 9000), "c": rng.integers(0, 30, 5000).astype(float), "n": rng.normal(0, 1, 4321), "small": rng.normal(2, 1, 700), "flat": np.full(3000, 2.0)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v]
    d = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "v"]), "k string, v double").repartition(6)
    got = {r["k"]: tuple(np.nan if x is None else x for x in r[1:]) for r in statistics.mode(d, ["k"], "v", most=2500).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert np.array_equal(got[k], statistics.mode_of_sorted(np.sort(v)), equal_nan=True), k
    assert abs(got["a"][0] - 5) < 0.3


def test_report(spark):
    v = np.sort(table("lineitem")["l_extendedprice"].to_numpy())
    r = run(spark, "stat_report").iloc[0]
    want = {"number": len(v), "minimum": v[0], "maximum": v[-1], "sum": v.sum(), "mean": v.mean(), "std": v.std(), "median": np.median(v)}
    want |= dict(zip(("mode", "modequant", "modesym", "modesymvalue"), statistics.mode_of_sorted(v)))
    assert set(r.index) == set(want) and all(np.isclose(r[k], x, equal_nan=True) for k, x in want.items())


def test_ranks_medians_and_ties(spark):
    rng = np.random.default_rng(1)
    d = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 3000, p=[0.7, 0.29, 0.01]), "v": np.where(rng.random(3000) < 0.4, 2.0, rng.normal(0, 3, 3000).round(1))})
    d.loc[::50, "v"] = None
    s = spark.createDataFrame(d)
    got = {r["k"]: r["median"] for r in statistics.medians(s, ["k"], "v").collect()}
    want = d.groupby("k")["v"].median()
    assert all(math.isclose(got[k], want[k]) for k in want.index)
    v = np.sort(d["v"].dropna().to_numpy())
    for r in statistics.quantiles(s, "v", [0.0, 0.1, 0.5, 0.77, 1.0]).collect():
        assert r["value"] == v[statistics.rank_of_quantile(len(v), r["q"])]
    at = positions(s, "v").orderBy("_at").toPandas()
    assert list(at["_at"]) == list(range(1, 3001)) and at["v"].dropna().is_monotonic_increasing


def first_by_distance(v, window, sigma):
    for i in range(window, len(v)):
        gaps = [v[i - window + j + 1] - v[i - window + j] for j in range(window - 1)]
        _, med, _, std = statistics.sigma_clip_array(np.array(gaps), 3.0, 0.2)
        if v[i] - v[i - 1] - med > sigma * std:
            return v[i - 1]
    return None


def first_flat(v, previous, threshold, contiguous):
    slopes = {p: v[p + 2] - v[p - 2] for p in range(2, len(v) - 2)}
    count = 0
    for p in range(2 + previous, len(v) - 2):
        _, med, _, std = statistics.sigma_clip_array(np.array([slopes[q] for q in range(p - previous, p)]), 3.0, 0.2)
        count = count + 1 if std > 1e-6 and (slopes[p] - med) / std > threshold else 0
        if count == contiguous:
            return v[p - contiguous + 1]
    return None


def test_outliers(spark):
    by = values_by("events", "event_type", "value")
    for name, find in (("stat_outlier_distance", lambda v: first_by_distance(v, 50, 20.0)), ("stat_outlier_flat", lambda v: first_flat(v, 50, 6.0, 3))):
        got = {r["event_type"]: None if pd.isna(r["outlier"]) else r["outlier"] for _, r in run(spark, name).iterrows()}
        assert got == {k: find(v) for k, v in by.items()}, name
    rng = np.random.default_rng(4)
    v = np.sort(np.concatenate([rng.normal(0, 1, 700), [30.0, 31, 33, 60]]))
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "v": v}))
    find = lambda x: statistics.distance_hits(x, 20, 12.0, (3.0, 0.2))
    small = statistics.first_hit(d, ["k"], "v", find, 20, 1, block=64).head()["outlier"]
    assert small == first_by_distance(v, 20, 12.0) == statistics.outlier_by_distance(d, ["k"], "v", 20, 12.0).head()["outlier"]
    flat = statistics.first_hit(d, ["k"], "v", lambda x: statistics.flat_hits(x, 30, 8.0, 2, (3.0, 0.2)), 34, 4, block=50).head()["outlier"]
    assert flat == first_flat(v, 30, 8.0, 2)


def test_ascii_histogram(spark):
    v = table("lineitem")["l_extendedprice"].to_numpy()
    n = np.histogram(v, 60)[0]
    rows = ["".join("*" if c > 0 and c * 10 / n.max() >= level - 0.5 else " " for c in n) for level in range(10, 0, -1)]
    assert list(run(spark, "stat_ascii_histogram").sort_values("line")["text"]) == [f" |{r}" for r in rows] + [" |" + "-" * 60]


# grids


def filled(tiles, number, how):
    """Blanks from their nearest tiles: nearest first, then by coordinates."""
    full = {t: v for t, v in tiles.items() if v is not None}
    out = {}
    for t, v in tiles.items():
        if v is None and full:
            near = sorted(full, key=lambda s: (math.dist(s, t), s))[: min(number, len(full))]
            v = how([full[s] for s in near])
        out[t] = v
    return out


def by_tile(cells, width):
    out = {}
    for (x, y), v in cells.items():
        out.setdefault(((x - 1) // width, (y - 1) // width), []).append(v)
    return out


def test_sky(spark):
    tiles = by_tile(image_cells(), 6)
    sky, std = {}, {}
    for t, v in tiles.items():
        v = np.array(v)
        good = abs((v <= v.mean()).mean() - 0.5) <= 0.2
        _, _, mean, dev = statistics.sigma_clip_array(v, 3.0, 0.2)
        sky[t], std[t] = (mean, dev) if good and dev > 0 else (None, None)
    got = {(r["tx"], r["ty"]): (r["sky"], r["std"]) for _, r in run(spark, "grid_sky").iterrows()}
    for k, layer in ((0, sky), (1, std)):
        whole = filled(layer, 5, np.median)
        for t in tiles:
            box = [whole[s] for s in whole if abs(s[0] - t[0]) <= 1 and abs(s[1] - t[1]) <= 1 and whole[s] is not None]
            assert math.isclose(got[t][k], np.mean(box), rel_tol=1e-9), (t, k)


def thresholds(cells, width, q, most):
    out = {}
    for t, v in by_tile(cells, width).items():
        v = np.sort(v)
        out[t] = v[math.ceil((len(v) - 1) * q - 0.5)] if abs((v <= v.mean()).mean() - 0.5) <= most else None
    return filled(out, 5, np.median)


def initial(cells, width, q, no_erode, most):
    low, high = thresholds(cells, width, q, most), thresholds(cells, width, no_erode, most)
    at = lambda c: ((c[0] - 1) // width, (c[1] - 1) // width)
    on = {c for c, v in cells.items() if low[at(c)] is not None and v > low[at(c)]} | {c for c, v in cells.items() if high[at(c)] is not None and v > high[at(c)]}
    off = set(cells) - on
    eroded = {c for c in on if not any((c[0] + i, c[1] + j) in off for i, j in N8)}
    opened = eroded | {c for c in cells if any((c[0] + i, c[1] + j) in eroded for i, j in N8)}
    return components(opened, N8)


def test_initial_detection(spark):
    cells = image_cells()
    want = initial(cells, 6, 0.5, 0.99, 0.2)
    got = {(r["x"], r["y"]): r["label"] for _, r in run(spark, "detect_initial").iterrows()}
    assert got == {c: want.get(c, 0) for c in cells}


def flood(cells, on):
    """(label, cell) -> clump, river -1."""
    out = {}
    for label in sorted(set(on.values())):
        at, n = {}, 0
        for c in sorted((c for c in on if on[c] == label), key=lambda c: (-cells[c], c[1], c[0])):
            near = {at[d] for i, j in N8 if (d := (c[0] + i, c[1] + j)) in at and at[d] > 0}
            if not near:
                n += 1
            at[c] = n if not near else near.pop() if len(near) == 1 else -1
        out |= {(label, c): k for c, k in at.items()}
    return out


def test_watershed_significance_and_pairs(spark):
    cells = image_cells()
    clumps = flood(cells, components({c for c, v in cells.items() if v > 650}, N8))
    got = {(int(r["label"]), (int(r["x"]), int(r["y"]))): int(r["clump"]) for _, r in run(spark, "segment_watershed").iterrows()}
    assert got == clumps
    want = {}
    for label, clump in {(label, k) for (label, _), k in clumps.items() if k > 0}:
        own = [c for (la, c), k in clumps.items() if (la, k) == (label, clump)]
        river = {d for c in own for i, j in N8 if clumps.get((label, d := (c[0] + i, c[1] + j))) == -1}
        if len(own) > 1 and river:
            want[label, clump] = (max(cells[c] for c in own) - np.mean([cells[d] for d in river])) / 50
    found = run(spark, "segment_clump_significance")
    assert {(r["label"], r["clump"]) for _, r in found.iterrows()} == set(want)
    assert all(math.isclose(r["significance"], want[r["label"], r["clump"]], rel_tol=1e-9) for _, r in found.iterrows())
    edges = {}
    for (label, c), k in clumps.items():
        if k == -1:
            near = {d: clumps[label, d] for i, j in N8 if clumps.get((label, d := (c[0] + i, c[1] + j)), 0) > 0}
            ave = (sum(cells[d] for d in near) + cells[c]) / (len(near) + 1)
            for a, b in itertools.combinations(sorted(set(near.values())), 2):
                edges.setdefault((label, a, b), []).append(ave)
    strong = {e for e, v in edges.items() if len(v) > 1 and np.mean(v) / math.sqrt(np.mean(v) + 2500) > 1}
    assert {tuple(map(int, r)) for r in run(spark, "segment_clump_pairs").to_numpy()} == strong


def test_projection_by_overlaps(spark):
    m = np.array(generators.warp_matrix([("rotate", 20), ("shear", 0.1, 0.0), ("translate", 3.0, 2.0), ("project", 0.001, 0.0)]))
    area, total = {}, {}
    for (x, y), v in image_cells().items():
        quad = [(p[0] / p[2], p[1] / p[2]) for p in (m @ [x - i, y - j, 1] for i, j in ((1, 1), (0, 1), (0, 0), (1, 0)))]
        shoelace = lambda ps: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ps, ps[1:] + ps[:1]))) / 2
        xs, ys = zip(*quad)
        for i in range(math.floor(min(xs)), math.ceil(max(xs))):
            for j in range(math.floor(min(ys)), math.ceil(max(ys))):
                part = polygons.clipped(quad, [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)])
                w = shoelace(part) if part else 0.0
                area[i + 1, j + 1] = area.get((i + 1, j + 1), 0) + w
                total[i + 1, j + 1] = total.get((i + 1, j + 1), 0) + v * w / shoelace(quad)
    got = {(r["x"], r["y"]): r["v"] for _, r in run(spark, "warp_project").iterrows()}
    assert set(got) == {c for c, a in area.items() if a > 1e-9}
    for c, v in got.items():
        assert pd.isna(v) if area[c] < 0.9 - 1e-9 else math.isclose(v, total[c], rel_tol=1e-6)


def test_components_across_blocks(spark):
    rng = np.random.default_rng(3)
    for shape, connectivity, steps in (((40, 30), 1, N4), ((40, 30), 2, N8)):
        cells = {(int(x) + 1, int(y) - 3) for x, y in np.argwhere(rng.random(shape) < 0.55)}
        want = components(cells, steps)
        got = grid.label_components(spark.createDataFrame(sorted(cells), "x int, y int"), connectivity, side=4).collect()
        first = {}
        for c, n in want.items():
            first.setdefault(n, min((d for d in cells if want[d] == n), key=lambda c: c[::-1]))
        assert {(r["x"], r["y"]): tuple((r["root"]["x"], r["root"]["y"])) for r in got} == {c: first[n] for c, n in want.items()}


def test_interpolation_reaches_far(spark):
    cells = spark.createDataFrame([(1, 1, 5.0), (20001, 1, None), (30000, 9000, 7.0)], "x int, y int, v double")
    assert {r["v"] for r in grid.interpolate_neighbours(cells, 1, "min").collect()} == {5.0, 7.0}


# detection as programs


def blobs(seed=2, size=48):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[1 : size + 1, 1 : size + 1]
    v = rng.normal(100, 2, (size, size))
    spots = [(12, 12), (35, 14), (20, 36), (28, 36)]
    for cx, cy in spots:
        v += 120 * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * 2.2**2))
    return v, spots


def test_programs_find_what_was_planted(spark):
    v, spots = blobs()
    cells = spark.createDataFrame(pd.DataFrame([(i + 1, j + 1, v[j, i]) for j in range(48) for i in range(48)], columns=["x", "y", "v"])).selectExpr("cast(x as int) x", "cast(y as int) y", "v")
    found = programs.detections(cells, programs.Detection(tile=[12, 12], large=[24, 24], q=0.7, erode=1, most=0.45, area=4, sn_q=0.8, grow_q=0.95, neighbours=5, free=0.3)).cache()
    label = {(r["x"], r["y"]): r["label"] for r in found.collect()}
    at = [label[s] for s in spots]
    assert all(at) and at[0] != at[1] and len({label[s] for s in spots[:2]} | {at[2], at[3]}) in (3, 4)
    bright = {(i + 1, j + 1) for j in range(48) for i in range(48) if v[j, i] > 130}
    assert all(label[c] for c in bright) and sum(x > 0 for x in label.values()) < 6 * len(bright)
    background = found.agg(F.avg("sky")).head()[0]
    assert abs(background - 100) < 2
    parts = programs.segment(found.join(cells, ["x", "y"]), programs.Segmentation(large=[24, 24], q=0.9, area=1, near_river=True, object_sn=1000.0)).collect()
    assert {(r["x"], r["y"]) for r in parts} == {c for c, k in label.items() if k}
    own = {(r["x"], r["y"]): (r["object"], r["clump"]) for r in parts}
    assert len({own[s][0] for s in spots}) == 4 and all(k[0] > 0 for k in own.values())


def test_tile_outliers(spark):
    rng = np.random.default_rng(5)
    rows = [(x, y, float(rng.normal(10, 1))) for x in range(9) for y in range(8)]
    rows[30] = (*rows[30][:2], 400.0)
    rows[50] = (*rows[50][:2], None)
    d = spark.createDataFrame(rows, "tx int, ty int, v double")
    for f in (lambda t: detect.tile_outliers_global(t, sigma=100.0), lambda t: detect.tile_outliers_local(t, sigma=30.0)):
        got = {(r["tx"], r["ty"]): r["v"] for r in f(d).collect()}
        assert got == {(x, y): None if v == 400.0 else v for x, y, v in rows}
    few = spark.createDataFrame([(k, 0, 1000.0 if k == 2 else float(k)) for k in range(5)], "tx int, ty int, v double")
    assert detect.tile_outliers_global(few, sigma=0.1).where("v IS NULL").count() == 0
    cells = image_cells()
    tiles = {}
    for (x, y), v in cells.items():
        if (x * 7 + y * 3) % 11:
            tiles.setdefault(((x - 1) // 4, (y - 1) // 3), []).append(v)
    tiles = {k: np.mean(v) * (40 if k[0] * 7 + k[1] * 5 == 24 else 1) for k, v in tiles.items()}
    v = np.sort(list(tiles.values()))
    high, low = (np.flatnonzero(statistics.distance_hits(a, len(v) // 2, 20.0, (3.0, 0.2))) for a in (v, np.sort(-v)))
    want = {k: None if (len(high) and x > v[high[0]]) or (len(low) and x < v[::-1][low[0]]) else x for k, x in tiles.items()}
    got = {(int(r["tx"]), int(r["ty"])): None if np.isnan(r["v"]) else r["v"] for _, r in run(spark, "tile_outliers_global").iterrows()}
    assert set(got) == set(want) and all((got[k] is None) == (x is None) and (x is None or math.isclose(got[k], x)) for k, x in want.items())
    t = run(spark, "tile_outliers_local")
    assert t["v"].isna().sum() == t[(t["tx"] * 7 + t["ty"] * 5 == 24)].shape[0]


@pytest.mark.parametrize("sizes, widths, channels, remainder", [((24, 30), (3, 7), (3, 1), 0.3), ((12, 20), (5, 30), (2, 4), 0.1), ((10, 9), (4, 4), (1, 3), 0.9), ((6, 6), (2, 2), (6, 2), 0.5)])
def test_two_layers_by_brute_force(spark, sizes, widths, channels, remainder):
    """Tiles laid out one by one, channel after channel."""
    t = tessellation.Tessellation(sizes, widths, channels, remainder)
    want, starts, number = {}, [], 0
    spans = []
    for k in (0, 1):
        size = sizes[k] // channels[k]
        first, count = tessellation.along(size, widths[k], remainder)
        cuts = [0, *range(first, size, widths[k])][:count] + [size]
        assert len(cuts) == count + 1 and all(b - a == widths[k] for a, b in zip(cuts[1:-2], cuts[2:-1]))
        spans.append((size, cuts))
    for cy in range(channels[1]):
        for cx in range(channels[0]):
            for j in range(len(spans[1][1]) - 1):
                for i in range(len(spans[0][1]) - 1):
                    (sx, xs), (sy, ys) = spans
                    for y in range(cy * sy + ys[j], cy * sy + ys[j + 1]):
                        for x in range(cx * sx + xs[i], cx * sx + xs[i + 1]):
                            want[x + 1, y + 1] = (cy * channels[0] + cx, number)
                    starts.append((cy * sy + ys[j], cx * sx + xs[i]))
                    number += 1
    d = generators.grid(spark, *sizes).select("x", "y", t.channel().alias("c"), t.tile().alias("t"))
    assert {(r["x"], r["y"]): (r["c"], r["t"]) for r in d.collect()} == want and t.tiles == number
    places = {r["tile"]: r["place"] for r in t.permutation(spark).collect()}
    rows = sorted({y for y, _ in starts})
    assert [k for k in sorted(range(number), key=lambda k: (rows.index(starts[k][0]), starts[k][1]))] == sorted(places, key=places.get)
    with pytest.raises(ValueError):
        tessellation.Tessellation((10, 10), (2, 2), (3, 1))


# interpolation along a column


def akima(x, y, at):
    m = np.diff(y) / np.diff(x)
    m = np.concatenate([[3 * m[0] - 2 * m[1], 2 * m[0] - m[1]], m, [2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]])
    t = []
    for i in range(len(x)):
        a, b = abs(m[i + 3] - m[i + 2]), abs(m[i + 1] - m[i])
        t.append((a * m[i + 1] + b * m[i + 2]) / (a + b) if a + b > 0 else (m[i + 1] + m[i + 2]) / 2)
    k = np.searchsorted(x, at, side="right") - 1
    h, u = x[k + 1] - x[k], (at - x[k]) / (x[k + 1] - x[k])
    t = np.array(t)
    return y[k] * (1 + 2 * u) * (1 - u) ** 2 + t[k] * h * u * (1 - u) ** 2 + y[k + 1] * u * u * (3 - 2 * u) - t[k + 1] * h * u * u * (1 - u)


def natural(x, y, at):
    n, h = len(x), np.diff(x)
    a, r = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, r)
    k = np.searchsorted(x, at, side="right") - 1
    p, q = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    return p * y[k] + q * y[k + 1] + ((p**3 - p) * m[k] + (q**3 - q) * m[k + 1]) * h[k] ** 2 / 6


@pytest.mark.parametrize("name, spline", [("interpolate_akima", akima), ("interpolate_cspline", natural)])
def test_splines(spark, name, spline):
    got = run(spark, name).sort_values("event_id")
    e = table("events").sort_values("event_id")
    for kind, g in e.groupby("event_type"):
        known = (g["event_id"] % 7 != 3).to_numpy()
        x, y = g["event_id"].to_numpy(float), g["value"].to_numpy()
        want = np.where(known, y, np.nan)
        free = ~known & (x > x[known][0]) & (x < x[known][-1])
        want[free] = spline(x[known], y[known], x[free])
        assert np.allclose(got[got["event_type"] == kind]["value"].to_numpy(float), want, equal_nan=True, atol=1e-9), kind


@pytest.mark.parametrize("periodic", [False, True])
@pytest.mark.parametrize("block", [3, 7, 1000])
def test_cubic_splines_by_blocks(spark, periodic, block):
    rng = np.random.default_rng(block)
    rows = []
    for g, n in ((None, 40), ("a", 29), ("b", 2), ("c", 3), ("d", 22), ("e", 1)):
        x = np.cumsum(rng.uniform(0.2, 2, n))
        y = rng.normal(0, 1, n)
        y[-1] = y[0] if periodic else y[-1]
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]
        rows += [(g, float(a), None) for a in rng.uniform(x[0] - 1, x[-1] + 1, 30)]
    got = splines.fill_cubic(spark.createDataFrame(rows, "g string, x double, y double").repartition(5), "x", "y", ["g"], periodic, block).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        known = sorted((r[1], r[2]) for r in rows if r[0] == g and r[2] is not None)
        x, y = map(np.array, zip(*known))
        for r in got:
            if r["g"] != g:
                continue
            if r["x"] in x:
                assert r["y"] == y[list(x).index(r["x"])]
            elif len(x) < 3 or not x[0] < r["x"] < x[-1]:
                assert r["y"] is None
            else:
                assert math.isclose(r["y"], splines.cubic(x, y, np.array([r["x"]]), periodic)[0], rel_tol=1e-9, abs_tol=1e-9)


def test_periodic_query(spark):
    got = run(spark, "interpolate_periodic")
    e = table("events")
    for kind, g in e.groupby("event_type"):
        g = g.sort_values("event_id")
        known = (g["event_id"] % 7 != 3).to_numpy()
        x, y = g["event_id"].to_numpy(float)[known], g["value"].to_numpy()[known].copy()
        y[-1] = y[0]
        own = got[got["event_type"] == kind].set_index("event_id")["value"]
        free = [i for i in g["event_id"] if i % 7 == 3 and x[0] < i < x[-1]]
        assert np.allclose(own[free].to_numpy(float), splines.cubic(x, y, np.array(free, float), True), atol=1e-9)


def test_periodic_and_polynomial():
    x = np.linspace(0, 2 * np.pi, 41)
    at = np.linspace(0.05, 6.2, 50)
    assert np.abs(splines.cubic(x, np.sin(x), at, periodic=True) - np.sin(at)).max() < 1e-4
    assert np.allclose(splines.polynomial(np.array([0.0, 1, 2, 4]), np.array([1.0, 0, 5, 61]), np.array([3.0])), np.polyval(np.polyfit([0, 1, 2, 4], [1, 0, 5, 61], 3), 3.0))


def test_coverage(spark):
    cells = image_cells()
    d = spark.createDataFrame([(float(x), float(y)) for x, y in cells], "x double, y double")
    points = d.select(*PLANE.to_world(F.col("x"), F.col("y"))).toPandas().to_numpy()
    a = (points[:, 0] - 359.99 + 180) % 360 - 180
    r = run(spark, "sky_coverage").iloc[0]
    assert math.isclose(r["width"], a.max() - a.min()) and math.isclose(r["height"], np.ptp(points[:, 1])) and math.isclose(r["ra_min"], (a.min() + 359.99) % 360) and math.isclose(r["dec_max"], points[:, 1].max())
    assert r["ra_max"] < r["ra_min"]  # across 0


def test_alignment(spark):
    """On the turned image a step along either axis is one along the sky's, first toward falling right ascension."""
    m = np.array(generators.align_steps(PLANE.cd)[0][1])[:2, :2]
    per_step = np.array(PLANE.cd) @ np.linalg.inv(m)
    assert np.allclose(per_step, [[-0.01, 0], [0, 0.01]])
    v = run(spark, "warp_align")["v"].dropna()
    assert len(v) and v.sum() <= sum(image_cells().values()) * 1.0001


# frequencies


@pytest.mark.parametrize("line", [1 << 14, 6])
def test_frequencies(spark, monkeypatch, line):
    monkeypatch.setattr(frequency, "LINE", line)
    rng = np.random.default_rng(8)
    v = rng.random((7, 9))
    cells = spark.createDataFrame([(i + 1, j + 1, float(v[j, i])) for j in range(7) for i in range(9)], "x int, y int, v double")
    kernel = {(0, 0): 2.0, (2, -1): 1.0, (-1, 0): 0.5}
    want = {(i + 1, j + 1): sum(w * v[j - b, i - a] for (a, b), w in kernel.items() if 0 <= j - b < 7 and 0 <= i - a < 9) / 3.5 for j in range(7) for i in range(9)}
    got = {(r["x"], r["y"]): r["v"] for r in frequency.convolve(cells, kernel).collect()}
    assert all(math.isclose(got[c], w, abs_tol=1e-9) for c, w in want.items()) and len(got) == 63
    if line < 10:
        long = spark.createDataFrame([(0, k, float(z), 0.0) for k, z in enumerate(rng.random(37))], "y long, x long, re double, im double")
        n1, n2 = frequency.padded(37)
        assert n2 > 1 and n1 <= 10 and n1 * n2 >= 37
        f = {r["u"]: complex(r["re"], r["im"]) for r in frequency.lines(long, "y", "x", (n1, n2), "u").collect()}
        z = np.fft.fft([r["re"] for r in long.orderBy("x").collect()], n1 * n2)
        assert len(f) == n1 * n2 and np.allclose([f[k] for k in range(n1 * n2)], z)


# generators


def test_profiles(spark):
    want, rows = {}, table("customer")["c_custkey"].max() // 5 + 1
    for k in table("customer")["c_custkey"]:
        kind = ("gaussian", "moffat", "sersic", "flat", "circum", "point", "distance")[k % 7]
        cx, cy, pa, q, width, n = k * 7 % 50 + 1.0, k // 5 + 1.0, math.radians(k * 13 % 180), 0.7, 3.0, 2.5
        reach = 0.0 if kind == "point" else 6.0
        own = {}
        for x in range(max(math.ceil(cx - reach - 0.5), 1), min(math.floor(cx + reach + 0.5), 50) + 1):
            for y in range(max(math.ceil(cy - reach - 0.5), 1), min(math.floor(cy + reach + 0.5), rows) + 1):
                dx, dy = x - cx, y - cy
                r = math.hypot(dx * math.cos(pa) + dy * math.sin(pa), (dy * math.cos(pa) - dx * math.sin(pa)) / q)
                if kind == "point":
                    inside = (x, y) == (cx, cy)
                else:
                    inside = r <= reach and (kind != "circum" or r > reach - 1)
                if inside:
                    sigma, alpha, b = width / (2 * math.sqrt(2 * math.log(2))), width / (2 * math.sqrt(2 ** (1 / n) - 1)), 2 * n - 1 / 3 + 0.009876 / n
                    own[x, y] = {"gaussian": math.exp(-r * r / (2 * sigma**2)), "moffat": (1 + (r / alpha) ** 2) ** -n, "sersic": math.exp(-b * ((r / width) ** (1 / n) - 1)), "distance": r}.get(kind, 1.0)
        for c, v in own.items():
            want[c] = want.get(c, 0.0) + (v if kind == "distance" else v * 100.0 / sum(own.values()))
    got = {(r["x"], r["y"]): r["v"] for _, r in run(spark, "generate_profiles").iterrows()}
    assert set(got) == set(want) and all(math.isclose(got[c], v, rel_tol=1e-9, abs_tol=1e-9) for c, v in want.items())


def test_noise_and_upper_limits(spark):
    d, cells = run(spark, "generate_noise"), image_cells()
    z = np.array([(r["v"] - cells[r["x"], r["y"]]) / 25 for _, r in d.iterrows()])
    assert len(z) == len(cells) and abs(z.mean()) < 0.35 and abs(z.std() - 1) < 0.3
    u = run(spark, "upper_limit").set_index("label")
    assert len(u) and (u["placed"] <= 50).all() and u["upperlimitquantile"].dropna().between(0, 1).all()


def test_upper_limits_of_noise(spark):
    g = generators.grid(spark, 60, 60).withColumn("v", F.randn(3))
    label = F.when((F.col("x").between(10, 13)) & (F.col("y").between(10, 12)), 1).when((F.col("x").between(40, 42)) & (F.col("y").between(30, 34)), 2).otherwise(0)
    u = catalog.upper_limit(g.withColumn("label", label.cast("long")), number=50).toPandas().set_index("label")
    assert list(u["placed"]) == [50, 50] and set(u.index) == {1, 2}
    for label, cells in ((1, 12), (2, 15)):  # a sum of so many deviates
        assert 0.6 < u.loc[label, "upperlimitonesigma"] / math.sqrt(cells) < 1.5
        assert math.isclose(u.loc[label, "upperlimit"], 3 * u.loc[label, "upperlimitonesigma"]) and 0 <= u.loc[label, "upperlimitquantile"] <= 1
        assert math.isclose(u.loc[label, "upperlimitmag"], -2.5 * math.log10(u.loc[label, "upperlimit"]))


def test_placements_across_blocks_equal_single_ones(spark, monkeypatch):
    """Each trial's sum, cell by cell, with footprints in several blocks."""
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (23, 31))
    v[5, 7] = np.nan
    lab = np.zeros(v.shape, int)
    lab[2:9, 3:12], lab[15:17, 20], lab[10:20, 25:28] = 1, 2, 7
    d = as_cells(spark, v).join(spark.createDataFrame([(i + 1, j + 1, int(lab[j, i])) for j in range(23) for i in range(31)], "x int, y int, label long"), ["x", "y"])
    whole = {r["label"]: r for r in catalog.upper_limit(d, number=12, tries=40).collect()}
    of_cells = blocks.of_cells
    monkeypatch.setattr(blocks, "of_cells", lambda cells, values, kinds=None: of_cells(cells, values, (), kinds, 6))
    parts = {r["label"]: r for r in catalog.upper_limit(d, number=12, tries=40).collect()}
    assert set(whole) == set(parts) == {1, 2, 7}
    for k in whole:
        assert all(a == b or math.isclose(a, b, rel_tol=1e-9) for a, b in zip(whole[k], parts[k])), k
    free = (lab == 0) & ~np.isnan(v)
    fits = sum(free[j : j + 2, i].all() for j in range(22) for i in range(31))
    assert whole[2]["placed"] == 12 and fits > 300


def test_data_sum(spark):
    total = 0
    for r in table("nation").itertuples(index=False):
        h = 42
        for v in r:
            data = v.encode() if isinstance(v, str) else int(v).to_bytes(4, "little", signed=True)
            h = xxhash.xxh64(data, seed=h).intdigest()
        total ^= h
    got = run(spark, "header_data_sum").iloc[0]
    assert int(got["datasum"]) % (1 << 64) == total and got["rows"] == 25


# matching, joins and sinks


def test_scratch_deletes_all_but_what_is_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "shared_dir", lambda spark: str(tmp_path))
    with lineage.scratch() as keep:
        gone = lineage.cut(spark.range(3), "gone")
        with lineage.scratch() as inner:
            kept = keep(inner(lineage.cut(gone, "kept")))
            lineage.cut(gone, "inner")
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["kept"] and kept.count() == 3
    with pytest.raises(RuntimeError), lineage.scratch():
        lineage.cut(spark.range(3), "lost")
        raise RuntimeError
    assert len(list(tmp_path.iterdir())) == 1


def test_files_on_the_way(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 5.0)], "k long, a double, b double")
    out = side_files.evaluate(d, "a b + tofile-sum.parquet b x", str(tmp_path), ["k"])
    assert sorted(map(tuple, out.collect())) == [(1, 15.0), (2, None)]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/sum.parquet").collect())) == [(1, 5.0), (2, None)]
    with pytest.raises(ValueError):  # it is there already
        side_files.evaluate(d, "a b + tofile-other.parquet tofile-sum.parquet b x", str(tmp_path), ["k"])
    assert not (tmp_path / "other.parquet").exists()
    assert side_files.evaluate(d, "a tofilefree-a.txt", str(tmp_path), ["k"]).columns == ["k"]
    for tokens in ("tofile-x.parquet a b +", "a b + tofile-", "a b + tofile-../y b x"):
        with pytest.raises(ValueError):
            side_files.evaluate(d, tokens, str(tmp_path))


def test_nearest_is_never_lost(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e9, 1e9), (3, None, 0.0), (4, 3.0, 4.0)], "id long, x double, y double")
    b = spark.createDataFrame([(10, 3.0, 4.0), (11, -1e6, 0.0)], "id long, x double, y double")
    got = {r["a_id"]: (r["b_id"], r["dist"]) for r in match.nearest_neighbour(a, b, ["x", "y"], ["x", "y"], "id", "id", 0.5).collect()}
    assert got[1] == (10, 5.0) and got[4] == (10, 0.0) and got[2][0] == 10 and 3 not in got
    assert match.nearest_neighbour(a, b.limit(0), ["x", "y"], ["x", "y"], "id", "id", 0.5).count() == 0


def test_hot_keys_lose_nothing(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"), "id")
    side = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left", "left_semi"):
        want = rows.join(side, "k", how)
        got = spread_join(rows, side, "k", "id", how)
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_text_sink_keeps_long_values(spark, tmp_path):
    rows = [(1, "x" * 58, -1.7976931348623157e308), (2, "short", 0.1), (3, None, None)]
    registry.write(spark.createDataFrame(rows, "a long, t string, d double"), f"{tmp_path}/t.txt")
    assert {tuple(r) for r in registry.read(spark, f"{tmp_path}/t.txt").collect()} == set(rows)


def test_rounds_of_clipping_read_little(spark):
    d = table("lineitem")[["l_returnflag", "l_extendedprice"]]
    s = spark.createDataFrame(d)
    plan = statistics.sigma_clip(s, ["l_returnflag"], "l_extendedprice", 1.5, 7)._jdf.queryExecution().toString()
    assert plan.count("Scan parquet") + plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") < 20


def test_units_are_counted_and_kept(spark, tmp_path):
    fits.write_table(spark.range(10).selectExpr("id", "cast(null as int) n", "id % 2 = 0 even", "'it''s' t"), f"{tmp_path}/a")
    counts = fits.unit_counts(spark, f"{tmp_path}/a").collect()
    assert all((r["units"], r["tables"], r["images"]) == (2, 1, 1) for r in counts) and counts
    rows = fits.read_table(spark, f"{tmp_path}/a").collect()
    assert sorted(int(r["id"]) for r in rows) == list(range(10)) and {r["n"] for r in rows} == {None} and {r["t"] for r in rows} == {"it's"} and all(r["even"] == (int(r["id"]) % 2 == 0) for r in rows)
    assert fits.keep_units(spark, f"{tmp_path}/a", f"{tmp_path}/b", [0]) == len(counts)
    assert {r["units"] for r in fits.unit_counts(spark, f"{tmp_path}/b").collect()} == {1}
    with pytest.raises(ValueError):
        fits.write_table(spark.range(1).selectExpr("array(id) a"), f"{tmp_path}/c")


def test_custom_rings(spark):
    one = spark.createDataFrame([(1, 5.0, 5.0, "custom", 4.0, 1.0, 0.0, 1.0, 0.0, 1.0)], "id int, cx double, cy double, kind string, width double, n double, pa double, q double, mag double, trunc double")
    got = {(r["x"], r["y"]): r["v"] for r in generators.profiles(one, 9, 9, custom=[(0, 1, 5.0), (1, 3, 1.0)]).collect()}
    inside = {(x, y): math.hypot(x - 5, y - 5) for x in range(1, 10) for y in range(1, 10) if math.hypot(x - 5, y - 5) <= 4}
    raw = {c: 5.0 if r < 1 else 1.0 if r < 3 else 0.0 for c, r in inside.items()}
    assert set(got) == set(raw) and all(math.isclose(got[c], v / sum(raw.values())) for c, v in raw.items())


def test_sections_and_polygons(spark):
    cells = generators.make_new(spark, [6, 5])
    got = polygons.section(cells, "2:*-1,3:4").toPandas()
    assert sorted(zip(got["x"], got["y"])) == [(x, y) for x in range(1, 5) for y in (1, 2)]
    with pytest.raises(ValueError):
        polygons.section(cells, "2:3")
    outside = polygons.polygon(cells, [(1.5, 1.5), (4.5, 1.5), (4.5, 4.5), (1.5, 4.5)], outside=True).toPandas()
    assert outside["v"].isna().sum() == 9
    with pytest.raises(ValueError):
        generators.make_new(spark, [])


# detection and segmentation on blocks


def np_labels(on, connectivity):
    """Components numbered by their first cell in raster order, from 1."""
    lab, n = np.zeros(on.shape, int), 0
    for y, x in zip(*np.nonzero(on)):
        if lab[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        lab[y, x] = n
        while todo:
            j, i = todo.pop()
            for dx, dy in grid.offsets(2, connectivity):
                b, a = j + dy, i + dx
                if 0 <= b < on.shape[0] and 0 <= a < on.shape[1] and on[b, a] and not lab[b, a]:
                    lab[b, a] = n
                    todo.append((b, a))
    return lab


def np_around(a, connectivity, fill):
    wide = np.pad(a, 1, constant_values=fill)
    return [wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx] for dx, dy in grid.offsets(2, connectivity)]


def np_erode(on, connectivity, firm=None):
    gone = np.any([~s for s in np_around(on, connectivity, True)], axis=0)
    return on & (~gone if firm is None else ~gone | firm)


def np_open(on, depth, connectivity):
    for _ in range(depth):
        on = np_erode(on, connectivity)
    for _ in range(depth):
        on = on | np.any(np_around(on, connectivity, False), axis=0)
    return on


def np_fill(on, connectivity, most=None):
    lab = np_labels(~on, connectivity)
    edge = set(np.concatenate([lab[0], lab[-1], lab[:, 0], lab[:, -1]]))
    return on | np.isin(lab, [k for k in range(1, lab.max() + 1) if k not in edge and (most is None or (lab == k).sum() <= most)])


def np_convolved(v, kernel):
    out = np.full(v.shape, np.nan)
    for y in range(v.shape[0]):
        for x in range(v.shape[1]):
            got = [(w, v[y - b, x - a]) for (a, b), w in kernel.items() if 0 <= y - b < v.shape[0] and 0 <= x - a < v.shape[1] and not np.isnan(v[y - b, x - a])]
            if got:
                out[y, x] = sum(w * u for w, u in got) / sum(w for w, _ in got)
    return out


def np_tiles(shape, tile):
    return {(i, j): (slice(j * tile[1], (j + 1) * tile[1]), slice(i * tile[0], (i + 1) * tile[0])) for j in range(-(-shape[0] // tile[1])) for i in range(-(-shape[1] // tile[0]))}


def np_filled_tiles(values, s):
    """Blank tiles by the median of the nearest, then smoothed."""
    known = {k: v for k, v in values.items() if v is not None}
    full = {}
    for k in values:
        near = sorted(known, key=lambda o: (math.hypot(o[0] - k[0], o[1] - k[1]), o))[: s.neighbours]
        full[k] = values[k] if values[k] is not None else [float(np.median([known[o][c] for o in near])) for c in range(len(known[near[0]]))]
    h = range(-(s.smooth // 2), s.smooth - s.smooth // 2)
    return {k: [float(np.mean([full[k[0] + a, k[1] + b][c] for a in h for b in h if (k[0] + a, k[1] + b) in full])) for c in range(len(full[k]))] for k in full}


def np_cells(tiles, shape, tile, c):
    out = np.zeros(shape)
    for k, at in np_tiles(shape, tile).items():
        out[at] = tiles[k][c]
    return out


def np_detections(v, s):
    """The whole program on one array, step by step."""
    blank = np.isnan(v)
    conv = np_convolved(v, s.kernel) if s.kernel else v
    quantile = lambda a, q: np.sort(a)[statistics.rank_of_quantile(len(a), q)]
    th = {}
    for k, at in np_tiles(v.shape, s.tile).items():
        a = np.sort(conv[at][~np.isnan(conv[at])])
        m = a.mean()
        near = min(range(len(a)), key=lambda i: (abs(a[i] - m), -a[i], -i))
        th[k] = [quantile(a, q) for q in (s.q, s.no_erode, s.grow_q)] if abs(near / (len(a) - 1) - 0.5) < s.most else None
    for k in [k for k in th if th[k]]:  # outliers among the nearest tiles
        reach = int(np.ceil(np.sqrt(s.neighbours))) + 1
        near = sorted((o for o in th if o != k and th[o] and max(abs(o[0] - k[0]), abs(o[1] - k[1])) <= reach), key=lambda o: (math.hypot(o[0] - k[0], o[1] - k[1]), k[0] - o[0], k[1] - o[1]))[: s.neighbours]
        assert len(near) < s.neighbours or abs(th[k][0] - np.median([th[o][0] for o in near])) < s.outlier_sigma * np.std([th[o][0] for o in near])
    th = np_filled_tiles(th, s)
    low, firm, grow = (np_cells(th, v.shape, s.tile, c) for c in range(3))
    on = conv > low
    for _ in range(s.erode):
        on = np_erode(on, s.erode_reach, conv > firm)
    on = np_open(on, s.opening, s.opening_reach) & ~blank
    label = np_labels(on, 2)

    def background(mask):
        back = {}
        for k, at in np_tiles(v.shape, s.tile).items():
            a = v[at][~mask[at] & ~blank[at]]
            _, _, mean, std = statistics.sigma_clip_array(a, *s.clip) if len(a) > s.free * v[at].size else (0, 0, 0, 0)
            back[k] = [mean, std] if std > 0 else None
        return np_filled_tiles(back, s)

    back = background(on)
    sky, std = (np_cells(back, v.shape, s.tile, c) for c in range(2))

    def sn(lab, but=None):
        out = {}
        for k in range(1, lab.max() + 1):
            at = lab == k
            if but is not None and (but[at] > 0).any():
                continue
            at &= ~blank
            y, x = np.nonzero(at)
            over = v[at] - sky[at]
            up = np.maximum(over, 0)
            if at.sum() > s.area and over.mean() > 0 and up.sum() > 0:
                cx, cy = ((c := (up * d).sum() / up.sum()) // 1 + (c % 1 > 0.5) for d in (x, y))
                err = back[int(cx) // s.tile[0], int(cy) // s.tile[1]][1]
                out[k] = math.sqrt(at.sum() / s.cpscorr) * over.mean() / math.sqrt(over.mean() + err**2)
        return out

    def pseudo(on_sky):
        bright = v - sky > s.least * std
        mask = (bright | (label > 0) if on_sky else bright & (label > 0)) & ~blank
        for at in np_tiles(v.shape, s.large).values():
            mask[at] = np_open(np_fill(mask[at], s.hole_reach), s.pseudo_opening, s.pseudo_opening_reach)
        return np_labels(mask, s.pseudo_reach)

    chance = sorted(sn(pseudo(True), label).values())
    bound = chance[statistics.rank_of_quantile(len(chance), s.sn_q)] if chance else -np.inf
    lab = pseudo(False)
    true = np.isin(lab, [k for k, x in sn(lab).items() if x > bound])
    kept = np.isin(label, [k for k in np.unique(label[true]) if k])
    out = np.where(kept, label, 0)
    if s.grow_q < 1 and ((conv > grow) & ~kept & ~blank).any():
        region = np_labels(kept | (conv > grow), 2)
        mask = np.isin(region, np.unique(region[kept])) & (region > 0)
        mask = mask | np.any(np_around(mask, 1, False), axis=0)
        out = np.where(blank, 0, np_labels(np_fill(mask, 1, s.hole_cells), 2))
    else:
        out = np_labels(out > 0, 2)
    good = [k for k, x in sn(out).items() if x > bound] if s.clean else [k for k in np.unique(out) if k]
    final = np.zeros(v.shape, int)
    for n, k in enumerate(good, 1):
        final[out == k] = n
    back = background(final > 0)
    return final, np_cells(back, v.shape, s.tile, 0), np_cells(back, v.shape, s.tile, 1), len(chance)


def as_array(rows, column, shape, fill=0):
    a = np.full(shape, fill, float)
    for r in rows:
        if r[column] is not None:
            a[r["y"] - 1, r["x"] - 1] = r[column]
    return a


def as_cells(spark, v):
    return spark.createDataFrame(pd.DataFrame([(i + 1, j + 1, None if np.isnan(v[j, i]) else float(v[j, i])) for j in range(v.shape[0]) for i in range(v.shape[1])], columns=["x", "y", "v"])).selectExpr("cast(x as int) x", "cast(y as int) y", "case when isnan(v) then null else v end v")


def test_detect_program_equals_numpy(spark):
    cells = image_cells()
    shape = (max(y for _, y in cells), max(x for x, _ in cells))
    v = np.full(shape, np.nan)
    for (x, y), value in cells.items():
        v[y - 1, x - 1] = value
    label, sky, std, _ = np_detections(v, more.DETECTION)
    rows = [r for _, r in run(spark, "detect_program").iterrows()]
    rows = [{**r, "x": int(r["x"]), "y": int(r["y"])} for r in rows]
    assert {(r["x"], r["y"]) for r in rows} == set(cells)
    assert (as_array(rows, "label", shape) == np.where(np.isnan(v), 0, label)).all()
    assert all(math.isclose(r["sky"], sky[r["y"] - 1, r["x"] - 1], rel_tol=1e-9) and math.isclose(r["std"], std[r["y"] - 1, r["x"] - 1], rel_tol=1e-9) for r in rows)


@pytest.mark.parametrize("change", [{}, {"grow_q": 1.0, "clean": False}, {"kernel": None, "erode": 2, "opening": 2, "hole_reach": 1, "pseudo_reach": 1}])
def test_detections_across_blocks_equal_numpy(spark, monkeypatch, change):
    rng = np.random.default_rng(11)
    v = rng.normal(100, 3, (60, 44))
    for x, y, w, f in ((10, 12, 6, 40), (31, 30, 3, 90), (22, 47, 8, 30), (40, 5, 2, 200)):
        j, i = np.mgrid[0:60, 0:44]
        v += f * np.exp(-((i - x) ** 2 + (j - y) ** 2) / (2 * w * w))
    v[29:32, 20:24] = np.nan
    s = replace(programs.Detection(tile=[6, 5], large=[12, 10], kernel=more.SHARP, most=0.3, q=0.6, no_erode=0.95, grow_q=0.8, neighbours=7, outlier_sigma=1e9, erode=1, area=3, sn_q=0.8, free=0.3, hole_cells=8), **change)
    monkeypatch.setattr(blocks, "SIDE", 12)
    monkeypatch.setattr(programs, "of_cells", lambda cells, values=("v",), multiples=(), kinds=None: blocks.of_cells(cells, values, multiples, kinds, 12))
    label, sky, std, chance = np_detections(v, s)
    rows = programs.detections(as_cells(spark, v), s).collect()
    assert chance and label.max() >= 2 and len(rows) == v.size
    assert (as_array(rows, "label", v.shape) == label).all()
    assert np.allclose(as_array(rows, "sky", v.shape), sky) and np.allclose(as_array(rows, "std", v.shape), std)


def np_flood(v, label):
    """Clumps by the number of their peak (from 1), rivers -1, 0 outside."""
    out = np.zeros(v.shape, int)
    on = (label > 0) & ~np.isnan(v)
    for n in sorted(np.flatnonzero(on.ravel()), key=lambda n: (-v.flat[n], n)):
        y, x = divmod(int(n), v.shape[1])
        near = {out[b, a] for dx, dy in grid.offsets(2, 2) if 0 <= (b := y + dy) < v.shape[0] and 0 <= (a := x + dx) < v.shape[1] and label[b, a] == label[y, x] and out[b, a] > 0}
        out[y, x] = n + 1 if not near else near.pop() if len(near) == 1 else -1
    return out


@pytest.mark.parametrize("levels", [4, 1000])
def test_watershed_across_blocks(spark, levels):
    rng = np.random.default_rng(levels)
    v = rng.integers(0, levels, (34, 29)).astype(float)
    v[rng.random(v.shape) < 0.05] = np.nan
    label = np_labels((np.indices(v.shape).sum(axis=0) % 17 > 1), 1)
    want = np_flood(v, label)
    d = as_cells(spark, v).join(spark.createDataFrame([(i + 1, j + 1, int(label[j, i])) for j in range(34) for i in range(29)], "x int, y int, label long"), ["x", "y"])
    for side in (5, 100):
        got = {(r["x"] - 1, r["y"] - 1): (r["label"], r["clump"]) for r in watershed.watershed(d, side).collect()}
        assert set(got) == {(i, j) for j, i in zip(*np.nonzero(want))}
        peaks = {}
        for n in sorted((n for n in np.unique(want) if n > 0), key=lambda n: -v.flat[n - 1]):
            peaks.setdefault(label.flat[n - 1], []).append(n)
        for (i, j), (own, clump) in got.items():
            assert own == label[j, i] and clump == (-1 if want[j, i] < 0 else peaks[own].index(want[j, i]) + 1)


def np_segment(v, label, std, s):
    """(object, clump) of detected cells."""
    conv = np.where(np.isnan(v), np.nan, np_convolved(v, s.kernel)) if s.kernel else v
    near = lambda y, x: [(y + dy, x + dx) for dx, dy in grid.offsets(2, 2) if 0 <= y + dy < v.shape[0] and 0 <= x + dx < v.shape[1]]

    def significance(flooded):
        rim = {}
        for y, x in zip(*np.nonzero(flooded == -1)):
            for k in {flooded[c] for c in near(y, x) if flooded[c] > 0}:
                rim[k] = max(rim.get(k, (-np.inf, 0)), (conv[y, x], std[y, x]))
        return {k: (conv.flat[k - 1] - rim[k][0]) / rim[k][1] for k in rim if (flooded == k).sum() > s.area}

    noise = np.zeros(v.shape, int)
    for n, at in enumerate(np_tiles(v.shape, s.large).values(), 1):
        noise[at] = n
    chance = sorted(significance(np_flood(conv, np.where((label == 0) & ~np.isnan(conv), noise, 0))).values())
    bound = chance[statistics.rank_of_quantile(len(chance), s.q)] if chance else -np.inf
    flooded = np_flood(conv, label)
    sure = {k for k, x in significance(flooded).items() if x > bound}
    if not s.near_river:
        sure = {k for k in sure if not any(flooded[c] == -1 for c in near(*divmod(k - 1, v.shape[1])))}
    links = {}
    for y, x in zip(*np.nonzero(flooded == -1)):
        seen = [(flooded[c], conv[c]) for c in near(y, x) if flooded[c] > 0]
        ave = (sum(w for _, w in seen) + conv[y, x]) / (len(seen) + 1)
        for a in {k for k, _ in seen}:
            for b in {k for k, _ in seen}:
                if a < b:
                    links.setdefault((a, b), []).append((ave, std[y, x] ** 2))
    up = {k: k for k in sure}
    root = lambda k: k if up[k] == k else root(up[k])
    for (a, b), e in links.items():
        ave, var = np.mean([x for x, _ in e]), np.mean([x for _, x in e])
        if a in sure and b in sure and len(e) > s.river and math.sqrt(1 / s.cpscorr) * ave / math.sqrt(max(abs(ave) + var, 1e-12)) > s.object_sn:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    out, number, clumps = np.zeros(v.shape, int), 0, np.zeros(v.shape, int)
    for d in range(1, label.max() + 1):
        own = sorted(k for k in sure if label.flat[k - 1] == d)
        roots = sorted({root(k) for k in own})
        if len(roots) < 2:
            number += 1
            out[label == d] = number
            for n, k in enumerate(own, 1):
                clumps[flooded == k] = n
            continue
        for r in roots:
            number += 1
            for n, k in enumerate([k for k in own if root(k) == r], 1):
                out[flooded == k], clumps[flooded == k] = number, n
        while True:
            new = out.copy()
            for y, x in zip(*np.nonzero((label == d) & (out == 0))):
                near_by = [out[c] for c in near(y, x) if label[c] == d and out[c] > 0]
                new[y, x] = min(near_by) if near_by else 0
            if (new == out).all():
                break
            out = new
    return out, clumps


@pytest.mark.parametrize("near_river", [True, False])
def test_segment_across_blocks_equals_numpy(spark, monkeypatch, near_river):
    rng = np.random.default_rng(21)
    v = rng.normal(10, 1, (40, 37))
    for x, y, f in ((8, 8, 30), (14, 10, 25), (26, 28, 40), (31, 24, 35), (28, 34, 30), (6, 30, 12)):
        j, i = np.mgrid[0:40, 0:37]
        v += f * np.exp(-((i - x) ** 2 + (j - y) ** 2) / 8)
    label = np_labels(np_open(v > 14, 1, 1), 2)
    std = np.where(np.indices(v.shape)[1] < 20, 1.0, 1.3)
    d = as_cells(spark, v).join(spark.createDataFrame([(i + 1, j + 1, int(label[j, i]), float(std[j, i])) for j in range(40) for i in range(37)], "x int, y int, label long, std double"), ["x", "y"])
    monkeypatch.setattr(programs, "of_cells", lambda cells, values=("v",), multiples=(), kinds=None: blocks.of_cells(cells, values, multiples, kinds, 10))
    for s in (programs.Segmentation(large=[10, 10], area=2, q=0.9, near_river=near_river, object_sn=1e6), programs.Segmentation(large=[5, 5], area=1, q=0.5, near_river=near_river, river=1, object_sn=3.0, kernel=more.SHARP)):
        want, clumps = np_segment(v, label, std, s)
        rows = programs.segment(d, s).collect()
        assert {(r["x"], r["y"]) for r in rows} == {(x + 1, y + 1) for y, x in zip(*np.nonzero(label))} and want.max() > label.max() - 1
        assert (as_array(rows, "object", v.shape) == want).all() and (as_array(rows, "clump", v.shape) == clumps).all()


def test_segment_objects_equals_numpy(spark):
    d = run(spark, "detect_program")
    cells = image_cells()
    shape = (max(y for _, y in cells), max(x for x, _ in cells))
    v, label, std = np.full(shape, np.nan), np.zeros(shape, int), np.ones(shape)
    for _, r in d.iterrows():
        at = int(r["y"]) - 1, int(r["x"]) - 1
        v[at], label[at], std[at] = cells[at[1] + 1, at[0] + 1], r["label"], r["std"]
    want, clumps = np_segment(v, label, std, more.SEGMENTATION)
    got = {(int(r["x"]), int(r["y"])): (r["object"], r["clump"]) for _, r in run(spark, "segment_objects").iterrows()}
    assert got == {(x + 1, y + 1): (want[y, x], clumps[y, x]) for y, x in zip(*np.nonzero(label))}


def test_programs_without_cells(spark):
    none = spark.createDataFrame([], "x int, y int, v double, label long, std double")
    assert programs.detections(none.drop("label", "std")).count() == programs.segment(none).count() == watershed.watershed(none).count() == 0
