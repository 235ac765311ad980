"""What showed only on larger tables or odd rows: results against SQL, and work that must not grow with the square."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicDataFrame

from tessella.functions import dates, sky
from tessella.operators import catalog, generators, match, splines, statistics
from tessella.queries import ORACLES, QUERIES


def against_sql(spark, folder, name, **tables):
    """The rows of a query over small tables and those of its SQL, sorted."""
    c = duckdb.connect()
    for t, d in tables.items():
        d.to_parquet(f"{folder}/{t}.parquet", index=False, coerce_timestamps="us")
        c.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = c.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, str(folder)).toPandas()[list(want.columns)]
    order = lambda d: d.sort_values(list(d.columns)).reset_index(drop=True)
    return order(got), order(want)


def test_nights_of_events_out_of_order(spark, tmp_path):
    """Ids that don't rise with the time, fractions of a second on both sides of a half, and one just before the hour."""
    ts = pd.to_datetime(["2024-01-01 08:59:59.7", "2024-01-01 10:00:00.6", "2024-01-01 10:00:00.4", "2024-01-01 10:00:01.2", "2024-01-01 10:00:02.5", "2024-01-01 10:00:01.5"])
    events = pd.DataFrame({"event_id": [5, 4, 3, 2, 1, 0], "ts": ts})
    got, want = against_sql(spark, tmp_path, "nights", events=events)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def local_spline(x, y, at, how):
    """Steffen's or Akima's spline through sorted points."""
    m = np.diff(y) / np.diff(x)
    if how == "linear":
        return np.interp(at, x, y)
    if how == "steffen":
        h, s = np.diff(x), np.append(m[0], m[-1]).repeat([1, len(x) - 1])
        for i in range(1, len(x) - 1):
            p = (m[i - 1] * h[i] + m[i] * h[i - 1]) / (h[i - 1] + h[i])
            s[i] = (np.sign(m[i - 1]) + np.sign(m[i])) * min(abs(m[i - 1]), abs(m[i]), 0.5 * abs(p))
    else:
        e = np.concatenate([[3 * m[0] - 2 * m[1], 2 * m[0] - m[1]], m, [2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]])
        left, right = abs(e[3:] - e[2:-1]), abs(e[1:-2] - e[:-3])
        s = np.where(left + right > 0, (left * e[1:-2] + right * e[2:-1]) / np.where(left + right > 0, left + right, 1), (e[1:-2] + e[2:-1]) / 2)
    k = np.clip(np.searchsorted(x, at) - 1, 0, len(x) - 2)
    h, t = x[k + 1] - x[k], (at - x[k]) / (x[k + 1] - x[k])
    return y[k] * (1 + 2 * t) * (1 - t) ** 2 + s[k] * h * t * (1 - t) ** 2 + y[k + 1] * t * t * (3 - 2 * t) - s[k + 1] * h * t * t * (1 - t)


@pytest.mark.parametrize("how", ["linear", "steffen", "akima"])
def test_gaps_are_filled_without_looking_through_a_group_for_each_row(spark, how):
    """Runs of blanks over blocks' ends, one group of blanks alone, one with a single value, and a nameless one."""
    rng = np.random.default_rng(3)
    d = pd.DataFrame({"g": ["a"] * 400 + [None] * 200 + ["b"] * 20 + ["c"] * 20, "x": [*range(400), *range(200), *range(20), *range(20)]})
    blank = (rng.random(640) < 0.4) | ((d.g == "a") & d.x.between(90, 140)) | (d.g == "b") | ((d.g == "c") & (d.x != 7))
    d["y"] = [None if b else float(v) for b, v in zip(blank, rng.normal(0, 5, 640).round(1) * (d.x % 5 > 1))]
    df = spark.createDataFrame([tuple(r) for r in d.astype(object).where(d.notna(), None).itertuples(index=False)], "g string, x long, y double")
    fill = (lambda block: dates.fill_linear(df, "x", "y", ["g"])) if how == "linear" else (lambda block: splines.fill_local(df, "x", "y", ["g"], how, block))
    got = fill(None)
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().replace(" ", "").lower()
    for out in (got, fill(4)):
        out = out.select(F.coalesce("g", F.lit("-")).alias("g"), "x", "y").toPandas()
        assert len(out) == 640
        for g, rows in d.assign(g=d.g.fillna("-")).groupby("g"):
            mine, y = out[out.g == g].set_index("x").y.astype(float), rows.set_index("x").y.astype(float)
            k = y.dropna()
            want = y.copy()
            if len(k) > 1:
                free = [x for x in y.index if np.isnan(y[x]) and k.index[0] < x < k.index[-1]]
                want[free] = local_spline(k.index.to_numpy(float), k.to_numpy(), np.array(free, float), how)
            assert np.allclose(mine.loc[want.index], want, equal_nan=True), g


def paired(a, b, limit):
    """The one-to-one match of (id, x, y) rows by plain loops: each id of b chooses the nearest of a, then each of a among these."""
    chose = {}
    for j, x, y in b:
        for i, u, v in a:
            r = np.sqrt((u - x) * (u - x) + (v - y) * (v - y))
            if r < limit:
                chose[j] = min(chose.get(j, (np.inf,)), (r, u, i, x))
    kept = {}
    for j, (r, _, i, x) in chose.items():
        kept[i] = min(kept.get(i, (np.inf,)), (r, x, j))
    return {(i, j): r for i, (r, _, j) in kept.items()}


@pytest.mark.parametrize("spread, limit", [(1.0, 0.9), (1.0, 0.05), (50.0, 0.9)])
def test_match_of_crowded_rows(spark, spread, limit):
    """Many places within one aperture, some of them twice; ids that come again elsewhere; a lone row far off."""
    rng = np.random.default_rng(5)
    rows = lambda n, first: [(first + k % (n - 9), *map(float, p)) for k, p in enumerate(np.round(rng.random((n, 2)) * spread, 2))]
    a, b = rows(300, 0), rows(320, 1000) + [(5000, spread + 0.04, spread + 0.02)]
    frames = [spark.createDataFrame(r, "id long, x double, y double") for r in (a, b)]
    got = match.match(*frames, ["x", "y"], ["x", "y"], "id", "id", [limit]).collect()
    want = paired(a, b, limit)
    assert {(r["a_id"], r["b_id"]) for r in got} == set(want) and len(got) == len(want)
    assert all(np.isclose(r["dist"], want[r["a_id"], r["b_id"]]) for r in got)
    near = {}
    for i, u, v in a:
        near[i] = min([near.get(i, (np.inf,))] + [(np.sqrt((u - x) * (u - x) + (v - y) * (v - y)), x, j) for j, x, y in b])
    got = {r["a_id"]: r["b_id"] for r in match.nearest_neighbour(*frames, ["x", "y"], ["x", "y"], "id", "id", 1.0).collect()}
    assert got == {i: m[2] for i, m in near.items()}


def test_match_of_many_rows_at_few_places(spark):
    """100,000 rows a side at ten places: ten pairs, not ten thousand million."""
    side = lambda first: spark.range(first, first + 100_000).select("id", (F.col("id") % 10).cast("double").alias("x"), F.lit(0.25).alias("y"))
    a, b = side(0), side(1_000_000)
    got = sorted(tuple(r) for r in match.match(a, b, ["x", "y"], ["x", "y"], "id", "id", [0.9]).collect())
    assert got == [(k, 1_000_000 + k, 0.0) for k in range(10)]
    near = match.nearest_neighbour(a, b, ["x", "y"], ["x", "y"], "id", "id", 1.0)
    assert near.count() == 100_000 and near.where("b_id <> 1000000 + a_id % 10 OR dist <> 0").isEmpty()


def test_profiles_meet_their_totals_before_their_pixels(spark):
    """A large profile and two ids over one another: sums of brightness, and no join of pixels."""
    rows = [(1, 30.0, 30.0, "gaussian", 8.0), (2, 31.0, 29.0, "flat", 3.0), (3, 31.0, 29.0, "sersic", 3.0), (4, 200.0, 1.0, "flat", 3.0)]
    c = spark.createDataFrame(rows, "id long, cx double, cy double, kind string, width double").select("*", F.lit(2.5).alias("n"), F.lit(20.0).alias("pa"), F.lit(0.7).alias("q"), F.lit(20.0).alias("mag"), F.lit(2.0).alias("trunc"))
    out = generators.profiles(c, 60, 60, zeropoint=25.0)
    assert "Join" not in out._jdf.queryExecution().toString()  # of what is left to do, only the sums by pixel
    assert np.isclose(out.agg(F.sum("v")).head()[0], 3 * 100.0)
    assert generators.profiles(c, 60, 60, zeropoint=25.0, replace=True).count() == out.count()


def test_mode_of_large_groups(spark, monkeypatch):
    """By blocks of ranked values, with runs of equal ones over their ends; nothing looks to the end of a range for each row."""
    rng = np.random.default_rng(9)
    groups = {"a": rng.gamma(3.0, 2.0, 3000).round(2), "b": rng.normal(5, 1, 2500).round(1), "c": rng.exponential(1.0, 2000)}
    df = spark.createDataFrame([(k, float(v)) for k, g in groups.items() for v in g], "k string, v double")
    plans, collect = [], ClassicDataFrame.collect
    monkeypatch.setattr(ClassicDataFrame, "collect", lambda d: plans.append(d._jdf.queryExecution().toString()) or collect(d))
    monkeypatch.setattr(statistics, "PACKED", 128)
    got = {r["k"]: tuple(r)[1:] for r in statistics.mode(df, ["k"], "v", most=100).collect()}
    for k, v in groups.items():
        assert np.allclose(np.array(got[k], float), statistics.mode_of_sorted(np.sort(v)), equal_nan=True), k
    wide = [line for p in plans for line in p.lower().splitlines() if "unboundedfollowing" in line.replace(" ", "").replace("$", "")]
    assert plans and all("_bn" in line for line in wide)  # the ranges' ends alone do
    one = statistics.report(df.where("k = 'a'"), "v").head()
    assert one["number"] == 3000 and np.isclose(one["median"], np.median(groups["a"])) and np.isclose(one["mean"], groups["a"].mean())


def test_polynomials_of_many_groups(spark):
    """Groups over batches' ends, of one to nine known points, a nameless one and names that only differ in the second key."""
    rng = np.random.default_rng(2)
    rows = []
    for g in range(300):
        n = int(rng.integers(1, 14))
        for x in range(n):
            rows.append((None if g == 7 else g // 2, "uv"[g % 2], x, None if rng.random() < 0.35 else float(rng.normal())))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = spark.createDataFrame(rows, "g long, h string, x long, y double")
        out = splines.fill_polynomial(df, "x", "y", ["g", "h"])
        assert "Window" not in out._jdf.queryExecution().toString() and "FlatMapGroups" not in out._jdf.queryExecution().toString()
        got = {(r["g"], r["h"], r["x"]): r["y"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(rows)
    groups = {}
    for g, h, x, y in rows:
        groups.setdefault((g, h), []).append((x, y))
    for key, points in groups.items():
        known = [(x, y) for x, y in points if y is not None]
        for x, y in points:
            inside = y is None and len(known) >= 2 and known[0][0] < x < known[-1][0]
            want = sum(v * np.prod([(x - b) / (a - b) for b, _ in known if b != a]) for a, v in known) if inside else y
            assert got[(*key, x)] == want if want is None else np.isclose(got[(*key, x)], want), (key, x)


@pytest.mark.parametrize("name", ["ra", "dec"])
def test_texts_of_angles_are_evaluated_once(spark, name):
    """There and back, to the digits of the text; an angle's text isn't made again for each of its parts."""
    to_degree, to_text = getattr(sky, f"{name}_to_degree"), getattr(sky, f"degree_to_{name}")
    d = spark.range(2000).select((F.col("id") * 0.0437 + 1e-4).alias("c"))
    out = d.select("c", to_text(F.col("c")).alias("t"), to_degree(F.reverse(F.reverse(to_text(F.col("c"))))).alias("back"))
    assert out._jdf.queryExecution().analyzed().toString().count("reverse(") == 2
    rows = out.collect()
    assert all(abs(r["c"] - r["back"]) < 1e-6 for r in rows)
    for r in rows[:300]:
        whole = r["c"] / (15 if name == "ra" else 1)
        minutes = (whole - int(whole)) * 60
        seconds = (minutes - int(minutes)) * 60
        digits = f"{seconds:.{4 if seconds >= 10 else 5}f}".rstrip("0").rstrip(".")
        assert r["t"] == ("" if name == "ra" else "+") + f"{int(whole):02d}{'h' if name == 'ra' else 'd'}{int(minutes):02d}m{digits}s"
    odd = spark.createDataFrame([(t,) for t in ("+,1,2,3", "x", "", None, "1:61:2", "91:0:0", "1:2:3")], "t string").select(to_degree(F.col("t")).alias("v"))
    assert [r["v"] is None for r in odd.collect()] == [True] * 6 + [False]


def test_upper_limits_draw_the_rest_of_the_trials_where_they_lack(spark, monkeypatch):
    """Labels that find enough places among a few trials draw no more; a label as wide as the free strip draws all."""
    label = lambda x, y: 2 if y == 1 and 3 <= x <= 30 else 1 if (x, y) == (20, 12) else 3 if y % 2 == 0 and x > 2 and y > 14 else 0
    cells = [(x, y, float(x * 7 % 5 + y), label(x, y)) for x in range(1, 31) for y in range(1, 31)]
    d = spark.createDataFrame(cells, "x int, y int, v double, label long")
    sent, cut = [], catalog.cut
    monkeypatch.setattr(catalog, "cut", lambda df, tag: (sent.append(df.groupBy("label").agg(F.countDistinct("trial")).collect()) if tag == "sent" else None) or cut(df, tag))
    got = {r["label"]: r for r in catalog.upper_limit(d, number=6, tries=20).collect()}
    assert [max(n for _, n in map(tuple, s)) for s in sent] == [12, 108] and 1 not in {r["label"] for r in sent[1]}
    monkeypatch.setattr(catalog, "SHIFTED", 1)  # a shift at a time
    again = {r["label"]: r for r in catalog.upper_limit(d, number=6, tries=20).collect()}
    assert got[1]["placed"] == 6 and got == again
