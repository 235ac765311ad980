"""The library's own operators: golden values, rules of blanks, and every query against its SQL."""

from __future__ import annotations

import glob
import math
import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import dates, rpn, sky
from tessella.functions.cosmology import Cosmology
from tessella.operators import catalog, generators, grid, match, select, statistics
from tessella.plans.table import TablePipeline
from tessella.queries import FLAGSHIP, ORACLES, QUERIES
from tessella.sources import text_table
from tessella.streaming.nights import nightly

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def by_rounded(row):
    """Orders rows alike whose numbers differ in their last digits only."""
    return repr(tuple(float(f"{v:.6g}") if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    if name not in ORACLES:  # recomputed by numpy in test_brute_force.py
        with open(os.path.join(REPO, "tests", "test_brute_force.py"), encoding="utf-8") as f:
            assert f'"{name}"' in f.read()
        return
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=by_rounded)
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=by_rounded)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b)), (a, b)


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES


def one(spark, tokens, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) or v is None else 'long'}" for k, v in cells.items())) if cells else spark.range(1)
    return df.select(rpn.evaluate(df, tokens)[-1].alias("r")).head()[0]


@pytest.mark.parametrize(
    "tokens, cells, want",
    [
        ("-1 3.45 x", {}, -3.45),
        ("7 2 /", {}, 3),
        ("-7 2 /", {}, -3),
        ("-7 3 %", {}, -1),
        ("7 0 /", {}, None),
        ("a 1 lt", {"a": None}, 0),
        ("a 1 ne", {"a": None}, 1),
        ("a not", {"a": None}, 0),
        ("a isblank", {"a": None}, 1),
        ("a -1.0 x sqrt", {"a": 4.0}, None),
        ("a log", {"a": 0.0}, -math.inf),
        ("a uint8", {"a": 256.0}, None),
        ("a uint8 bitnot", {"a": 1}, 254),
        ("t dec-to-degree", {"t": "-0d30m0s"}, -0.5),
        ("t ra-to-degree", {"t": "1:30:00"}, 22.5),
        ("t ra-to-degree", {"t": "25:00:00"}, None),
        ("a degree-to-dec", {"a": -0.5}, "-00d30m0s"),
        ("a degree-to-ra", {"a": 22.5}, "01h30m0s"),
    ],
)
def test_arithmetic(spark, tokens, cells, want):
    got = one(spark, tokens, **cells)
    assert got == want or (isinstance(want, float) and math.isclose(got, want))


def test_arithmetic_refuses(spark):
    df = spark.range(1)
    for bad in ("1 2", "+", "nocolumn abs", "1.5 2 %"):
        with pytest.raises(ValueError):
            rpn.evaluate(df, bad)


def test_selection_and_blanks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "a long, b double")
    assert [r[0] for r in TablePipeline(columns=["a"], ranges=[("b", 1, 5)]).run(df).collect()] == [1]
    assert [r[0] for r in TablePipeline(columns=["a"], notequal=[("b", 1.0)]).run(df).collect()] == [3]
    assert [r[0] for r in TablePipeline(columns=["a"], sort="b", descending=True, head=1).run(df).collect()] == [3]
    with pytest.raises(ValueError):
        TablePipeline(sort="t").run(df.withColumn("t", F.lit("x")))
    with pytest.raises(ValueError):
        select.resolve(df, "none")
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    inside = df.select(select.in_polygon(F.lit(1.0), F.lit(1.0), square), select.in_polygon(F.lit(3.0), F.lit(1.0), square)).head()
    assert inside[0] and not inside[1]


def test_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)] + [(None,)], "v double")
    assert {r["q"]: r["value"] for r in statistics.quantiles(df, "v", [0.5, 0.6]).collect()} == {0.5: 2.0, 0.6: 3.0}
    at = lambda x: statistics.quantile_function(df, "v", x).head()["quantile"]
    assert at(4.0) == math.inf and at(0.0) == -math.inf and math.isclose(at(2.0), 1 / 3) and math.isclose(at(2.5), 2 / 3)


def test_sigma_clip(spark):
    df = spark.createDataFrame([("a", 0.0)] * 9 + [("a", 100.0), ("b", 5.0), ("c", 1.0), ("c", 1.0)], "k string, v double")
    rows = {r["k"]: tuple(r)[1:] for r in statistics.sigma_clip(df, ["k"], "v", 2.0, 1).collect()}
    assert rows["a"] == (9, 0.0, 10.0, 30.0) and rows["b"] == (1, 5.0, 5.0, 0.0)
    rng = np.random.default_rng(1)
    v = np.append(rng.normal(10, 2, 400), [100.0, 200.0, -50.0])
    big = spark.createDataFrame([("x", float(x)) for x in v], "k string, v double")
    got = tuple(statistics.sigma_clip(big, ["k"], "v", 3.0, 0.2).head())[1:]
    assert np.allclose(got, statistics.sigma_clip_array(v, 3.0, 0.2)) and got[0] <= 400
    assert math.isnan(statistics.sigma_clip_array(np.array([]), 3, 1)[1])


def test_histogram_is_closed_at_its_end(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    assert [r["number"] for r in statistics.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 2, 2, 2, 3]


def test_mode_of_a_bell():
    rng = np.random.default_rng(7)
    mode, q, symmetry, _ = statistics.mode_of_sorted(np.sort(np.append(rng.normal(5, 1, 20000), rng.uniform(5, 15, 4000))))
    assert abs(mode - 5) < 0.3 and 0.3 < q < 0.55 and symmetry > 0.2
    assert math.isnan(statistics.mode_of_sorted(np.array([]))[0])


def test_match(spark):
    a = spark.createDataFrame([(k, float(k), float(k)) for k in range(1, 10)], "id long, x double, y double")
    second = [(8.20, 7.90), (20.1, 2.80), (4.80, 5.20), (5.01, 4.99), (0.01, 0.02), (6.10, 6.05), (0.99, 1.10)]
    b = spark.createDataFrame([(k, *p) for k, p in enumerate(second, 1)], "id long, x double, y double")
    got = match.match(a, b, ["x", "y"], ["x", "y"], "id", "id", [0.5])
    assert sorted((r[0], r[1], round(r[2], 4)) for r in got.collect()) == [(1, 7, 0.1005), (5, 4, 0.0141), (6, 6, 0.1118), (8, 1, 0.2236)]
    assert sorted(r["id"] for r in match.not_matched(a, "id", got, "a_id").collect()) == [2, 3, 4, 7, 9]
    assert sorted(r["id"] for r in match.not_matched(b, "id", got, "b_id").collect()) == [2, 3, 5]
    with pytest.raises(ValueError):
        match.Aperture.of(2, [1, 2, 3, 4])


def test_components_and_holes(spark):
    picture = ["11..1", "1...1", ".111.", ".1.1.", ".111."]
    cells = spark.createDataFrame([(x + 1, y + 1, int(c == "1")) for y, row in enumerate(picture) for x, c in enumerate(row)], "x int, y int, v int")
    by = lambda df, n: {(r["x"], r["y"]): r[n] for r in df.collect()}
    four = by(grid.connected_components(cells, 1), "label")
    assert four[1, 1] == 1 and four[5, 1] == 2 and four[2, 3] == 3 and max(four.values()) == 3
    assert max(by(grid.connected_components(cells, 2), "label").values()) == 1
    assert by(grid.fill_holes(cells, 1), "v")[3, 4] == 1


def test_interpolation_takes_the_nearest(spark):
    cells = spark.createDataFrame([(x, y, None if (x, y) in ((3, 3), (9, 9)) else float(10 * y + x)) for x in range(1, 10) for y in range(1, 10)], "x int, y int, v double")
    out = {(r["x"], r["y"]): r["v"] for r in grid.interpolate_neighbours(cells, 4, "min").collect()}
    assert out[3, 3] == 23.0 and out[9, 9] == 88.0


def test_clump_rivers_and_upper_limit(spark):
    rows = [(1, 1, 1, 9.0, 1), (1, 2, 1, 3.0, -1), (1, 3, 1, 8.0, 2), (1, 1, 2, 7.0, 1)]
    d = spark.createDataFrame(rows, "label long, x int, y int, v double, clump int")
    assert sorted(tuple(r) for r in catalog.clump_rivers(d).collect()) == [(1, 1, 1, 3.0, 3.0), (1, 2, 1, 3.0, 3.0)]
    flat = generators.grid(spark, 30, 30).withColumn("v", (F.col("x") % 3).cast("double")).withColumn("label", F.when(F.col("x").between(5, 6) & F.col("y").between(5, 6), 1).otherwise(0).cast("long"))
    assert catalog.upper_limit(flat, number=20).head()["placed"] == 20


def test_catalog_refuses_unknown_columns(spark):
    with pytest.raises(ValueError):
        catalog.catalog(spark.createDataFrame([(1, 1, 1, 1.0)], "label long, x int, y int, v double"), ["nothing"])


def test_projection_there_and_back(spark):
    plane = sky.TangentPlane.scaled((10.0, 20.0), (150.0, -30.0), (-0.1, 0.1), ((0.8, -0.6), (0.6, 0.8)))
    ra, dec = plane.to_world(F.lit(13.5), F.lit(7.25))
    x, y = plane.to_image(ra, dec)
    got = spark.range(1).select(x, y).head()
    assert math.isclose(got[0], 13.5) and math.isclose(got[1], 7.25)


def test_cosmology(spark):
    c = Cosmology(70.0, 0.7, 0.3)
    age, dist, volume = spark.range(1).select(c.age(F.lit(0.0)), c.luminosity_distance(F.lit(1.0)), c.comoving_volume(F.lit(1.0))).head()
    assert abs(age - 13.48) < 0.02 and abs(dist - 6607.7) < 1 and abs(volume / 1.51e11 - 1) < 0.02


def test_cosmology_takes_every_row(spark, tmp_path):
    rows = [(5, 1, 0.05), (2000, 1, 0.05), (700000, 2, 0.05), (700001, 1, 0.1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    names = [n for n in QUERIES if n.startswith("cosmology_") and n not in ("cosmology_redshift_of_velocity", "cosmology_comoving_volume")]
    assert len(names) == 10
    for name in names:
        got = {r["l_orderkey"]: r["result"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert set(got) == {5, 2000, 700000, 700001} and got[5] == got[2000] == got[700000] != got[700001], name
    volumes = {round(r["z"], 6): r["result"] for r in QUERIES["cosmology_comoving_volume"](spark, str(tmp_path)).collect()}
    assert set(volumes) == {1.1, 2.1} and volumes[1.1] < volumes[2.1]
    c = Cosmology()
    z = np.linspace(0, 2.1, 200001)
    inverse = 1 / np.sqrt(c.lambda0 + c.curvature0 * (1 + z) ** 2 + c.matter0 * (1 + z) ** 3)
    far = {r["l_orderkey"]: r["result"] for r in QUERIES["cosmology_proper_distance"](spark, str(tmp_path)).collect()}[700001]
    assert math.isclose(far, np.trapezoid(inverse, z) * c.hubble_distance, rel_tol=1e-6)


def test_whole_tables_are_worked_on(spark, tmp_path):
    customers = [(k, f"name {k}", float(k % 30)) for k in [0, 3, 40, 101, 1201, 20000, 90000]]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, customers[i % 7][0] if i else None, "O", 2.0 * i) for i, k in enumerate([2, 99, 101, 3000, 3001, 50000, 70000, 90000, 95000])]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in run("source_text_table")} == {(o[0], o[2], o[3]) for o in orders}
    name_of = {k: n for k, n, _ in customers}
    assert sorted((r["o_orderkey"], r["o_totalprice"], r["c_name-1"]) for r in run("table_catcolumn")) == [(o[0], o[3], name_of.get(o[1])) for o in orders]
    in_box = [k for k, _, b in customers if abs(k * 7.3 % 360 - 180) <= 20 and 20 <= b % 90 <= 40]
    assert sorted(r["c_custkey"] for r in run("box_search_closed_range")) == in_box
    brightness = 10 ** ((25.0 - 20.0) / 2.5)
    far = [(k, n, b) for k, n, b in customers if k >= 40 and k % 7 != 6]  # a distance profile isn't scaled
    assert sum(r["v"] for r in run("generate_profiles")) >= 0.99 * brightness * len(far)


def test_stacks_hold_every_event_type(spark, tmp_path):
    kinds = ["click", "error", "purchase", "signup", "view", "visit"]
    rows = [(k, float(10 * i + j)) for i, k in enumerate(kinds) for j in range(2)]
    events = spark.createDataFrame(rows, "event_type string, value double").withColumns({"user_id": F.lit(27).cast("long"), "event_id": F.lit(400).cast("long")})
    events.write.parquet(f"{tmp_path}/events.parquet")
    v = np.array([20.0 * i + 1 for i in range(6)])
    want = {"min": v.min(), "max": v.max(), "sum": v.sum(), "mean": v.mean(), "std": v.std(), "median": np.median(v), "quantile": v[1], "number": 6}
    kept = v[np.abs(v - np.median(v)) < 1.2 * v.std()]
    left = kept[np.abs(kept - np.median(kept)) < 1.2 * kept.std()]
    want |= {"sigclip_number": len(left), "sigclip_median": np.median(kept), "sigclip_mean": kept.mean(), "sigclip_std": kept.std()}
    got = {k: QUERIES[f"stack_{k}"](spark, str(tmp_path)).collect() for k in want}
    for k, x in want.items():
        assert [(r["x"], r["y"]) for r in got[k]] == [(4, 2)] and math.isclose(got[k][0]["v"], x, abs_tol=1e-6), (k, got[k])
    assert sorted((r["z"], r["v"]) for r in QUERIES["grid_add_dimension"](spark, str(tmp_path)).collect()) == list(zip(range(1, 7), v))


def test_dates(spark):
    texts = ["1970-01-02", "1970-01-01T00:01:00.25", "01/02/70", "nothing"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(dates.to_seconds(F.col("t")), dates.sub_second(F.col("t"))).collect()
    assert [r[0] for r in rows][:2] == [86400, 60] and rows[3][0] is None and rows[1][1] == 0.25
    n = spark.range(1).select(dates.night_of(F.lit(86400 + 9 * 3600 - 60), 9), dates.night_of(F.lit(86400 + 9 * 3600), 9)).head()
    assert tuple(n) == (0, 1)


def test_stream_equals_batch(spark):
    batch = {tuple(r) for r in nightly(spark.read.parquet(f"{SF}/events.parquet"), hour=9).select("night", "number").collect()}
    stream = {(r["night"], r["number"]) for r in QUERIES["stream_nights"](spark, SF).collect()}
    assert len(batch) == len(stream) and sum(n for _, n in batch) == sum(n for _, n in stream)


def test_text_table_header():
    info = text_table.parse_header(["# Column 1: ID [, u8, 5] the id", "# Column 2: NAME [name,str21, no data] text", "#Column 3 : V", "# nothing", "# Column 4: bad [a, strX]"])
    assert info[1].type == "uint8" and info[1].blank == "5" and info[2].width == 21 and info[2].blank == "no data" and info[3].type == "float64" and 4 not in info


def test_text_table_reads_blanks(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("# Column 1: A [u, u8, 5] c\n# Column 2: S [, str7, no data]\n# Column 3: F [, f32, -99]\n3 two ab  1.5\n5 no data -99\n\n 7, three   nan\n")
    rows = [tuple(r) for r in text_table.read_text_table(spark, str(p)).collect()]
    assert rows == [(3, "two ab", 1.5), (None, None, None), (7, "three", None)]


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "tessella"):
        src = os.path.join(REPO, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "tessella" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
