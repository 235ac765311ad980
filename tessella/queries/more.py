"""Whole-column reductions, crops, polygons, splines, colours, frequencies, and detection as programs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rpn, sky
from ..operators import detect, frequency, grid, polygons, programs, splines, tessellation
from ..operators import generators as gen
from ..plans import side_files
from ..plans.lineage import shared_dir
from ..sources import registry
from .grids import HOLED, IMAGE, holed, image
from .registry import ORACLES, QUERIES, query, table

PLANE = sky.TangentPlane.scaled((12.0, 15.0), (359.99, 30.0), (-0.01, 0.01), ((0.8, -0.6), (0.6, 0.8)))

_REDUCED = {"minvalue": "min(l_quantity)", "maxvalue": "max(l_quantity)", "numbervalue": "count(l_quantity)", "sumvalue": "sum(l_quantity)", "meanvalue": "avg(l_quantity)", "stdvalue": "stddev_pop(l_quantity)", "medianvalue": "median(l_quantity)"}


def _register(name: str, sql: str) -> None:
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "lineitem")
        c = rpn.evaluate(df, f"l_extendedprice l_quantity {name} /")[-1]
        return df.select("l_orderkey", "l_linenumber", rounded(c).alias("result"))

    # Prices in cents over a whole number often lie half way between two roundings; but for the deviation all quotients are exact as they are.
    rounded = (lambda c: F.round(c, 6)) if name == "stdvalue" else lambda c: c
    quotient = f"l_extendedprice / (SELECT {sql} FROM lineitem)"
    QUERIES[f"rpn_{name}"] = run
    ORACLES[f"rpn_{name}"] = f"SELECT l_orderkey, l_linenumber, {f'round({quotient}, 6)' if name == 'stdvalue' else quotient} AS result FROM lineitem"


for _name, _sql in _REDUCED.items():
    _register(_name, _sql)


@query("rpn_size", "SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem) AS result FROM lineitem")
def rpn_size(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", rpn.evaluate(df, "l_quantity 1 size")[-1].alias("result"))


@query("rpn_tofile", "SELECT l_orderkey, l_linenumber, 'result' AS kind, l_extendedprice * l_discount / l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'file', l_extendedprice * l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'freed', l_tax + l_quantity FROM lineitem")
def rpn_tofile(spark, sf_dir):
    """An expression's result, and the files that it writes on the way, read back."""
    folder, keys = f"{shared_dir(spark)}/{uuid.uuid4().hex}", ["l_orderkey", "l_linenumber"]
    out = side_files.evaluate(table(spark, sf_dir, "lineitem"), "l_tax l_quantity + tofilefree-freed.fits l_extendedprice l_discount x tofile-product.parquet l_quantity /", folder, keys)
    parts = [out.withColumnRenamed("ARITH_1", "v"), spark.read.parquet(f"{folder}/product.parquet").withColumnRenamed("value", "v"), registry.read(spark, f"{folder}/freed.fits").withColumnRenamed("value", "v")]
    named = [d.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), F.lit(kind).alias("kind"), "v") for d, kind in zip(parts, ("result", "file", "freed"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("rpn_makenew", f"SELECT CAST(i.range AS INTEGER) AS x, CAST(j.range AS INTEGER) AS y, CAST(k.range AS INTEGER) AS z, CAST(0 AS DOUBLE) AS v FROM range(1, (SELECT max(x) FROM ({IMAGE})) + 1) i, range(1, (SELECT max(y) FROM ({IMAGE})) + 1) j, range(1, 4) k")
def rpn_makenew(spark, sf_dir):
    """An empty cube as wide and high as the events' image."""
    nx, ny = image(spark, sf_dir).agg(F.max("x"), F.max("y")).head()
    return gen.make_new(spark, [nx, ny, 3])


@query("crop_section", f"SELECT CAST(x - 4 AS INTEGER) AS x, CAST(y - 2 AS INTEGER) AS y, round(v, 6) AS v FROM ({IMAGE}) WHERE x BETWEEN 5 AND (SELECT max(x) FROM ({IMAGE})) - 3 AND y >= 3")
def crop_section(spark, sf_dir):
    return polygons.section(image(spark, sf_dir), "5:*-3,3:*").withColumn("v", F.round("v", 6))


_DIAMOND = [(12.0, 1.2), (20.3, 9.1), (12.4, 17.7), (3.1, 8.6)]
_SIDES = " AND ".join(f"({x2}-({x1}))*(y-({y1}))-(x-({x1}))*({y2}-({y1})) > 0" for (x1, y1), (x2, y2) in zip(_DIAMOND, [*_DIAMOND[1:], _DIAMOND[0]]))


@query("crop_polygon", f"SELECT x, y, CASE WHEN {_SIDES} THEN round(v, 6) END AS v FROM ({IMAGE}) WHERE x BETWEEN 3.1 AND 20.3 AND y BETWEEN 1.2 AND 17.7")
def crop_polygon(spark, sf_dir):
    return polygons.polygon(image(spark, sf_dir), _DIAMOND).withColumn("v", F.round("v", 6))


_QUADS = "SELECT p_partkey, 0.0 AS x1, 0.0 AS y1, CAST(p_size AS DOUBLE) AS x2, 0.0 AS y2, CAST(p_size AS DOUBLE) * ((p_partkey * 7 % 20) / 20.0) AS x3, 10.0 AS y3, 0.0 AS x4, CAST(p_partkey % 15 AS DOUBLE) + 1 AS y4 FROM part"


def _quads(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size").cast("double")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0.0)
    corners = F.array(at(zero, zero), at(size, zero), at(size * ((F.col("p_partkey") * 7 % 20) / 20.0), F.lit(10.0)), at(zero, F.col("p_partkey") % 15 + 1))
    return p.select("p_partkey", corners.alias("corners"))


def _cross(a: int, b: int, c: int) -> str:
    return f"((x{b}-x{a})*(y{c}-y{b})-(y{b}-y{a})*(x{c}-x{b}))"


_TURNS = [_cross(*t) for t in ((4, 1, 2), (1, 2, 3), (2, 3, 4), (3, 4, 1))]


@query("polygon_convex", f"SELECT p_partkey, NOT (greatest({', '.join(_TURNS)}) > 0 AND least({', '.join(_TURNS)}) < 0) AS convex, (x1*y2-x2*y1 + x2*y3-x3*y2 + x3*y4-x4*y3 + x4*y1-x1*y4) > 0 AS counterclockwise FROM ({_QUADS})")
def polygon_convex(spark, sf_dir):
    q = _quads(spark, sf_dir)
    return q.select("p_partkey", polygons.is_convex(F.col("corners")).alias("convex"), polygons.is_counterclockwise(F.col("corners")).alias("counterclockwise"))


@query("polygon_clip", "SELECT p_partkey, round(greatest(least(CAST(p_size AS DOUBLE), 20.5) - 3.25, 0) * (least(p_retailprice, 1200.0) - 10), 4) AS area FROM part")
def polygon_clip(spark, sf_dir):
    """The area that each part's box shares with a fixed one."""
    w, h = F.col("p_size").cast("double"), F.col("p_retailprice")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    box = F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h))
    window = F.array(*[at(F.lit(x), F.lit(y)) for x, y in ((3.25, 10.0), (20.5, 10.0), (20.5, 1200.0), (3.25, 1200.0))])
    both = table(spark, sf_dir, "part").select("p_partkey", polygons.clip(box, window).alias("p"))
    return both.select("p_partkey", F.round(F.when(F.size("p") > 0, gen.polygon_area(F.col("p"))).otherwise(0.0), 4).alias("area"))


@query("polygon_sort", "SELECT p_partkey, k AS corner, CASE WHEN k IN (2, 3) THEN CAST(p_size AS DOUBLE) ELSE 0 END AS x, CASE WHEN k IN (3, 4) THEN p_retailprice ELSE 0 END AS y FROM part, (VALUES (1), (2), (3), (4)) t(k)")
def polygon_sort(spark, sf_dir):
    """Corners in disorder come back counter-clockwise."""
    w, h = F.col("p_size").cast("double"), F.col("p_retailprice")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    mixed = F.array(at(w, h), at(zero, zero), at(zero, h), at(w, zero))
    s = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(polygons.sort_counterclockwise(mixed)).alias("k", "p"))
    return s.select("p_partkey", (F.col("k") + 1).alias("corner"), "p.x", "p.y")


_GAPS = "SELECT event_type, event_id, CASE WHEN event_id % 7 <> 3 THEN value END AS v FROM events"
_KNOWN = f"SELECT event_type, CAST(event_id AS DOUBLE) AS x, v AS y, {{}} FROM ({_GAPS}) WHERE v IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY event_id)"
_SHIFTS = ", ".join(f"{f}({c}, {k}) OVER w AS {c}{n}" for c in ("event_id", "v") for f, k, n in (("lag", 1, "m"), ("lead", 1, "p")))
_STEFFEN = (
    f"WITH k AS ({_KNOWN.format(_SHIFTS)}),"
    " r AS (SELECT *, (y - vm) / (x - event_idm) AS rb, (vp - y) / (event_idp - x) AS ra, x - event_idm AS hb, event_idp - x AS ha FROM k),"
    " s AS (SELECT event_type, x, y, coalesce((sign(rb) + sign(ra)) * least(abs(rb), abs(ra), 0.5 * abs((rb * ha + ra * hb) / (hb + ha))), ra, rb, 0) AS s, lead(x) OVER (PARTITION BY event_type ORDER BY x) AS xn FROM r),"
    " t AS (SELECT a.*, b.y AS yn, b.s AS sn FROM s a JOIN s b ON a.event_type = b.event_type AND a.xn = b.x),"
    f" g AS (SELECT g.event_type, g.event_id, g.v, t.*, (g.event_id - t.x) / (xn - t.x) AS u, xn - t.x AS h FROM ({_GAPS}) g LEFT JOIN t ON g.v IS NULL AND g.event_type = t.event_type AND g.event_id > t.x AND g.event_id < t.xn)"
    " SELECT event_type, event_id, round(coalesce(v, y*(1+2*u)*(1-u)*(1-u) + s*h*u*(1-u)*(1-u) + yn*u*u*(3-2*u) - sn*h*u*u*(1-u)) + 1e-8, 6) AS value FROM g"
).replace("SELECT g.event_type, g.event_id, g.v, t.*,", "SELECT g.event_type, g.event_id, g.v, t.x, t.y, t.s, t.yn, t.sn,")


def _gaps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", "event_id", F.when(F.col("event_id") % 7 != 3, F.col("value")).alias("value"))


@query("interpolate_steffen", _STEFFEN)
def interpolate_steffen(spark, sf_dir):
    return splines.fill_local(_gaps(spark, sf_dir), "event_id", "value", ["event_type"]).withColumn("value", F.round(F.col("value") + 1e-8, 6))  # off the ties of rounding


@query("interpolate_akima")
def interpolate_akima(spark, sf_dir):
    return splines.fill_local(_gaps(spark, sf_dir), "event_id", "value", ["event_type"], "akima")


@query("interpolate_cspline")
def interpolate_cspline(spark, sf_dir):
    return splines.fill_whole(_gaps(spark, sf_dir), "event_id", "value", ["event_type"], "cspline")


@query("interpolate_periodic")
def interpolate_periodic(spark, sf_dir):
    """The last known value of each type stands for the first, as a period asks for."""
    e = _gaps(spark, sf_dir)
    known = e.where(F.col("value").isNotNull()).groupBy("event_type").agg(F.max("event_id").alias("last"), F.min_by("value", "event_id").alias("start"))
    closed = e.join(F.broadcast(known), "event_type")  # a row for each of five types
    return splines.fill_whole(closed.select("event_type", "event_id", F.when(F.col("event_id") == F.col("last"), F.col("start")).otherwise(F.col("value")).alias("value")), "event_id", "value", ["event_type"], "periodic")


@query(
    "interpolate_polynomial",
    "SELECT event_id, round(CASE WHEN k <> 1 THEN value WHEN n = 3 THEN a / 3 + c - d / 3 WHEN a IS NOT NULL AND c IS NOT NULL THEN (a + c) / 2 END, 6) AS value FROM"
    " (SELECT event_id, value, event_id % 4 AS k, count(*) FILTER (event_id % 4 <> 1) OVER w AS n, max(CASE WHEN event_id % 4 = 0 THEN value END) OVER w AS a, max(CASE WHEN event_id % 4 = 2 THEN value END) OVER w AS c, max(CASE WHEN event_id % 4 = 3 THEN value END) OVER w AS d FROM events WINDOW w AS (PARTITION BY event_id // 4))",
)
def interpolate_polynomial(spark, sf_dir):
    """Parabolas through the three known of every four events."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("block"), "event_id", F.when(F.col("event_id") % 4 != 1, F.col("value")).alias("value"))
    return splines.fill_whole(e, "event_id", "value", ["block"], "polynomial").select("event_id", F.round("value", 6).alias("value"))


_KERNEL = {(i, j): 1.0 / (1 + abs(i) + 2 * abs(j)) for i in (-2, -1, 0, 1, 2) for j in (-1, 0, 1)}
_WEIGHTS = ", ".join(f"({i}, {j}, CAST({w!r} AS DOUBLE))" for (i, j), w in _KERNEL.items())


@query("convolve_frequency", f"WITH m AS ({HOLED}) SELECT a.x, a.y, round(coalesce(sum(b.v * k.w), 0) / {sum(_KERNEL.values())!r}, 4) AS v FROM m a JOIN (VALUES {_WEIGHTS}) k(i, j, w) ON true LEFT JOIN m b ON b.x = a.x - k.i AND b.y = a.y - k.j GROUP BY a.x, a.y")
def convolve_frequency(spark, sf_dir):
    whole = holed(spark, sf_dir)
    out = frequency.convolve(whole, _KERNEL).join(whole.select("x", "y"), ["x", "y"], "left_semi")
    return out.withColumn("v", F.round("v", 4))


@query("deconvolve_frequency", f"SELECT x, y, round(v, 4) AS v FROM ({IMAGE})")
def deconvolve_frequency(spark, sf_dir):
    """An image convolved and deconvolved is itself; it is padded, so that nothing is lost at its edges."""
    kernel = {(0, 0): 4.0, (1, 0): 1.0, (0, 1): 1.0}
    i = image(spark, sf_dir)
    ends = i.agg(F.max("x").alias("x"), F.max("y").alias("y")).head()
    padded = i.unionByName(gen.grid(spark, ends["x"] + 2, ends["y"] + 2).where((F.col("x") > ends["x"]) | (F.col("y") > ends["y"])).withColumn("v", F.lit(0.0)))
    there = frequency.convolve(padded, kernel)
    back = frequency.convolve(there, kernel, inverse=True).join(i.select("x", "y"), ["x", "y"], "left_semi")
    return back.withColumn("v", F.round("v", 4))


@query("frequency_kernel", "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(w / 7.0, 6) AS w FROM (VALUES (0, 0, 4.0), (1, 0, 2.0), (0, -1, 1.0)) k(i, j, w) UNION ALL SELECT CAST(a.range - 1 AS INTEGER), CAST(b.range - 1 AS INTEGER), 0.0 FROM range(3) a, range(3) b WHERE (a.range, b.range) NOT IN ((1, 1), (2, 1), (1, 0))")
def frequency_kernel(spark, sf_dir):
    """The kernel between an image and its blurred self; the image stands apart from its edges."""
    i = image(spark, sf_dir).select((F.col("x") + 2).alias("x"), (F.col("y") + 2).alias("y"), "v")
    ends = i.agg(F.max("x").alias("x"), F.max("y").alias("y")).head()
    padded = gen.grid(spark, ends["x"] + 2, ends["y"] + 2).join(i, ["x", "y"], "left").select("x", "y", F.coalesce("v", F.lit(0.0)).alias("v"))
    blurred = frequency.convolve(padded, {(0, 0): 4.0, (1, 0): 2.0, (0, -1): 1.0})
    k = frequency.kernel(padded, blurred, 1)
    return k.select("i", "j", (F.round("w", 6) + 0.0).alias("w"))


@query("crop_mosaic", f"WITH a AS ({HOLED}), b AS (SELECT x + 10 AS x, y + 1 AS y, v FROM ({IMAGE})) SELECT x, y, round(coalesce(a.v, b.v), 6) AS v FROM a FULL JOIN b USING (x, y)")
def crop_mosaic(spark, sf_dir):
    """An image with holes over itself moved."""
    out = polygons.mosaic([(holed(spark, sf_dir), 0, 0), (image(spark, sf_dir), 10, 1)])
    return out.withColumn("v", F.round("v", 6))


@query("sky_coverage")
def sky_coverage(spark, sf_dir):
    return sky.coverage(PLANE, image(spark, sf_dir))


@query("warp_align")
def warp_align(spark, sf_dir):
    """An image turned so that its axes run along the sky's."""
    return gen.warp(image(spark, sf_dir), gen.align_steps(PLANE.cd), covered=0.9)


_SCALED = "least(greatest((l_quantity - 5) / 40, 0.0), 1.0)"


@query("color_map", f"SELECT l_orderkey, l_linenumber, round(least(greatest(3*{_SCALED}, 0.0), 1.0), 6) AS r, round(least(greatest(3*{_SCALED} - 1, 0.0), 1.0), 6) AS g, round(least(greatest(3*{_SCALED} - 2, 0.0), 1.0), 6) AS b FROM lineitem")
def color_map(spark, sf_dir):
    r, g, b = gen.color_map(F.col("l_quantity"), F.lit(5.0), F.lit(45.0), "heat")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(r, 6).alias("r"), F.round(g, 6).alias("g"), F.round(b, 6).alias("b"))


@query("permutation", "SELECT (n - 1) - p_partkey AS p_partkey, p_name FROM part, (SELECT count(*) AS n FROM part)")
def permutation(spark, sf_dir):
    """The parts in reverse order."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    order = p.select(F.col("p_partkey").alias("place"), (p.agg(F.count("*")).scalar() - 1 - F.col("p_partkey")).alias("source"))
    return gen.permute(p, "p_partkey", order)


@query("coordinates_and_index", "SELECT o_orderkey, o_orderkey // 35 % 11 AS i, o_orderkey // 5 % 7 AS j, o_orderkey % 5 AS k, o_orderkey % 385 AS back FROM orders")
def coordinates_and_index(spark, sf_dir):
    i, j, k = gen.coordinates(F.col("o_orderkey"), [11, 7, 5])
    return table(spark, sf_dir, "orders").select("o_orderkey", i.alias("i"), j.alias("j"), k.alias("k"), gen.index_of([i, j, k], [11, 7, 5]).alias("back"))


SHARP = {(0, 0): 4.0, (1, 0): 1.0, (-1, 0): 1.0, (0, 1): 1.0, (0, -1): 1.0}
DETECTION = programs.Detection(tile=[8, 8], large=[24, 16], kernel=SHARP, most=0.2, q=0.5, no_erode=0.95, grow_q=0.85, neighbours=9, erode=1, opening=1, opening_reach=1, pseudo_opening_reach=1, area=2, sn_q=0.5, free=0.3, hole_cells=20)
SEGMENTATION = programs.Segmentation(large=[24, 16], kernel=SHARP, area=1, q=0.5, near_river=True)


@query("detect_program")
def detect_program(spark, sf_dir):
    return programs.detections(image(spark, sf_dir), DETECTION)


@query("segment_objects")
def segment_objects(spark, sf_dir):
    d = programs.detections(image(spark, sf_dir), DETECTION)
    return programs.segment(d.join(image(spark, sf_dir), ["x", "y"]), SEGMENTATION)


def _tiles(spark, sf_dir):
    t = grid.tile_statistics(holed(spark, sf_dir), [4, 3], [F.avg("v").alias("v")])
    return t.withColumn("v", F.when(F.col("tx") * 7 + F.col("ty") * 5 == 24, F.col("v") * 40).otherwise(F.col("v")))


@query("tile_outliers_global")
def tile_outliers_global(spark, sf_dir):
    return detect.tile_outliers_global(_tiles(spark, sf_dir), sigma=20.0)


@query("tile_outliers_local")
def tile_outliers_local(spark, sf_dir):
    return detect.tile_outliers_local(_tiles(spark, sf_dir), sigma=8.0)


def _tessellation(spark, sf_dir):
    """Three channels of eight columns each, in tiles of 3 x 7."""
    return tessellation.Tessellation([24, image(spark, sf_dir).agg(F.max("y")).head()[0]], [3, 7], [3, 1], 0.3)


# 8 columns a channel leave 2, more than 0.3 of 3: 2 + 3 + 3.  The rows' remainder depends on their number.
_ROWS = f"r AS (SELECT ny, ny % 7 AS rest, CASE WHEN 7 >= ny THEN ny WHEN ny % 7 = 0 THEN 7 WHEN ny % 7 > 2.1 THEN (ny % 7 + 7) // 2 ELSE ny % 7 + 7 END AS first, CASE WHEN 7 >= ny THEN 1 WHEN ny % 7 > 2.1 THEN ny // 7 + 1 ELSE ny // 7 END AS n FROM (SELECT CAST(max(y) AS BIGINT) AS ny FROM ({IMAGE})))"
_TILED = f"WITH {_ROWS}, c AS (SELECT x, y, v, (x - 1) // 8 AS channel, CASE WHEN (x - 1) % 8 < 2 THEN 0 ELSE ((x - 1) % 8 - 2) // 3 + 1 END AS tx, CASE WHEN y - 1 < first THEN 0 ELSE least((y - 1 - first) // 7 + 1, n - 1) END AS ty, n FROM ({IMAGE}), r)"
_PLACED = "CAST(channel * 3 * n + ty * 3 + tx AS BIGINT) AS tile, CAST(ty * 9 + channel * 3 + tx AS BIGINT) AS place"


@query("tessellation_ids", f"{_TILED} SELECT x, y, CAST(channel AS BIGINT) AS channel, {_PLACED} FROM c")
def tessellation_ids(spark, sf_dir):
    t = _tessellation(spark, sf_dir)
    d = image(spark, sf_dir).select("x", "y", t.channel().alias("channel"), t.tile().cast("long").alias("tile"))
    return d.withColumn("place", t.place(F.col("tile")).cast("long"))


@query("tessellation_statistics", f"{_TILED} SELECT tile, place, count(*) AS number, round(sum(v), 4) AS sum, max(v) AS top FROM (SELECT {_PLACED}, v FROM c) GROUP BY tile, place")
def tessellation_statistics(spark, sf_dir):
    got = _tessellation(spark, sf_dir).statistics(image(spark, sf_dir), [F.count("*").alias("number"), F.round(F.sum("v"), 4).alias("sum"), F.max("v").alias("top")])
    return got.withColumns({n: F.col(n).cast("long") for n in ("tile", "place")})


@query("tessellation_permutation", f"WITH {_ROWS} SELECT CAST(ty * 9 + channel * 3 + tx AS BIGINT) AS place, CAST(channel * 3 * n + ty * 3 + tx AS BIGINT) AS tile FROM r, (SELECT range AS channel FROM range(3)), (SELECT range AS tx FROM range(3)), (SELECT range AS ty FROM range((SELECT n FROM r)))")
def tessellation_permutation(spark, sf_dir):
    return _tessellation(spark, sf_dir).permutation(spark).select(F.col("place").cast("long"), "tile")


# Weights whose sums are no round numbers, so that no mean lies half way between two roundings.
_SLOPED = {(i, j): 1.0 / (1.37 + 1.13 * abs(i) + 2.21 * abs(j)) for i in (-2, -1, 0, 1, 2) for j in (-1, 0, 1)}
_SLOPED_WEIGHTS = ", ".join(f"({i}, {j}, CAST({w!r} AS DOUBLE))" for (i, j), w in _SLOPED.items())
_BY_CHANNEL = f"WITH m AS ({HOLED}) SELECT a.x, a.y, round(sum(b.v * k.w) / sum(k.w) FILTER (b.v IS NOT NULL), 6) AS v FROM m a JOIN (VALUES {_SLOPED_WEIGHTS}) k(i, j, w) ON true LEFT JOIN m b ON b.x = a.x - k.i AND b.y = a.y - k.j{{}} GROUP BY a.x, a.y"


@query("convolve_channels", _BY_CHANNEL.format(" AND (b.x - 1) // 8 = (a.x - 1) // 8"))
def convolve_channels(spark, sf_dir):
    return _tessellation(spark, sf_dir).convolve(holed(spark, sf_dir), _SLOPED).withColumn("v", F.round("v", 6))


@query("convolve_channel_edges", _BY_CHANNEL.format(""))
def convolve_channel_edges(spark, sf_dir):
    """Convolved by channels and corrected at their edges: as if there were none."""
    t, cells = _tessellation(spark, sf_dir), holed(spark, sf_dir)
    return t.correct_edges(cells, t.convolve(cells, _SLOPED), _SLOPED).withColumn("v", F.round("v", 6))
