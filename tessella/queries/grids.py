"""Grid operators over an image made of events: 24 columns by user, a row for every 330 events, v the sum of
values.  The image grows with the table, and its values do not."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, generators as gen, grid, watershed
from .registry import clip_sql, query, table

IMAGE = "SELECT CAST(user_id % 24 + 1 AS INTEGER) AS x, CAST(event_id // 330 + 1 AS INTEGER) AS y, sum(value) AS v FROM events GROUP BY 1, 2"
#: The same with blanks, and thresholded.
HOLED = f"SELECT x, y, CASE WHEN (x * 7 + y * 3) % 11 = 0 THEN NULL ELSE v END AS v FROM ({IMAGE})"
MASK = f"SELECT x, y, CAST(v > 650 AS INTEGER) AS v FROM ({IMAGE})"


def _cell():
    return (F.col("user_id") % 24 + 1).cast("int").alias("x"), (F.floor(F.col("event_id") / 330) + 1).cast("int").alias("y")


def image(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(*_cell()).agg(F.sum("value").alias("v"))


def holed(spark, sf_dir):
    return image(spark, sf_dir).withColumn("v", F.when((F.col("x") * 7 + F.col("y") * 3) % 11 != 0, F.col("v")))


def mask(spark, sf_dir):
    return image(spark, sf_dir).withColumn("v", (F.col("v") > 650).cast("int"))


def _r(df, k=6):
    return df.withColumn("v", F.round("v", k))


for _how, _sql in {"sum": "round(sum(v), 6)", "mean": "round(avg(v), 6)", "number": "CAST(count(v) AS INTEGER)", "min": "round(min(v), 6)", "max": "round(max(v), 6)"}.items():

    def _collapse(spark, sf_dir, how=_how):
        out = grid.collapse(holed(spark, sf_dir), "y", how)
        return out if how == "number" else _r(out)

    query(f"grid_collapse_{_how}", f"SELECT x, {_sql} AS v FROM ({HOLED}) GROUP BY x")(_collapse)


@query("grid_collapse_weighted", f"SELECT y, round(sum(v * x) / sum(x), 6) AS v FROM ({HOLED}) WHERE v IS NOT NULL GROUP BY y")
def grid_collapse_weighted(spark, sf_dir):
    return _r(grid.collapse(holed(spark, sf_dir).withColumn("w", F.col("x")), "x", "mean", weight="w"))


_BOX = f"SELECT a.x, a.y, b.v FROM ({HOLED}) a JOIN ({HOLED}) b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 2 AND a.y + 1"


@query("grid_filter_mean", f"SELECT x, y, round(avg(v), 6) AS v FROM ({_BOX}) GROUP BY x, y")
def grid_filter_mean(spark, sf_dir):
    return _r(grid.moving_filter(holed(spark, sf_dir), [3, 4], "mean"))


@query("grid_filter_median", f"SELECT x, y, round(median(v), 6) AS v FROM ({_BOX}) GROUP BY x, y")
def grid_filter_median(spark, sf_dir):
    return _r(grid.moving_filter(holed(spark, sf_dir), [3, 4], "median"))


_BOX5 = clip_sql(f"SELECT a.x, a.y, b.v FROM ({HOLED}) a JOIN ({HOLED}) b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2", ["x", "y"], 1.5, 2)


@query("grid_filter_sigclip_mean", _BOX5 + " SELECT x, y, round(mean, 6) AS v FROM clipped")
def grid_filter_sigclip_mean(spark, sf_dir):
    return _r(grid.moving_filter(holed(spark, sf_dir), [5, 5], "sigclip-mean", clip=(1.5, 2)))


@query("grid_filter_sigclip_median", _BOX5 + " SELECT x, y, round(median, 6) AS v FROM clipped")
def grid_filter_sigclip_median(spark, sf_dir):
    return _r(grid.moving_filter(holed(spark, sf_dir), [5, 5], "sigclip-median", clip=(1.5, 2)))


_N4 = "abs(a.x - b.x) + abs(a.y - b.y) = 1"
_N8 = "greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1"


@query("grid_erode", f"WITH m AS ({MASK}) SELECT a.x, a.y, CAST(CASE WHEN a.v = 1 AND EXISTS (SELECT 1 FROM m b WHERE {_N4} AND b.v = 0) THEN 0 ELSE a.v END AS INTEGER) AS v FROM m a")
def grid_erode(spark, sf_dir):
    return grid.erode(mask(spark, sf_dir), 1)


@query("grid_dilate", f"WITH m AS ({MASK}) SELECT a.x, a.y, CAST(CASE WHEN EXISTS (SELECT 1 FROM m b WHERE {_N8} AND b.v = 1) THEN 1 ELSE a.v END AS INTEGER) AS v FROM m a")
def grid_dilate(spark, sf_dir):
    return grid.dilate(mask(spark, sf_dir), 2)


@query("grid_opening", f"WITH m AS ({MASK}), e AS (SELECT a.x, a.y, CASE WHEN a.v = 1 AND EXISTS (SELECT 1 FROM m b WHERE {_N4} AND b.v = 0) THEN 0 ELSE a.v END AS v FROM m a) SELECT a.x, a.y, CAST(CASE WHEN EXISTS (SELECT 1 FROM e b WHERE {_N4} AND b.v = 1) THEN 1 ELSE a.v END AS INTEGER) AS v FROM e a")
def grid_opening(spark, sf_dir):
    return grid.opening(mask(spark, sf_dir), 1, 1)


_CC = (
    "WITH RECURSIVE m AS ({mask}), s AS (SELECT x, y, y * 1000 + x AS id FROM m WHERE v = {on}), e AS (SELECT a.id AS i, b.id AS j FROM s a JOIN s b ON {near}),"
    " w(i, r) AS (SELECT id, id FROM s UNION SELECT e.j, w.r FROM w JOIN e ON e.i = w.i WHERE w.r < e.j), c AS (SELECT i, min(r) AS root FROM w GROUP BY i)"
)


@query("grid_connected_components", _CC.format(mask=MASK, on=1, near=_N8) + " SELECT m.x, m.y, CAST(coalesce(k, 0) AS BIGINT) AS label FROM m LEFT JOIN (SELECT i, dense_rank() OVER (ORDER BY root) AS k FROM c) ON i = m.y * 1000 + m.x")
def grid_connected_components(spark, sf_dir):
    return grid.connected_components(mask(spark, sf_dir), 2)


@query(
    "grid_fill_holes",
    _CC.format(mask=MASK, on=0, near=_N4) + ", b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM m), o AS (SELECT root FROM c, b GROUP BY root HAVING bool_or(i % 1000 IN (x0, x1) OR i // 1000 IN (y0, y1)))"
    " SELECT m.x, m.y, CAST(CASE WHEN m.v = 0 AND root NOT IN (SELECT root FROM o) THEN 1 ELSE m.v END AS INTEGER) AS v FROM m LEFT JOIN c ON i = m.y * 1000 + m.x",
)
def grid_fill_holes(spark, sf_dir):
    return grid.fill_holes(mask(spark, sf_dir), 1)


@query("grid_invert", "SELECT l_orderkey, l_linenumber, CAST(255 - l_linenumber AS INTEGER) AS v FROM lineitem")
def grid_invert(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", grid.invert(F.col("l_linenumber"), 8).cast("int").alias("v"))


_NEAREST = f"SELECT a.x, a.y, b.v, row_number() OVER (PARTITION BY a.x, a.y ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.x, b.y) AS k FROM ({HOLED}) a, ({HOLED}) b WHERE a.v IS NULL AND b.v IS NOT NULL"
#: Blanks some of which touch, so that regions have several cells.
PATCHED = HOLED.replace("% 11 = 0", "% 11 < 2")

for _how in ("min", "max", "median"):

    def _neighbours(spark, sf_dir, how=_how):
        return _r(grid.interpolate_neighbours(holed(spark, sf_dir), 4, how))

    query(f"grid_interpolate_{_how}ngb", f"SELECT x, y, round(coalesce(h.v, n.v), 6) AS v FROM ({HOLED}) h LEFT JOIN (SELECT x, y, {_how}(v) AS v FROM ({_NEAREST}) WHERE k <= 4 GROUP BY x, y) n USING (x, y)")(_neighbours)

    if _how != "median":

        def _region(spark, sf_dir, how=_how):
            patched = image(spark, sf_dir).withColumn("v", F.when((F.col("x") * 7 + F.col("y") * 3) % 11 >= 2, F.col("v")))
            return _r(grid.interpolate_region(patched, how, 2))

        query(
            f"grid_interpolate_{_how}ofregion",
            _CC.format(mask=f"SELECT x, y, v AS w, CAST(v IS NULL AS INTEGER) AS v FROM ({PATCHED})", on=1, near=_N8)
            + f", fill AS (SELECT root, {_how}(b.w) AS f FROM c JOIN m a ON c.i = a.y * 1000 + a.x JOIN m b ON {_N8} WHERE b.v = 0 GROUP BY root)"
            " SELECT m.x, m.y, round(coalesce(m.w, f), 6) AS v FROM m LEFT JOIN c ON i = m.y * 1000 + m.x LEFT JOIN fill USING (root)",
        )(_region)


@query("grid_convolve", f"WITH m AS ({HOLED}) SELECT a.x, a.y, round(sum(b.v * w) / sum(w), 6) AS v FROM m a LEFT JOIN (SELECT *, NULL AS z FROM m WHERE v IS NOT NULL) b ON greatest(abs(a.x-b.x), abs(a.y-b.y)) <= 1 LEFT JOIN (VALUES (0, 4.0::DOUBLE), (1, 2.0), (2, 1.0)) k(d, w) ON d = abs(a.x-b.x) + abs(a.y-b.y) GROUP BY a.x, a.y")
def grid_convolve(spark, sf_dir):
    kernel = {(i, j): (4.0, 2.0, 1.0)[abs(i) + abs(j)] for i in (-1, 0, 1) for j in (-1, 0, 1)}
    return _r(grid.convolve(holed(spark, sf_dir), kernel))


@query("grid_tile_statistics", f"SELECT CAST((x-1)//6 AS BIGINT) AS tx, CAST((y-1)//5 AS BIGINT) AS ty, count(v) AS number, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM ({HOLED}) GROUP BY 1, 2")
def grid_tile_statistics(spark, sf_dir):
    return grid.tile_statistics(holed(spark, sf_dir), [6, 5], [F.count("v").alias("number"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("median")])


@query("grid_sky")
def grid_sky(spark, sf_dir):
    return grid.sky(image(spark, sf_dir), [6, 6], most=0.2)


@query("grid_contour", f"WITH m AS ({IMAGE}) SELECT a.x, a.y, round(a.v, 6) AS v FROM m a WHERE a.v > 400 AND EXISTS (SELECT 1 FROM m b WHERE {_N4} AND b.v <= 400)")
def grid_contour(spark, sf_dir):
    return _r(grid.contour(image(spark, sf_dir), 400.0))


_STACK = IMAGE.replace("AS y, ", "AS y, event_type, ").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3")


def _images(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    kinds = [r[0] for r in t.select("event_type").distinct().orderBy("event_type").collect()]
    base = t.groupBy(*_cell(), "event_type").agg(F.sum("value").alias("v"))
    return [base.where(F.col("event_type") == k).drop("event_type") for k in kinds]


for _how, _sql in {"min": "min(v)", "max": "max(v)", "sum": "sum(v)", "mean": "avg(v)", "std": "stddev_pop(v)", "median": "median(v)", "quantile": "list_sort(list(v))[CAST(ceil((count(v)-1)*0.3 - 0.5) AS BIGINT) + 1]"}.items():

    def _combine(spark, sf_dir, how=_how):
        return _r(grid.combine(_images(spark, sf_dir), how, q=0.3))

    query(f"stack_{_how}", f"SELECT x, y, round({_sql}, 6) AS v FROM ({_STACK}) GROUP BY x, y")(_combine)


@query("stack_number", f"SELECT x, y, count(v) AS v FROM ({_STACK}) GROUP BY x, y")
def stack_number(spark, sf_dir):
    return grid.combine(_images(spark, sf_dir), "number")


for _how in ("number", "median", "mean", "std"):

    def _clip(spark, sf_dir, how=_how):
        out = grid.combine(_images(spark, sf_dir), f"sigclip-{how}", clip=(1.2, 2))
        return out if how == "number" else _r(out)

    query(f"stack_sigclip_{_how}", clip_sql(f"SELECT x, y, v FROM ({_STACK})", ["x", "y"], 1.2, 2) + f" SELECT x, y, {'number' if _how == 'number' else f'round({_how}, 6)'} AS v FROM clipped")(_clip)


@query("grid_add_dimension", f"SELECT x, y, CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS z, round(v, 6) AS v FROM ({_STACK})")
def grid_add_dimension(spark, sf_dir):
    return _r(grid.stack(_images(spark, sf_dir)))


@query("detect_initial")
def detect_initial(spark, sf_dir):
    return detect.initial_detection(image(spark, sf_dir), [6, 6], q=0.5, erode=0)


_LABELS = _CC.format(mask=MASK, on=1, near=_N8) + f", i AS ({IMAGE}), l AS (SELECT m.x, m.y, CAST(coalesce(k, 0) AS BIGINT) AS label FROM m LEFT JOIN (SELECT i, dense_rank() OVER (ORDER BY root) AS k FROM c) q ON q.i = m.y * 1000 + m.x)"


@query(
    "detect_signal_to_noise",
    _LABELS + ", g AS (SELECT label, count(v) AS area, avg(v) - 300 AS ave FROM l JOIN i USING (x, y) WHERE label > 0 GROUP BY label)"
    " SELECT label, area, round(sqrt(area) * ave / sqrt(ave + 2500), 6) AS sn FROM g WHERE area > 1 AND ave > 0",
)
def detect_signal_to_noise(spark, sf_dir):
    labels = grid.connected_components(mask(spark, sf_dir), 2)
    return detect.signal_to_noise(labels.join(image(spark, sf_dir), ["x", "y"]), 300.0, 50.0).withColumn("sn", F.round("sn", 6))


_STEP = (
    "{to} AS (SELECT a.x, a.y, CASE WHEN a.label = 0 AND i.v >= 350 THEN coalesce(n.label, 0) ELSE a.label END AS label FROM {of} a JOIN i USING (x, y)"
    " LEFT JOIN (SELECT a.x, a.y, min(b.label) AS label FROM {of} a JOIN {of} b ON {near} WHERE b.label > 0 GROUP BY 1, 2) n USING (x, y))"
)


@query("detect_grow", _LABELS + ", " + _STEP.format(to="g1", of="l", near=_N8) + ", " + _STEP.format(to="g2", of="g1", near=_N8) + " SELECT x, y, label FROM g2")
def detect_grow(spark, sf_dir):
    return detect.grow(image(spark, sf_dir), grid.connected_components(mask(spark, sf_dir), 2), 350.0, 2)


def _flooded(spark, sf_dir):
    labels = grid.connected_components(mask(spark, sf_dir), 2)
    return watershed.watershed(labels.join(image(spark, sf_dir), ["x", "y"]))


@query("segment_watershed")
def segment_watershed(spark, sf_dir):
    return _flooded(spark, sf_dir)


@query("segment_clump_significance")
def segment_clump_significance(spark, sf_dir):
    return detect.clump_significance(_flooded(spark, sf_dir), 50.0)


@query("segment_clump_pairs")
def segment_clump_pairs(spark, sf_dir):
    return detect.clump_pairs(_flooded(spark, sf_dir), 2500.0, 1)


@query("crop_catalogue", f"SELECT c.id, m.x, m.y, round(m.v, 6) AS v FROM ({IMAGE}) m JOIN (VALUES (1, 5, 5), (2, 20, 25), (3, 12, 15)) c(id, cx, cy) ON m.x BETWEEN cx - 2 AND cx + 2 AND m.y BETWEEN cy - 2 AND cy + 2")
def crop_catalogue(spark, sf_dir):
    centres = spark.createDataFrame([(1, 5.0, 5.0), (2, 20.0, 25.0), (3, 12.0, 15.0)], "id int, cx double, cy double")
    return _r(gen.crop_catalogue(image(spark, sf_dir), centres, 5))


@query("convert_change_truncate", f"SELECT x, y, round(CASE WHEN v < 300 THEN 300 WHEN v > 500 THEN 500 ELSE v END, 6) AS v FROM ({IMAGE})")
def convert_change_truncate(spark, sf_dir):
    i = image(spark, sf_dir)
    return _r(i.withColumn("v", gen.change_values(F.col("v"), [(-1.0, 0.0)], 300.0, 500.0)))


@query("convert_to_byte", f"WITH m AS ({HOLED}), e AS (SELECT min(v) AS lo, max(v) AS hi FROM m) SELECT x, y, CAST(coalesce(trunc((v - lo) * 255 / (hi - lo)), 0) AS INTEGER) AS v FROM m, e")
def convert_to_byte(spark, sf_dir):
    return gen.to_byte(holed(spark, sf_dir))


@query("warp_scale_half", f"SELECT CAST((x-1)//2 + 1 AS INTEGER) AS x, CAST((y-1)//2 + 1 AS INTEGER) AS y, CASE WHEN count(v) = 4 THEN round(sum(v), 6) END AS v FROM ({IMAGE}) GROUP BY 1, 2")
def warp_scale_half(spark, sf_dir):
    # brightness is kept: an output cell holds the sum of the cells it covers
    out = gen.warp_scale(image(spark, sf_dir), 0.5, 0.5)
    return _r(out)


_LINE = f"SELECT x, sum(v) AS v FROM ({IMAGE}) GROUP BY x"


@query("convolve_1d", f"SELECT x, round((coalesce(lag(v) OVER (ORDER BY x), 0) + 2*v + coalesce(lead(v) OVER (ORDER BY x), 0)) / (2 + CASE WHEN lag(v) OVER (ORDER BY x) IS NULL THEN 0 ELSE 1 END + CASE WHEN lead(v) OVER (ORDER BY x) IS NULL THEN 0 ELSE 1 END), 4) AS v FROM ({_LINE})")
def convolve_1d(spark, sf_dir):
    line = grid.collapse(image(spark, sf_dir), "y", "sum")
    return _r(grid.convolve(line, {(-1,): 1.0, (0,): 2.0, (1,): 1.0}, ("x",)), 4)


@query("grid_smooth_tiles", f"WITH t AS (SELECT (x-1)//6 AS x, (y-1)//5 AS y, avg(v) AS v FROM ({IMAGE}) GROUP BY 1, 2) SELECT CAST(a.x AS BIGINT) AS x, CAST(a.y AS BIGINT) AS y, round(avg(b.v), 6) AS v FROM t a JOIN t b ON greatest(abs(a.x-b.x), abs(a.y-b.y)) <= 1 GROUP BY a.x, a.y")
def grid_smooth_tiles(spark, sf_dir):
    tiles = grid.tile_statistics(image(spark, sf_dir), [6, 5], [F.avg("v").alias("v")]).withColumnsRenamed({"tx": "x", "ty": "y"})
    return _r(grid.moving_filter(tiles, [3, 3], "mean"))


@query("grid_mask_unset", f"SELECT x, y, CAST(count(*) AS BIGINT) AS near FROM (SELECT a.x, a.y FROM ({MASK}) a JOIN ({MASK}) b ON {_N8} WHERE a.v = 1 AND b.v = 0) GROUP BY x, y")
def grid_mask_unset(spark, sf_dir):
    """How many unset cells touch each set one."""
    m = mask(spark, sf_dir)
    seen = grid.send(m.where("v = 0"), grid.offsets(2, 2)).join(m.where("v = 1").select("x", "y"), ["x", "y"], "left_semi")
    return seen.groupBy("x", "y").agg(F.count("*").alias("near"))


@query("warp_general_scale", f"SELECT CAST((x-1)//2 + 1 AS INTEGER) AS x, CAST((y-1)//3 + 1 AS INTEGER) AS y, CASE WHEN count(v) = 6 THEN round(sum(v), 6) END AS v FROM ({IMAGE}) GROUP BY 1, 2")
def warp_general_scale(spark, sf_dir):
    return _r(gen.warp(image(spark, sf_dir), [("scale", 0.5, 1 / 3)]))


@query("warp_rotate", f"SELECT CAST(1 - y AS INTEGER) AS x, x AS y, round(v, 6) AS v FROM ({IMAGE})")
def warp_rotate(spark, sf_dir):
    """A quarter turn maps cells on cells."""
    return _r(gen.warp(image(spark, sf_dir), [("matrix", [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])]))


@query("warp_project")
def warp_project(spark, sf_dir):
    return gen.warp(image(spark, sf_dir), [("rotate", 20), ("shear", 0.1, 0.0), ("translate", 3.0, 2.0), ("project", 0.001, 0.0)], covered=0.9)
