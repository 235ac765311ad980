"""The measurement catalogue, over pixels made of lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sky import TangentPlane
from ..operators import catalog as ct
from .registry import ORACLES, QUERIES, clip_sql, query, table

#: Labels are suppliers, positions are line numbers and days of the month, values are prices about their middle.
PIXELS = (
    "SELECT l_suppkey + 1 AS label, l_linenumber AS x, CAST(day(l_shipdate) AS INTEGER) AS y, l_extendedprice - 30000.0 AS v, l_tax AS sky, l_discount AS std,"
    " CASE WHEN l_quantity >= 30 THEN CAST(l_linenumber AS INTEGER) ELSE 0 END AS clump FROM lineitem"
)


def pixels(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return d.select((F.col("l_suppkey") + 1).alias("label"), F.col("l_linenumber").alias("x"), F.dayofmonth("l_shipdate").alias("y"), (F.col("l_extendedprice") - 30000.0).alias("v"), F.col("l_tax").alias("sky"), F.col("l_discount").alias("std"), F.when(F.col("l_quantity") >= 30, F.col("l_linenumber")).otherwise(0).alias("clump"))


SETTINGS = ct.Settings(zeropoint=25.0, pixel_area=0.04, cpscorr=1.0, wcs=TangentPlane.scaled((4.0, 15.0), (180.0, 30.0), (-0.01, 0.01)))

_UP = "FILTER (v > 0)"
_W = {a: f"(sum(v*{a}) {_UP} / sum(v) {_UP})" for a in ("x", "y")}
_M = {"xx": f"(sum(v*x*x) {_UP}/sum(v) {_UP} - {_W['x']}*{_W['x']})", "yy": f"(sum(v*y*y) {_UP}/sum(v) {_UP} - {_W['y']}*{_W['y']})", "xy": f"(sum(v*x*y) {_UP}/sum(v) {_UP} - {_W['x']}*{_W['y']})"}
_G = {"xx": "(avg(x*x)-avg(x)*avg(x))", "yy": "(avg(y*y)-avg(y)*avg(y))", "xy": "(avg(x*y)-avg(x)*avg(y))"}


def _semi(m: dict, sign: str) -> str:
    return f"sqrt(greatest(({m['xx']}+{m['yy']})/2 {sign} sqrt(pow(({m['xx']}-{m['yy']})/2,2)+{m['xy']}*{m['xy']}), 0.0))"


_VAR = "sum(std*std + abs(v))"
#: column -> SQL over the pixels of a label; counts are whole, the rest is rounded
SQL: dict[str, str] = {
    "numclumps": "count(DISTINCT CASE WHEN clump > 0 THEN clump END)", "area": "count(v)", "geoarea": "count(*)", "weightarea": f"count(*) {_UP}", "clumpsarea": "count(v) FILTER (clump > 0)",
    "areaxy": "count(DISTINCT (x, y))", "geoareaxy": "count(DISTINCT (x, y))", "minx": "min(x)", "maxx": "max(x)", "miny": "min(y)", "maxy": "max(y)",
    "x": _W["x"], "y": _W["y"], "geox": "avg(x)", "geoy": "avg(y)", "clumpsx": "(sum(v*x) FILTER (v>0 AND clump>0) / sum(v) FILTER (v>0 AND clump>0))", "clumpsy": "(sum(v*y) FILTER (v>0 AND clump>0) / sum(v) FILTER (v>0 AND clump>0))",
    "clumpsgeox": "avg(x) FILTER (clump > 0)", "clumpsgeoy": "avg(y) FILTER (clump > 0)", "brightness": "sum(v)", "brightnesserr": f"sqrt({_VAR})", "clumpbrightness": "sum(v) FILTER (clump > 0)", "brightnessnoriver": "sum(v)",
    "mean": "sum(v)/count(v)", "median": "median(v)", "sky": "avg(sky)", "std": "sqrt(avg(std*std))", "magnitude": "CASE WHEN sum(v)>0 THEN -2.5*log10(abs(sum(v)))+25 END",
    "clumpsmagnitude": "CASE WHEN sum(v) FILTER (clump>0)>0 THEN -2.5*log10(abs(sum(v) FILTER (clump>0)))+25 END", "sn": f"sum(v)/sqrt({_VAR})", "magnitudeerr": f"CASE WHEN sum(v)>0 THEN 2.5/(sum(v)/sqrt({_VAR})*ln(10)) END",
    "areaarcsec2": "count(v)*CAST(0.04 AS DOUBLE)", "surfacebrightness": "CASE WHEN sum(v)>0 THEN -2.5*log10(abs(sum(v)))+25+2.5*log10(count(v)*0.04) END",
    "semimajor": _semi(_M, "+"), "semiminor": _semi(_M, "-"), "axisratio": f"{_semi(_M, '-')}/{_semi(_M, '+')}", "positionangle": f"degrees(0.5*atan2(2*{_M['xy']}, {_M['xx']}-{_M['yy']}))",
    "geosemimajor": _semi(_G, "+"), "geosemiminor": _semi(_G, "-"), "geoaxisratio": f"{_semi(_G, '-')}/{_semi(_G, '+')}", "geopositionangle": f"degrees(0.5*atan2(2*{_G['xy']}, {_G['xx']}-{_G['yy']}))",
}
WHOLE = {"numclumps", "area", "geoarea", "weightarea", "clumpsarea", "areaxy", "geoareaxy"}
SMALL = {"minx", "maxx", "miny", "maxy"}


def _register(name: str, sql: str) -> None:
    plain = name in WHOLE | SMALL

    def run(spark, sf_dir):
        out = ct.catalog(pixels(spark, sf_dir), [name], SETTINGS)
        return out.select(F.col("label").alias("objid"), (F.col(name) if plain else F.round(name, 4)).alias("result"))

    QUERIES[f"catalog_{name}"] = run
    value = f"CAST({sql} AS BIGINT)" if name in WHOLE else f"CAST({sql} AS INTEGER)" if name in SMALL else f"round({sql}, 4)"
    ORACLES[f"catalog_{name}"] = f"SELECT label AS objid, {value} AS result FROM ({PIXELS}) GROUP BY label"


for _name, _sql in SQL.items():
    _register(_name, _sql)

_ENDS = f"WITH p AS ({PIXELS}), e AS (SELECT label, min(v) AS lo, max(v) AS hi FROM p GROUP BY label)"


@query(
    "catalog_extremes",
    _ENDS + " SELECT p.label AS objid, round(avg(x) FILTER (v=lo), 6) AS minvx, round(avg(y) FILTER (v=lo), 6) AS minvy, round(avg(x) FILTER (v=hi), 6) AS maxvx, round(avg(y) FILTER (v=hi), 6) AS maxvy, count(*) FILTER (v=lo) AS areaminv, count(*) FILTER (v=hi) AS areamaxv FROM p JOIN e USING (label) GROUP BY p.label",
)
def catalog_extremes(spark, sf_dir):
    out = ct.catalog(pixels(spark, sf_dir), ["minvx", "minvy", "maxvx", "maxvy", "areaminv", "areamaxv"], SETTINGS).withColumnRenamed("label", "objid")
    return out.withColumns({c: F.round(c, 6) for c in ("minvx", "minvy", "maxvx", "maxvy")})


_ORDER = (
    f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v DESC, x, y) AS k, count(*) OVER (PARTITION BY label) AS n, sum(v) OVER (PARTITION BY label) AS total FROM ({PIXELS})),"
    " r AS (SELECT *, sum(v) OVER (PARTITION BY label ORDER BY k) AS run FROM p), t AS (SELECT label, CASE WHEN max(n) > 3 THEN avg(v) ELSE max(v) END AS top FROM p WHERE k <= 3 GROUP BY label)"
)
_AREA = "greatest(coalesce(min(k) FILTER (v < {f}*top) - 1, max(n)), 1)"
_SUM = "coalesce(sum(v) FILTER (v >= {f}*top), max(v))"


@query(
    "catalog_ordered",
    _ORDER + " SELECT label AS objid, round(max(top), 4) AS maximum, CAST(" + _AREA.format(f=0.5) + " AS BIGINT) AS halfmaxarea, round(" + _SUM.format(f=0.5) + ", 3) AS halfmaxsum,"
    " CAST(" + _AREA.format(f=0.25) + " AS BIGINT) AS fracmaxarea1, round(" + _SUM.format(f=0.25) + ", 3) AS fracmaxsum1, CAST(" + _AREA.format(f=0.75) + " AS BIGINT) AS fracmaxarea2, round(" + _SUM.format(f=0.75) + ", 3) AS fracmaxsum2,"
    " CAST(greatest(coalesce(min(k) FILTER (run > 0.5*total) - 1, max(n)), 1) AS BIGINT) AS halfsumarea FROM r JOIN t USING (label) GROUP BY label",
)
def catalog_ordered(spark, sf_dir):
    names = ["maximum", "halfmaxarea", "halfmaxsum", "fracmaxarea1", "fracmaxsum1", "fracmaxarea2", "fracmaxsum2", "halfsumarea"]
    out = ct.catalog(pixels(spark, sf_dir), names, SETTINGS).withColumnRenamed("label", "objid")
    return out.select("objid", *[F.round(c, 4).alias(c) if c == "maximum" else F.round(c, 3).alias(c) if "sum" in c and "area" not in c else F.col(c).cast("long").alias(c) for c in names])


_RATIO = f"({_semi(_M, '-')}/{_semi(_M, '+')})"
_AREAS = (
    _ORDER + ", a AS (SELECT label, " + _AREA.format(f=0.5) + " AS half, " + _SUM.format(f=0.5) + " AS half_sum, " + _AREA.format(f=0.25) + " AS f1, " + _AREA.format(f=0.75) + " AS f2,"
    " greatest(coalesce(min(k) FILTER (run > 0.5*total) - 1, max(n)), 1) AS half_total FROM r JOIN t USING (label) GROUP BY label),"
    f" m AS (SELECT label, sum(v) AS s, {_RATIO} AS q FROM ({PIXELS}) GROUP BY label)"
)
_RADIUS = "CASE WHEN q >= 1e-6 THEN sqrt({n} / (q * pi())) END"
_SB = "CASE WHEN {v} > 0 THEN -2.5*log10(abs({v})) + 25 + 2.5*log10({n}*0.04) END"


@query(
    "catalog_radii",
    _AREAS + f" SELECT label, round(2 * {_RADIUS.format(n='half')}, 4) AS fwhmobs, round({_RADIUS.format(n='half_total')}, 4) AS halfradiusobs, round({_RADIUS.format(n='f1')}, 4) AS fracmaxradius1,"
    f" round({_RADIUS.format(n='f2')}, 4) AS fracmaxradius2, round({_SB.format(v='half_sum', n='half')}, 4) AS halfmaxsb, round({_SB.format(v='(s / 2)', n='half_total')}, 4) AS halfsumsb FROM a JOIN m USING (label)",
)
def catalog_radii(spark, sf_dir):
    names = ["fwhmobs", "halfradiusobs", "fracmaxradius1", "fracmaxradius2", "halfmaxsb", "halfsumsb"]
    return ct.catalog(pixels(spark, sf_dir), names, SETTINGS).withColumns({c: F.round(c, 4) for c in names})


def _world_sql() -> str:
    """Centres of each kind on the tangent plane of SETTINGS."""
    (x0, y0), (ra0, dec0), ((a, _), (_, d)) = SETTINGS.wcs.crpix, SETTINGS.wcs.crval, SETTINGS.wcs.cd
    out = []
    for pre, x, y in (("", SQL["x"], SQL["y"]), ("geo", SQL["geox"], SQL["geoy"]), ("clumps", SQL["clumpsx"], SQL["clumpsy"]), ("clumpsgeo", SQL["clumpsgeox"], SQL["clumpsgeoy"])):
        xi, eta = f"radians(({x} - {x0!r}) * {a!r})", f"radians(({y} - {y0!r}) * {d!r})"
        below = f"(cos(radians({dec0!r})) - {eta} * sin(radians({dec0!r})))"
        ra = f"degrees(radians({ra0!r}) + atan2({xi}, {below}))"
        dec = f"degrees(atan2(sin(radians({dec0!r})) + {eta} * cos(radians({dec0!r})), sqrt({xi} * {xi} + {below} * {below})))"
        out += [f"round(({ra}) - 360 * floor(({ra}) / 360), 6) AS {pre}w1", f"round({dec}, 6) AS {pre}w2"]
        if not pre:
            out += [x.replace(" AS w1", " AS ra").replace(" AS w2", " AS dec") for x in out]
    return ", ".join(out)


@query("catalog_world", f"SELECT label, {_world_sql()} FROM ({PIXELS}) GROUP BY label")
def catalog_world(spark, sf_dir):
    """Centres on the sky: ra, dec, w1, w2, geow1, geow2, clumpsw1, clumpsw2, clumpsgeow1, clumpsgeow2."""
    names = ["ra", "dec", "w1", "w2", "geow1", "geow2", "clumpsw1", "clumpsw2", "clumpsgeow1", "clumpsgeow2"]
    return ct.catalog(pixels(spark, sf_dir), names, SETTINGS).withColumns({c: F.round(c, 6) for c in names})


@query("catalog_sigclip", clip_sql(f"SELECT label, v FROM ({PIXELS})", ["label"], 1.5, 2) + ' SELECT label, number AS "sigclip-number", round(median, 4) AS "sigclip-median", round(mean, 4) AS "sigclip-mean", round(std, 4) AS "sigclip-std" FROM clipped')
def catalog_sigclip(spark, sf_dir):
    names = ["sigclip-median", "sigclip-mean", "sigclip-std"]
    out = ct.catalog(pixels(spark, sf_dir), ["sigclip-number", *names], ct.Settings(sigmaclip=(1.5, 2)))
    return out.withColumns({c: F.round(F.col(f"`{c}`"), 4) for c in names})


#: Moves means of whole hundredths off the ties of rounding.
OFF = 1e-7
#: The same pixels, the faintest of each label as rivers between its clumps.
CLUMPED = PIXELS.replace("ELSE 0 END AS clump", "WHEN l_quantity < 15 THEN -1 ELSE 0 END AS clump")
_RIVERS = (
    f"WITH p AS ({CLUMPED}), d AS (SELECT i.range - 1 AS dx, j.range - 1 AS dy FROM range(3) i, range(3) j WHERE i.range <> 1 OR j.range <> 1),"
    " reach AS (SELECT DISTINCT label, clump, x + dx AS x, y + dy AS y FROM p, d WHERE clump > 0),"
    " rivers AS (SELECT r.label, r.clump, count(v) AS rivernum, avg(v) AS riverave, sum(std * std + abs(v)) AS rivervar FROM reach r JOIN p USING (label, x, y) WHERE p.clump < 0 GROUP BY 1, 2),"
    " own AS (SELECT label, clump, count(v) AS n, sum(v) AS s, sum(std * std + abs(v)) AS var FROM p WHERE clump > 0 GROUP BY 1, 2),"
    " net AS (SELECT *, s - coalesce(riverave, 0) * n AS b, sqrt(var + coalesce(rivervar, 0)) AS err FROM own LEFT JOIN rivers USING (label, clump))"
)


def _clumped(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 1).alias("label"), F.col("l_linenumber").alias("x"), F.dayofmonth("l_shipdate").alias("y"), (F.col("l_extendedprice") - 30000.0).alias("v"), F.col("l_tax").alias("sky"), F.col("l_discount").alias("std"), "l_quantity")
    return q.withColumn("clump", F.when(F.col("l_quantity") >= 30, F.col("x")).when(F.col("l_quantity") < 15, -1).otherwise(0)).drop("l_quantity")


@query(
    "catalog_clumps",
    _RIVERS + " SELECT label AS hostobjid, clump AS idinhostobj, n AS area, round(b + 1e-7, 3) AS brightness, round(s + 1e-7, 3) AS brightnessnoriver, round(b / n + 1e-7, 4) AS mean, round(err, 4) AS brightnesserr, round(b / err, 6) AS sn,"
    " round(CASE WHEN b > 0 THEN -2.5*log10(abs(b)) + 25 END, 6) AS magnitude, coalesce(rivernum, 0) AS rivernum, round(riverave + 1e-7, 4) AS riverave FROM net",
)
def catalog_clumps(spark, sf_dir):
    names = ["area", "brightness", "brightnessnoriver", "mean", "brightnesserr", "sn", "magnitude", "rivernum", "riverave"]
    out = ct.catalog(_clumped(spark, sf_dir), names, SETTINGS, keys=["label", "clump"])
    places = {"brightness": 3, "brightnessnoriver": 3, "mean": 4, "brightnesserr": 4, "sn": 6, "magnitude": 6, "riverave": 4}
    return out.withColumns({c: F.round(F.col(c) + (OFF if c in ("brightness", "brightnessnoriver", "mean", "riverave") else 0.0), k) for c, k in places.items()}).withColumnsRenamed({"label": "hostobjid", "clump": "idinhostobj"})


@query("catalog_rivers", _RIVERS + " SELECT label, clump, rivernum, round(riverave + 1e-7, 4) AS riverave FROM rivers")
def catalog_rivers(spark, sf_dir):
    """rivernum and riverave of each clump that has any river."""
    return ct.clump_rivers(_clumped(spark, sf_dir)).select("label", "clump", "rivernum", F.round(F.col("riverave") + OFF, 4).alias("riverave"))


@query("catalog_inbetween", f"SELECT CAST(range AS BIGINT) AS objid, CAST(area AS BIGINT) AS area FROM range(1, (SELECT max(label) + 1 FROM ({PIXELS}) WHERE label % 3 <> 0)) LEFT JOIN (SELECT label, count(v) AS area FROM ({PIXELS}) WHERE label % 3 <> 0 GROUP BY label) ON label = range")
def catalog_inbetween(spark, sf_dir):
    return ct.catalog(pixels(spark, sf_dir).where("label % 3 <> 0"), ["area"], SETTINGS, inbetween=True).select(F.col("label").alias("objid"), "area")


_3D = "SELECT l_suppkey + 1 AS label, l_linenumber AS x, CAST(day(l_shipdate) AS INTEGER) AS y, CAST(month(l_shipdate) AS INTEGER) AS z, l_extendedprice AS v FROM lineitem"


@query("catalog_3d", f"SELECT label AS objid, round(sum(v*z)/sum(v), 6) AS z, round(avg(z), 6) AS geoz, min(z) AS minz, max(z) AS maxz FROM ({_3D}) GROUP BY label")
def catalog_3d(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 1).alias("label"), F.col("l_linenumber").alias("x"), F.dayofmonth("l_shipdate").alias("y"), F.month("l_shipdate").alias("z"), F.col("l_extendedprice").alias("v"))
    out = ct.catalog(d, ["z", "geoz", "minz", "maxz"])
    return out.select(F.col("label").alias("objid"), F.round("z", 6).alias("z"), F.round("geoz", 6).alias("geoz"), "minz", "maxz")


@query("catalog_spectrum", f'SELECT label, z, round(sum(v), 3) AS "sum", count(v) AS number, count(*) AS geonumber FROM ({_3D}) GROUP BY label, z')
def catalog_spectrum(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 1).alias("label"), F.month("l_shipdate").alias("z"), F.col("l_extendedprice").alias("v"))
    return ct.spectrum(d).withColumn("sum", F.round("sum", 3))
