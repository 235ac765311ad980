"""Single values, ranks, sigma clipping, the mode, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as st
from .registry import query, table


@query(
    "stat_single_values",
    "SELECT l_returnflag, count(l_extendedprice) AS number, min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum, round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 4) AS mean,"
    " round(stddev_pop(l_extendedprice), 4) AS std, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY l_returnflag",
)
def stat_single_values(spark, sf_dir):
    out = st.summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.withColumns({"sum": F.round("sum", 2), "mean": F.round("mean", 4), "std": F.round("std", 4), "median": F.round("median", 4)})


@query("stat_range_refcol", "SELECT count(*) AS number, round(avg(l_extendedprice), 4) AS mean FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40")
def stat_range_refcol(spark, sf_dir):
    d = st.within(table(spark, sf_dir, "lineitem"), 10, 40, ref="l_quantity")
    return d.agg(F.count("*").alias("number"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


_RANK = "SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem"


@query("stat_quantile", f"SELECT q, v AS value FROM ({_RANK}) JOIN (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) t(q) ON k = ceil((n - 1) * q - 0.5)")
def stat_quantile(spark, sf_dir):
    return st.quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.1, 0.25, 0.5, 0.9])


@query(
    "stat_quantile_function",
    "WITH a AS (SELECT count(*) AS n, count(*) FILTER (v <= 30000) AS below, max(v) FILTER (v <= 30000) AS prev, min(v) FILTER (v > 30000) AS nxt FROM (SELECT l_extendedprice AS v FROM lineitem))"
    " SELECT CAST(30000 AS DOUBLE) AS value, round((CASE WHEN nxt - 30000 <= 30000 - prev THEN below ELSE below - 1 END) / (n - 1), 9) AS quantile FROM a",
)
def stat_quantile_function(spark, sf_dir):
    return st.quantile_function(table(spark, sf_dir, "lineitem"), "l_extendedprice", 30000.0).withColumn("quantile", F.round("quantile", 9))


@query(
    "stat_quantile_range",
    f"SELECT count(*) AS number, round(avg(v), 4) AS mean FROM ({_RANK}) WHERE v >= (SELECT v FROM ({_RANK}) WHERE k = ceil((n-1)*0.2 - 0.5)) AND v < (SELECT v FROM ({_RANK}) WHERE k = ceil((n-1)*CAST(0.8 AS DOUBLE) - 0.5))",
)
def stat_quantile_range(spark, sf_dir):
    d = st.quantile_range(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.2, 0.8)
    return d.agg(F.count("*").alias("number"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


_ROUND = "SELECT k, count(v) AS size, median(v) AS med, avg(v) AS mean, stddev_pop(v) AS std FROM {} GROUP BY k"


@query(
    "stat_sigma_clip_rounds",
    "WITH r0 AS (SELECT l_shipmode_ AS k, l_extendedprice AS v FROM (SELECT l_returnflag AS l_shipmode_, l_extendedprice FROM lineitem)), s0 AS (" + _ROUND.format("r0") + "),"
    " r1 AS (SELECT r0.* FROM r0 JOIN s0 USING (k) WHERE v > med - 1.5 * std AND v < med + 1.5 * std), s1 AS (" + _ROUND.format("r1") + "),"
    " r2 AS (SELECT r1.* FROM r1 JOIN s1 USING (k) WHERE v > med - 1.5 * std AND v < med + 1.5 * std), s2 AS (" + _ROUND.format("r2") + "),"
    " r3 AS (SELECT r2.* FROM r2 JOIN s2 USING (k) WHERE v > med - 1.5 * std AND v < med + 1.5 * std)"
    " SELECT s2.k AS l_returnflag, (SELECT count(*) FROM r3 WHERE r3.k = s2.k) AS number, round(med, 4) AS median, round(mean, 4) AS mean, round(std, 4) AS std FROM s2",
)
def stat_sigma_clip_rounds(spark, sf_dir):
    out = st.sigma_clip(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 1.5, 3, crowded=True)
    return out.withColumns({c: F.round(c, 4) for c in ("median", "mean", "std")})


@query("stat_sigma_clip_tolerance")
def stat_sigma_clip_tolerance(spark, sf_dir):
    return st.sigma_clip(table(spark, sf_dir, "events"), ["event_type"], "value", 3.0, 0.2, crowded=True)


@query("stat_mode")
def stat_mode(spark, sf_dir):
    return st.mode(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


_EDGES = "SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 50 AS w FROM lineitem"
_HIST = f"SELECT t.bin, lo + t.bin * w + w / 2 AS center, coalesce(c, 0) AS number FROM (SELECT * FROM range(50) r(bin)) t CROSS JOIN ({_EDGES}) e LEFT JOIN (SELECT least(CAST(floor((l_extendedprice - lo) / w) AS BIGINT), 49) AS bin, count(*) AS c FROM lineitem, ({_EDGES}) GROUP BY 1) h ON h.bin = t.bin"


@query("stat_histogram", f"SELECT CAST(bin AS BIGINT) AS bin, round(center, 4) AS center, CAST(number AS BIGINT) AS number FROM ({_HIST})")
def stat_histogram(spark, sf_dir):
    return st.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50).withColumn("center", F.round("center", 4))


@query("stat_histogram_normalized", f"SELECT CAST(bin AS BIGINT) AS bin, round(number / sum(number) OVER (), 9) AS number FROM ({_HIST})")
def stat_histogram_normalized(spark, sf_dir):
    return st.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50, normalize=True).select("bin", F.round("number", 9).alias("number"))


@query("stat_histogram_maxbinone", f"SELECT CAST(bin AS BIGINT) AS bin, round(number / max(number) OVER (), 9) AS number FROM ({_HIST})")
def stat_histogram_maxbinone(spark, sf_dir):
    return st.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50, maxbinone=True).select("bin", F.round("number", 9).alias("number"))


@query("stat_cumulative", f"SELECT CAST(bin AS BIGINT) AS bin, CAST(sum(number) OVER (ORDER BY bin) AS BIGINT) AS number FROM ({_HIST})")
def stat_cumulative(spark, sf_dir):
    return st.cumulative(st.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50)).select("bin", "number")


@query(
    "stat_histogram_2d",
    "WITH e AS (SELECT min(l_quantity) AS ax, (max(l_quantity)-min(l_quantity))/10 AS wx, min(l_discount) AS ay, (max(l_discount)-min(l_discount))/5 AS wy FROM lineitem),"
    " h AS (SELECT least(CAST(floor((l_quantity-ax)/wx) AS BIGINT), 9) AS i, least(CAST(floor((l_discount-ay)/wy) AS BIGINT), 4) AS j, count(*) AS c FROM lineitem, e GROUP BY 1, 2)"
    " SELECT round(ax + i.range*wx + wx/2, 6) AS bin_dim1, round(ay + j.range*wy + wy/2, 6) AS bin_dim2, CAST(coalesce(c, 0) AS BIGINT) AS hist_number FROM range(10) i CROSS JOIN range(5) j CROSS JOIN e LEFT JOIN h ON h.i = i.range AND h.j = j.range",
)
def stat_histogram_2d(spark, sf_dir):
    out = st.histogram_2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", 10, 5)
    return out.withColumns({"bin_dim1": F.round("bin_dim1", 6), "bin_dim2": F.round("bin_dim2", 6)})


@query("stat_mirrored", "SELECT count(*) AS number, round(avg(v), 6) AS mean FROM (SELECT l_quantity AS v FROM lineitem WHERE l_quantity <= 20 UNION ALL SELECT 40 - l_quantity FROM lineitem WHERE l_quantity < 20)")
def stat_mirrored(spark, sf_dir):
    return st.mirrored(table(spark, sf_dir, "lineitem"), "l_quantity", 20.0).agg(F.count("*").alias("number"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("stat_unique", 'SELECT event_type, min(event_id) AS "first" FROM events GROUP BY event_type')
def stat_unique(spark, sf_dir):
    return st.unique(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("stat_outlier_distance")
def stat_outlier_distance(spark, sf_dir):
    return st.outlier_by_distance(table(spark, sf_dir, "events"), ["event_type"], "value", 50, 20.0)


@query("stat_outlier_flat")
def stat_outlier_flat(spark, sf_dir):
    return st.flat_outlier(table(spark, sf_dir, "events"), ["event_type"], "value", 50, 6.0, 3)


@query("stat_report")
def stat_report(spark, sf_dir):
    """The single values and the mode of one column."""
    return st.report(table(spark, sf_dir, "lineitem"), "l_extendedprice")


_DROPS = "SELECT min(d) AS lo, max(d) AS hi FROM (SELECT {v} - lag({v}) OVER (ORDER BY event_id) AS d FROM events)"


@query("stat_is_sorted", f"SELECT 'value' AS name, lo >= 0 AS increasing, hi <= 0 AS decreasing FROM ({_DROPS.format(v='value')}) UNION ALL SELECT 'time', lo >= 0, hi <= 0 FROM ({_DROPS.format(v='epoch(ts)')})")
def stat_is_sorted(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp").cast("double"))
    each = [st.is_sorted(e, c, "event_id").select(F.lit(n).alias("name"), "increasing", "decreasing") for n, c in (("value", "value"), ("time", "ts"))]
    return each[0].unionByName(each[1])


@query("stat_ascii_histogram")
def stat_ascii_histogram(spark, sf_dir):
    """The text plot, a row a line; only the bins reach the driver."""
    bins = st.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 60).orderBy("bin").collect()
    plot = st.ascii_plot([(r["center"], r["number"]) for r in bins]).split("\n")
    return spark.createDataFrame(list(enumerate(plot)), "line int, text string")
