"""Sources, sinks, headers and the stream."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import functions as F

from ..plans.lineage import shared_dir
from ..sources import fits, headers, registry, text_table
from ..streaming.nights import nightly
from .grids import HOLED, holed
from .registry import query, table


@query("source_text_table", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def source_text_table(spark, sf_dir):
    """A text table written and read back."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.txt"
    registry.write(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return registry.read(spark, path)


@query("source_fits_table", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice FROM orders")
def source_fits_table(spark, sf_dir):
    """Binary tables written and read back."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.fits"
    registry.write(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice")), path)
    return registry.read(spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("source_fits_image", f"SELECT x, y, round(v, 6) AS v FROM ({HOLED})")
def source_fits_image(spark, sf_dir):
    """An image written in bands and read back; only the cells it had."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    cells = holed(spark, sf_dir)
    fits.write_image(cells, path, band=7)
    back = fits.read_image(spark, path).select("x", "y", F.round("v", 6).alias("v"))
    return back.join(cells.select("x", "y"), ["x", "y"], "left_semi")


@query("source_text_image", "SELECT CAST(k AS INTEGER) AS x, CAST(row_number() OVER (PARTITION BY k ORDER BY o_orderkey) AS INTEGER) AS y, CASE k WHEN 1 THEN o_totalprice ELSE CAST(o_custkey AS DOUBLE) END AS v FROM orders, (VALUES (1), (2)) t(k)")
def source_text_image(spark, sf_dir):
    """Rows of numbers as the rows of an image."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.concat_ws("  ", "o_totalprice", "o_custkey").alias("value")).write.text(path)
    return text_table.read_text_image(spark, path)


@query("source_stream", "SELECT CAST(r_regionkey AS DOUBLE) AS k, CAST(length(r_name) AS DOUBLE) AS n FROM region")
def source_stream(spark, sf_dir):
    """A table from an open stream of lines."""
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.length("r_name")).toLocalIterator()
    return text_table.read_stream(spark, itertools.chain(["# Column 1: k\n", "# Column 2: n\n"], (f"{a} {b}\n" for a, b in rows)), chunk=3)


def _records(spark, sf_dir, name, letter, key, value):
    """A header with a record for each row of a table."""
    return table(spark, sf_dir, name).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("key"), F.col(value).cast("string").alias("value"), F.lit("").alias("comment"))


@query("header_notes", "SELECT CASE WHEN p_partkey = 7 THEN 'S3' ELSE 'P' || p_partkey END AS key, CASE WHEN p_partkey = 7 THEN (SELECT s_name FROM supplier WHERE s_suppkey = 3) ELSE p_brand END AS value FROM part UNION ALL SELECT * FROM (VALUES ('DATE', '2024-01-01T00:00:00'), ('HISTORY', repeat('x', 70)), ('HISTORY', repeat('x', 30)), ('COMMENT', 'seen')) t(key, value)")
def header_notes(spark, sf_dir):
    """A record of one header in another's, the date, and notes longer than a record."""
    h = headers.delete(_records(spark, sf_dir, "part", "P", "p_partkey", "p_brand"), "P7")
    h = headers.copy(h, _records(spark, sf_dir, "supplier", "S", "s_suppkey", "s_name"), "S3")
    return headers.note(headers.note(headers.date(h, "2024-01-01T00:00:00"), "x" * 100), "seen", "COMMENT").select("key", "value")


@query("header_edit", "SELECT CASE p_partkey WHEN 4 THEN 'Q4' ELSE 'P' || p_partkey END AS key, CASE p_partkey WHEN 5 THEN 'seen' ELSE p_brand END AS value FROM part WHERE p_partkey <> 3 UNION ALL SELECT 'D', '4'")
def header_edit(spark, sf_dir):
    """A record deleted, one renamed, one changed and one added."""
    h = _records(spark, sf_dir, "part", "P", "p_partkey", "p_brand")
    h = headers.update(headers.rename(headers.delete(h, "P3"), "P4", "Q4"), "P5", "seen")
    return headers.write(h, "D", "4").select("key", "value")


@query("header_data_sum")
def header_data_sum(spark, sf_dir):
    return headers.data_sum(table(spark, sf_dir, "nation"))


@query("stream_nights", "SELECT CAST(floor((epoch(ts) - 32400) / 86400.0) AS BIGINT) AS night, count(*) AS number FROM events GROUP BY 1")
def stream_nights(spark, sf_dir):
    """The events as a stream, run to its end."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream reads a folder or a pattern of files
    stream = spark.readStream.schema(schema).parquet(path + "*" if path.endswith(".parquet") else path)
    name = f"nights_{uuid.uuid4().hex}"
    run = nightly(stream, hour=9).writeStream.outputMode("complete").format("memory").queryName(name).start()
    run.processAllAvailable()
    run.stop()
    return spark.table(name).select(F.floor((F.unix_seconds("night") - 32400) / 86400).alias("night"), "number")
