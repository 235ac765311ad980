"""Readers and writers by the suffix of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fits
from .text_table import read_text_table, write_text_table


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("txt", "dat", "tbl"):
        return read_text_table(spark, path, **options)
    if suffix in ("parquet", "orc", "json"):
        return spark.read.options(**options).format(suffix).load(path)
    if suffix == "csv":
        return spark.read.csv(path, header=options.pop("header", True), **options)
    if suffix in ("jpg", "jpeg", "tif", "tiff", "png"):
        return spark.read.format("image" if suffix in ("jpg", "jpeg", "png") else "binaryFile").load(path)
    if suffix in ("fits", "fit", "fts"):
        return fits.read_table(spark, path, **options)
    raise ValueError(f"no reader for {path}")


def write(df: DataFrame, path: str, **options) -> None:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("txt", "dat", "tbl"):
        write_text_table(df, path, **options)
    elif suffix in ("fits", "fit", "fts"):
        fits.write_table(df, path, **options)
    elif suffix in ("parquet", "orc", "json", "csv"):
        df.write.options(**options).format(suffix).save(path)
    else:
        raise ValueError(f"no writer for {path}")
