"""Date texts, nights, and the filling of blanks along an ordered column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.along import fill_between
from ..plans.table import positions

# The accepted date formats.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yy'T'HH:mm:ss", "dd/MM/yy")


def to_seconds(text: Column) -> Column:
    """Seconds since 1970, the fraction of a second left aside; NULL if the text is no date."""
    whole = F.regexp_replace(text, r"\.\d+$", "")
    return F.unix_seconds(F.coalesce(*[F.try_to_timestamp(whole, F.lit(f)) for f in FORMATS]))


def sub_second(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\.\d+)$", 1), F.lit("")).cast("double"), F.lit(0.0))


def night_of(seconds: Column, hour: int = 11) -> Column:
    """The day on whose evening the night began that a time belongs to: before ``hour`` it is the day before."""
    return F.floor((seconds - hour * 3600) / 86400)


def nights(df: DataFrame, seconds: str, hour: int = 11, ties: Sequence[str] = ()) -> DataFrame:
    """Adds night, night_id, the night's place among those present, and exposure_id, the row's place within its
    night by time (and ``ties``).

    Rows are placed by ranges of time, and a night's first place is subtracted; only the distinct nights, of
    which there are as many as days, meet in one window.
    """
    named = df.withColumn("night", night_of(F.col(seconds), hour))
    by_night = W.orderBy("night")
    sizes = named.where(F.col("night").isNotNull()).groupBy("night").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(by_night.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ids = sizes.select("night", F.row_number().over(by_night).alias("night_id"), before.alias("_before"))
    placed = positions(named.where(F.col("night").isNotNull()), [seconds, *ties])
    return placed.join(ids, "night").withColumn("exposure_id", (F.col("_at") - F.col("_before")).cast("int")).drop("_at", "_before")


def fill_linear(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Blanks of ``y`` on the straight line between the nearest values before and after along ``x``, within groups."""
    return fill_between(df, x, y, by, lambda at, a, b: a["y"] + (at - a["x"]) * (b["y"] - a["y"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)))
