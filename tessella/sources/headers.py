"""Header records as a table (key, value, comment), and their edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delete(h: DataFrame, *keys: str) -> DataFrame:
    return h.where(~F.col("key").isin(*keys))


def rename(h: DataFrame, old: str, new: str) -> DataFrame:
    return h.withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key")))


def update(h: DataFrame, key: str, value: str, comment: str | None = None) -> DataFrame:
    """Changes a record, or adds it if there is none."""
    mine = F.col("key") == key
    out = h.withColumn("value", F.when(mine, value).otherwise(F.col("value")))
    if comment is not None:
        out = out.withColumn("comment", F.when(mine, comment).otherwise(F.col("comment")))
    new = h.sparkSession.createDataFrame([(key, value, comment or "")], "key string, value string, comment string")
    return out.unionByName(new.join(h.select("key"), "key", "left_anti"))


def write(h: DataFrame, key: str, value: str, comment: str = "") -> DataFrame:
    return h.unionByName(h.sparkSession.createDataFrame([(key, value, comment)], "key string, value string, comment string"))


def data_sum(df: DataFrame) -> DataFrame:
    """An order-independent checksum of a table's rows."""
    return df.agg(F.bit_xor(F.xxhash64(*df.columns)).alias("datasum"), F.count("*").alias("rows"))


#: Characters of a note that fit in one record.
NOTE = 70


def note(h: DataFrame, text: str, key: str = "HISTORY") -> DataFrame:
    """A history or comment, cut into as many records as it needs."""
    parts = [text[k : k + NOTE] for k in range(0, max(len(text), 1), NOTE)]
    return h.unionByName(h.sparkSession.createDataFrame([(key, p, "") for p in parts], "key string, value string, comment string"))


def date(h: DataFrame, when: str) -> DataFrame:
    """The record of the time of writing, an ISO date."""
    return update(h, "DATE", when, "written then")


def copy(h: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """The records of the given keys, taken from another header; those that it has replace one's own."""
    taken = other.where(F.col("key").isin(*keys)).select("key", "value", "comment")
    return h.join(taken.select("key"), "key", "left_anti").select("key", "value", "comment").unionByName(taken)


def verified(df: DataFrame, h: DataFrame) -> bool:
    """Whether a table's rows still have the sum that its header holds under DATASUM."""
    held = h.where(F.col("key") == "DATASUM").head()
    return held is not None and held["value"] == str(data_sum(df).head()["datasum"])
