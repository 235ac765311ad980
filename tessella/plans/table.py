"""The table pipeline, in its fixed order: selection, sort, head or tail, column arithmetic, columns of
other tables, column metadata, removal of blanks.  Selection and sort see the input's columns, what
follows sees the output's."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rpn, sky
from ..operators import select
from .lineage import cut


@dataclass
class TablePipeline:
    """Options of one run; ``run`` gives the plan."""

    columns: Sequence[str] = ()
    ranges: Sequence[tuple[str, float, float]] = ()
    equal: Sequence[tuple] = ()
    notequal: Sequence[tuple] = ()
    inpolygon: tuple[str, str, list[tuple[float, float]]] | None = None
    outpolygon: tuple[str, str, list[tuple[float, float]]] | None = None
    sort: str | None = None
    descending: bool = False
    ties: Sequence[str] = ()
    head: int | None = None
    tail: int | None = None
    concat: Sequence[tuple[DataFrame, Sequence[str]]] = ()
    concat_key: str | None = None
    rawname: bool = False
    metadata: Sequence[tuple[str, str, str, str]] = ()
    noblank: Sequence[str] = ()
    wcs: sky.TangentPlane | None = None
    searchin: str = "name"
    ignorecase: bool = False
    extra: dict = field(default_factory=dict)

    def _one(self, df: DataFrame, asked: str) -> str:
        return select.resolve(df, asked, self.searchin, self.ignorecase)[0]

    def criteria(self, df: DataFrame) -> list[Column]:
        at = lambda asked: F.col(f"`{self._one(df, asked)}`")
        out = [select.in_range(at(c), a, b) for c, a, b in self.ranges]
        out += [select.equal(at(c), *v) for c, *v in self.equal]
        out += [select.not_equal(at(c), *v) for c, *v in self.notequal]
        if self.inpolygon:
            out.append(select.in_polygon(at(self.inpolygon[0]), at(self.inpolygon[1]), self.inpolygon[2]))
        if self.outpolygon:
            out.append(select.out_polygon(at(self.outpolygon[0]), at(self.outpolygon[1]), self.outpolygon[2]))
        return out

    def _order(self, df: DataFrame, backwards: bool = False) -> list[Column]:
        names = [self._one(df, self.sort)] if self.sort else []
        if names and isinstance(df.schema[names[0]].dataType, T.StringType):
            raise ValueError("tables are sorted by a number")
        down = self.descending != backwards
        first = [F.col(f"`{n}`").desc_nulls_first() if down and backwards else F.col(f"`{n}`").desc_nulls_last() if down else F.col(f"`{n}`").asc_nulls_first() if backwards else F.col(f"`{n}`").asc_nulls_last() for n in names]
        rest = [F.col(f"`{self._one(df, n)}`") for n in self.ties]
        return first + [c.desc() if backwards else c.asc() for c in rest]

    def run(self, df: DataFrame) -> DataFrame:
        df = select.keep(df, *self.criteria(df))
        if self.sort or self.ties:
            df = df.orderBy(*self._order(df))
        if self.head is not None:
            df = df.limit(self.head)
        elif self.tail is not None:
            df = df.orderBy(*self._order(df, True)).limit(self.tail).orderBy(*self._order(df))
        df = self._project(df)
        for k, (other, asked) in enumerate(self.concat, 1):
            df = zip_columns(df, other, asked, self.concat_key, "" if self.rawname else f"-{k}")
        for asked, name, unit, comment in self.metadata:
            df = set_metadata(df, self._one(df, asked), name, unit, comment)
        return select.no_blank(df, *self.noblank) if self.noblank else df

    def _project(self, df: DataFrame) -> DataFrame:
        if not self.columns:
            return df
        out: list[Column] = []
        made = 0
        for asked in self.columns:
            if asked.startswith("arith "):
                for c in rpn.evaluate(df, asked[6:], self.wcs):
                    made += 1
                    out.append(c.alias(f"ARITH_{made}"))
            else:
                out += [F.col(f"`{n}`") for part in asked.split(",") for n in select.resolve(df, part, self.searchin, self.ignorecase)]
        return df.select(*out)


def positions(df: DataFrame, key: str | Sequence[str] | None) -> DataFrame:
    """Adds ``_at``: the position of each row, from 1, by ``key``, or by the order of the plan's rows.

    Rows are numbered within ranges of the key and the ranges' sizes added up, so no task sees all rows.
    Rows of equal keys are dealt out by their hash, which also orders them.
    """
    if key is None:
        df, keys = df.withColumn("_row", F.monotonically_increasing_id()), ["_row"]
    else:
        keys = [key] if isinstance(key, str) else list(key)
    order = [F.col(f"`{k}`") for k in keys] + [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    # The ranges are drawn once: they would differ between two readings of the plan.
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = dealt.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.col("_k")).drop("_part", "_before", "_k", "_row")  # one row a partition


def zip_columns(left: DataFrame, right: DataFrame, asked: Iterable[str] = (), key: str | None = None, suffix: str = "-1") -> DataFrame:
    """Columns of ``right`` beside those of ``left``, row by row in the order of ``key``."""
    names = [n for a in asked for n in select.resolve(right, a)] or list(right.columns)
    a, b = positions(left, key), positions(right, key)
    renamed = b.select("_at", *[F.col(f"`{n}`").alias(n + suffix) for n in names])
    return a.join(renamed, "_at").drop("_at")


def set_metadata(df: DataFrame, name: str, new: str = "", unit: str = "", comment: str = "") -> DataFrame:
    """Rename a column and set its unit and comment."""
    about = {**df.schema[name].metadata, **({"unit": unit} if unit else {}), **({"comment": comment} if comment else {})}
    return df.withMetadata(name, about).withColumnRenamed(name, new or name)


def information(df: DataFrame) -> DataFrame:
    """Number, name, type, unit and comment of each column."""
    rows = [(k, f.name, f.dataType.simpleString(), f.metadata.get("unit", ""), f.metadata.get("comment", "")) for k, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "column int, name string, type string, unit string, comment string")
