"""Plain-text tables with metadata in comments.

A header line reads ``# Column N: NAME [UNIT, TYPE, BLANK] COMMENT``; all but the number may be missing.
Numbers are separated by white space or commas; a text column ``strW`` takes W characters from its first.
What is not declared is a float64.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import INTEGER_TYPES
from ..plans.lineage import shared_dir
from ..plans.table import positions

# Short and long names of types.
SHORT = {"u8": "uint8", "i8": "int8", "u16": "uint16", "i16": "int16", "u32": "uint32", "i32": "int32", "u64": "uint64", "i64": "int64", "f32": "float32", "f64": "float64", "float": "float32", "double": "float64"}
_LINE = re.compile(r"^#\s*Column\s+(\d+)\s*:\s*([^\[]*?)\s*(?:\[(.*?)\]\s*(.*?))?\s*$", re.I)


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str = "float64"
    width: int = 0
    unit: str = ""
    blank: str = ""
    comment: str = ""

    @property
    def spark_type(self) -> str:
        if self.type == "str":
            return "string"
        return {"float32": "float", "float64": "double"}.get(self.type) or INTEGER_TYPES[self.type][2]


def parse_header(lines: list[str]) -> dict[int, ColumnInfo]:
    """Column number -> what the header says of it; lines that don't fit are ignored."""
    out: dict[int, ColumnInfo] = {}
    for line in lines:
        m = _LINE.match(line)
        if not m:
            continue
        parts = [p.strip() for p in (m[3] or "").split(",", 2)] + ["", "", ""]
        kind, width = parts[1].lower(), 0
        text = re.fullmatch(r"str(?:ing)?(\d+)", kind)
        if text:
            kind, width = "str", int(text[1])
        kind = SHORT.get(kind, kind)
        if kind not in ("str", "float32", "float64", *INTEGER_TYPES) or (kind == "str" and not width):
            if parts[1]:
                continue
            kind = "float64"
        out[int(m[1])] = ColumnInfo(m[2].strip(), kind, width, parts[0], parts[2], (m[4] or "").strip())
    return out


def _is_blank(token: Column, info: ColumnInfo) -> Column:
    if info.type == "str":
        return token == info.blank if info.blank else token == ""
    number = token.try_cast("double")
    wrong = number.isNull() | F.isnan(number)
    return wrong | (number == float(info.blank)) if info.blank and re.fullmatch(r"[+-]?[\d.]+(e[+-]?\d+)?", info.blank, re.I) else wrong


#: A header lies within so many lines.
HEADER_LINES = 10_000


def head(spark: SparkSession, path: str) -> list[str]:
    """The first lines of the first file, by name, that isn't empty; Spark reads no more of it than it must."""
    names = spark.read.format("binaryFile").load(path).where("length > 0").agg(F.min("path")).head()
    return [] if names is None or names[0] is None else [r[0] for r in spark.read.text(names[0]).limit(HEADER_LINES).collect()]


def read_text_table(spark: SparkSession, path: str, columns: int | None = None, header: list[str] | None = None) -> DataFrame:
    """The table at ``path``.  Only the ``HEADER_LINES`` first lines of its first file that isn't empty, of which the
    comments are the header, and one data line to count columns come to the driver; the former only without ``header``."""
    lines = spark.read.text(path)
    info = parse_header([line for line in (head(spark, path) if header is None else header) if line.startswith("#")])
    data = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    if columns is None:
        first = data.head()
        columns = max([len(re.split(r"[\s,]+", first[0].strip(" ,\t")))] if first and not any(i.type == "str" for i in info.values()) else [0], default=0)
        columns = max(columns, *info, 0) if info else columns
    cols = [info.get(k, ColumnInfo(f"COLUMN_{k}")) for k in range(1, columns + 1)]
    pattern = "^" + "".join(rf"[\s,]*([^\s,].{{0,{c.width - 1}}})" if c.type == "str" else r"[\s,]*([^\s,]+)" for c in cols)
    out = []
    for k, c in enumerate(cols, 1):
        token = F.rtrim(F.regexp_extract("value", pattern, k))
        value = token if c.type == "str" else token.try_cast("double").cast(c.spark_type) if c.type.startswith("float") else token.try_cast("decimal(20,0)").try_cast(c.spark_type)
        out.append(F.when(~_is_blank(token, c), value).alias(c.name or f"COLUMN_{k}", metadata={"unit": c.unit, "comment": c.comment, "blank": c.blank, "type": c.type + (str(c.width) if c.width else "")}))
    return data.select(*out)


def _declared(f: T.StructField, width: int) -> str:
    kind = {"byte": "i8", "short": "i16", "integer": "i32", "long": "i64", "float": "f32", "double": "f64"}.get(f.dataType.typeName())
    return kind or f"str{max(width, 1)}"


def write_text_table(df: DataFrame, path: str, text_width: int = 32, blank_text: str = "n/a") -> None:
    """``df`` as a text table: the header is the first part, rows follow in parallel parts.

    Text columns are as wide as their longest value, at least ``text_width``; line breaks within a value
    can't be told from rows and become spaces.
    """
    plain = [f for f in df.schema.fields if not _declared(f, 1).startswith("str")]
    texts = [f.name for f in df.schema.fields if f not in plain]
    value = lambda n: F.regexp_replace(F.col(f"`{n}`").cast("string"), r"[\r\n]", " ")
    longest = df.agg(*[F.max(F.length(value(n))).alias(n) for n in texts]).head() if texts else {}
    header, cells = [], []
    for k, f in enumerate(df.schema.fields, 1):
        text = f.name in texts
        width = max(text_width, len(blank_text), longest[f.name] or 0) if text else 0
        blank = blank_text if text else "nan"
        header.append(f"# Column {k}: {f.name} [{f.metadata.get('unit', '')},{_declared(f, width)},{blank}] {f.metadata.get('comment', '')}".rstrip())
        c = F.coalesce(value(f.name) if text else F.col(f"`{f.name}`").cast("string"), F.lit(blank))
        cells.append(F.rpad(c, width, " ") if text else F.lpad(c, F.greatest(F.length(c), F.lit(24)), F.lit(" ")))
    spark = df.sparkSession
    top = spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1)
    top.union(df.select(F.concat_ws(" ", *cells).alias("value"))).write.text(path)


def read_text_image(spark: SparkSession, path: str, blank: str = "") -> DataFrame:
    """(x, y, v) of a text file with a row of numbers a line; comments and empty lines aren't rows; nan and ``blank`` are NULL."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    rows = positions(lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")), ["_file", "_block", "_line"])
    cells = rows.select(F.col("_at").cast("int").alias("y"), F.posexplode(F.split(F.trim("value"), r"[\s,]+")).alias("_k", "_token"))
    number = F.when(F.col("_token") != blank, F.col("_token").try_cast("double"))
    return cells.select((F.col("_k") + 1).alias("x"), "y", F.when(~F.isnan(number), number).alias("v"))


def read_stream(spark: SparkSession, stream: Iterable[str], chunk: int = 100_000, **options) -> DataFrame:
    """A text table from an open stream, such as standard input; it is written to the shared folder a chunk at a time."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    lines, header = iter(stream), []
    for k in itertools.count():
        part = [(x.rstrip("\n"),) for x in itertools.islice(lines, chunk)]
        header += [x for (x,) in part if x.startswith("#")][: HEADER_LINES - len(header)]
        if part or not k:
            spark.createDataFrame(part, "value string").coalesce(1).write.mode("append").text(path)
        if len(part) < chunk:
            return read_text_table(spark, path, header=header, **options)
