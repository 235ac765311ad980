"""FITS files: headers, binary tables and images.

Files are listed by Spark and never read whole.  A task reads the headers of its files, skipping their data; rows
and pixels are then dealt out as ranges of about ``RANGE`` bytes, so one file of any size is read by many tasks, and
only the asked columns are decoded.  The driver sees only the header records it needs for the schema.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, CARD = 2880, 80

# TFORM letter -> (numpy type, Spark type).
FORMS = {"L": ("S1", "boolean"), "B": ("u1", "short"), "I": (">i2", "int"), "J": (">i4", "bigint"), "K": (">i8", "decimal(20,0)"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}
#: Spark type -> (TFORM letter, numpy type, TNULL).
SINK = {"byte": ("I", ">i2", -(1 << 15)), "short": ("I", ">i2", -(1 << 15)), "integer": ("J", ">i4", -(1 << 31)), "long": ("K", ">i8", -(1 << 63)), "float": ("E", ">f4", None), "double": ("D", ">f8", None), "boolean": ("L", "S1", None)}
PIXELS = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def _value(text: str) -> tuple[str, str]:
    """Value and comment of a card's text after ``= ``."""
    quoted = re.match(r"\s*'((?:[^']|'')*)'\s*(?:/\s*(.*))?", text)
    if quoted:
        return quoted[1].replace("''", "'").rstrip(), (quoted[2] or "").strip()
    value, _, comment = text.partition("/")
    return value.strip(), comment.strip()


def header_at(data: bytes, at: int) -> tuple[list[tuple[str, str, str]], int]:
    """Records of the header that begins at ``at``, and where its data begin."""
    records: list[tuple[str, str, str]] = []
    while at < len(data):
        block, at = data[at : at + BLOCK].decode("ascii", "replace"), at + BLOCK
        for k in range(0, len(block), CARD):
            card = block[k : k + CARD]
            key = card[:8].strip()
            if key == "END":
                return records, at
            if card[8:10] == "= ":
                records.append((key, *_value(card[10:])))
            elif key:
                records.append((key, card[8:].strip(), ""))
    return records, at


#: Bytes of rows or pixels that a task reads at a time.
RANGE = 32 << 20


def opened(path: str):
    """A file for reading by ranges, in any store that Arrow knows."""
    from pyarrow import fs

    path = re.sub("^file:/(?!/)", "file:///", path)
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def data_size(h: dict[str, str]) -> int:
    """Bytes of a unit's data, without the fill of its last block."""
    naxis = int(h.get("NAXIS", 0))
    size = abs(int(h.get("BITPIX", 8))) // 8 * math.prod(int(h.get(f"NAXIS{i}", 0)) for i in range(1, naxis + 1)) if naxis else 0
    return (size + int(h.get("PCOUNT", 0))) * int(h.get("GCOUNT", 1))


def units(f) -> Iterator[tuple[int, dict[str, str], list[tuple[str, str, str]], int, int]]:
    """(number, header, records, where the unit begins, where its data begin) of an open file's units; data are skipped."""
    at, k, end = 0, 0, f.size()
    while at + CARD <= end:
        data, blocks = b"", 0
        while True:
            block = f.read_at(BLOCK, at + blocks * BLOCK)
            data, blocks = data + block, blocks + 1
            if len(block) < BLOCK or any(block[c : c + 8] == b"END     " for c in range(0, len(block), CARD)):
                break
        records, length = header_at(data, 0)
        h = {key: v for key, v, _ in records}
        yield k, h, records, at, at + length
        at, k = at + length + -(-data_size(h) // BLOCK) * BLOCK, k + 1


def files(spark: SparkSession, path: str) -> DataFrame:
    """The paths of the files; their content isn't read."""
    return spark.read.format("binaryFile").load(path).select("path")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """path, hdu, place, key, value, comment of every record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                with opened(p) as f:
                    rows = [(p, k, i, *r) for k, _, records, *_ in units(f) for i, r in enumerate(records)]
                yield pd.DataFrame(rows, columns=["path", "hdu", "place", "key", "value", "comment"])

    return files(spark, path).mapInPandas(run, "path string, hdu int, place int, key string, value string, comment string")


def layout(spark: SparkSession, path: str, hdu: int) -> DataFrame:
    """path, start of the data and header (a map) of the files that have the unit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                with opened(p) as f:
                    rows = [(p, start, h) for k, h, _, _, start in units(f) if k == hdu]
                yield pd.DataFrame(rows, columns=["path", "start", "header"])

    return files(spark, path).mapInPandas(run, "path string, start long, header map<string,string>")


def ranges(found: DataFrame, width: Column, number: Column) -> DataFrame:
    """``found`` with first, n and width: ranges of its files' rows of ``width`` bytes each, dealt out evenly."""
    d = found.withColumn("width", width.cast("long")).withColumn("_n", number.cast("long")).where("_n > 0")
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGE) / F.greatest(F.col("width"), F.lit(1)))).cast("long")
    parts = d.withColumn("_step", step).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.col("_step"))))
    total = d.agg(F.sum(F.ceil(F.col("_n") / step))).head()[0] or 1
    return parts.select("path", "start", "header", "width", "first", F.least("_step", F.col("_n") - F.col("first")).alias("n")).repartition(int(total))


def _columns(h: dict[str, str]) -> list[tuple[str, str, int, float, float, str | None]]:
    """(name, form letter, repeat, scale, zero, null) of a table's columns."""
    out = []
    for k in range(1, int(h["TFIELDS"]) + 1):
        repeat, letter = re.match(r"(\d*)([A-Z])", h[f"TFORM{k}"]).groups()
        out.append((h.get(f"TTYPE{k}", f"COLUMN_{k}"), letter, int(repeat or 1), float(h.get(f"TSCAL{k}", 1)), float(h.get(f"TZERO{k}", 0)), h.get(f"TNULL{k}")))
    return out


def _decoded(data: bytes, n_rows: int, h: dict[str, str], asked: list[str]) -> pd.DataFrame:
    """The asked columns of some rows of a binary table."""
    cols = _columns(h)
    dtype = np.dtype([(f"c{k}", f"S{n}" if c == "A" else (FORMS[c][0], (n,)) if n > 1 else FORMS[c][0]) for k, (_, c, n, *_) in enumerate(cols)])
    rows = np.frombuffer(data, dtype, n_rows)
    out = {}
    for k, (name, c, n, scale, zero, null) in enumerate(cols):
        if name not in asked:
            continue
        v = rows[f"c{k}"]
        if c == "A":
            text = [x.decode("ascii", "replace").rstrip("\0 ") for x in v.tolist()]
            out[name] = pd.Series([t or None for t in text], dtype=object)
            continue
        if n > 1:
            out[name] = pd.Series([(x * scale + zero).astype(float).tolist() for x in v], dtype=object)
            continue
        if c == "L":
            out[name] = pd.Series([{b"T": True, b"F": False}.get(x) for x in v.tolist()], dtype=object)
            continue
        blank = v == int(null) if null is not None and c in "BIJK" else np.isnan(v) if c in "ED" else np.zeros(len(v), bool)
        exact = [int(x) + int(zero) for x in v.tolist()] if c in "BIJK" and scale == 1 else (v * scale + zero).astype(float).tolist()
        exact = map(Decimal, exact) if c == "K" and scale == 1 else exact
        out[name] = pd.Series([None if b else x for x, b in zip(exact, blank.tolist())], dtype=object)
    return pd.DataFrame(out, columns=asked)


#: Forms of text tables -> Spark type.
TEXT_FORMS = {"A": "string", "I": "bigint", "F": "double", "E": "double", "D": "double"}


def _text_columns(h: dict[str, str]) -> list[tuple[str, str, int, int, str | None]]:
    """(name, form letter, first character, width, null) of a text table's columns."""
    out = []
    for k in range(1, int(h["TFIELDS"]) + 1):
        letter, width = re.match(r"([AIFED])(\d+)", h[f"TFORM{k}"]).groups()
        out.append((h.get(f"TTYPE{k}", f"COLUMN_{k}"), letter, int(h[f"TBCOL{k}"]) - 1, int(width), h.get(f"TNULL{k}")))
    return out


def _decoded_text(data: bytes, n_rows: int, h: dict[str, str], asked: list[str]) -> pd.DataFrame:
    width = int(h["NAXIS1"])
    rows = [data[i * width : (i + 1) * width].decode("ascii", "replace") for i in range(n_rows)]
    out = {}
    for name, letter, at, w, null in _text_columns(h):
        if name not in asked:
            continue
        cells = [r[at : at + w].strip() for r in rows]
        number = int if letter == "I" else lambda x: float(x.replace("D", "E").replace("d", "e"))
        out[name] = pd.Series([None if c == "" or c == (null or "").strip() else c if letter == "A" else number(c) for c in cells], dtype=object)
    return pd.DataFrame(out, columns=asked)


def read_table(spark: SparkSession, path: str, hdu: int = 1, columns: Sequence[str] | None = None) -> DataFrame:
    """A binary or a text table, or only its named columns; blanks are NULL.  Files of one path have one schema."""
    found = layout(spark, path, hdu)
    one = found.agg(F.min_by("header", "path").alias("h")).head()
    h = (one and one["h"]) or {}
    if "TFIELDS" not in h:
        raise ValueError(f"unit {hdu} of {path} is no table")
    if h.get("XTENSION") == "TABLE":
        kinds = {name: TEXT_FORMS[letter] for name, letter, *_ in _text_columns(h)}
        decoded = _decoded_text
    else:
        kind = lambda c, n, scale: "array<double>" if n > 1 and c != "A" else "double" if scale != 1 and c in "BIJK" else FORMS[c][1]
        kinds = {name: kind(c, n, scale) for name, c, n, scale, *_ in _columns(h)}
        decoded = _decoded
    asked = list(kinds) if columns is None else list(columns)
    missing = [n for n in asked if n not in kinds]
    if missing:
        raise ValueError(f"unit {hdu} of {path} has no columns {missing}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                with opened(r["path"]) as f:
                    data = f.read_at(r["n"] * r["width"], r["start"] + r["first"] * r["width"])
                yield decoded(data, r["n"], dict(r["header"]), asked)

    rows = ranges(found, F.col("header")["NAXIS1"], F.col("header")["NAXIS2"])
    return rows.mapInPandas(run, ", ".join(f"`{n}` {kinds[n]}" for n in asked))


def read_image(spark: SparkSession, path: str, hdu: int = 0) -> DataFrame:
    """path, x, y[, z], v of every pixel, from 1; blanks are NULL."""
    found = layout(spark, path, hdu)
    naxis = found.agg(F.max(F.col("header")["NAXIS"].cast("int"))).head()[0] or 0
    axes = ["x", "y", "z"][:naxis]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                h = dict(r["header"])
                shape = [int(h[f"NAXIS{i}"]) for i in range(naxis, 0, -1)]
                with opened(r["path"]) as f:
                    data = f.read_at(r["n"] * r["width"], r["start"] + r["first"] * r["width"])
                raw = np.frombuffer(data, PIXELS[int(h["BITPIX"])])
                v = raw.astype(float) * float(h.get("BSCALE", 1)) + float(h.get("BZERO", 0))
                v = np.where(raw == int(h["BLANK"]), np.nan, v) if "BLANK" in h and int(h["BITPIX"]) > 0 else v
                index = np.unravel_index(r["first"] * shape[-1] + np.arange(len(v)), shape)
                # a band of a larger image says where it begins
                first = [1 - int(float(h.get(f"LTV{i + 1}", 0))) for i in range(naxis)]
                columns = {"path": r["path"], **{a: index[naxis - 1 - i] + first[i] for i, a in enumerate(axes)}, "v": pd.Series(v, dtype="Float64")}
                yield pd.DataFrame(columns).assign(v=lambda t: t["v"].astype(object).where(~np.isnan(v), None))

    at = lambda k: F.col("header")[k].cast("long")
    lines = F.lit(1)
    for i in range(2, naxis + 1):
        lines = lines * at(f"NAXIS{i}")
    rows = ranges(found, F.abs(at("BITPIX")) / 8 * at("NAXIS1"), lines if naxis else F.lit(0))
    return rows.mapInPandas(run, "path string, " + ", ".join(f"{a} int" for a in axes) + ", v double")


# sinks

#: Rows of a file at most; a task writes as many files as its rows need.
FILE_ROWS = 500_000


def card(key: str, value: object, comment: str = "") -> bytes:
    """A header record."""
    if isinstance(value, str):
        text = "'" + value.replace("'", "''").ljust(8) + "'"
        field = f"{text:<20}"
    else:
        field = f"{('T' if value else 'F') if isinstance(value, bool) else value:>20}"
    return (f"{key:<8}= {field}" + (f" / {comment}" if comment else "")).ljust(CARD)[:CARD].encode("ascii", "replace")


def padded(data: bytes, fill: bytes) -> bytes:
    return data + fill * (-len(data) % BLOCK)


def unit(cards: list[bytes], data: bytes = b"") -> bytes:
    """A header and its data, each filled up to whole blocks."""
    return padded(b"".join(cards) + b"END".ljust(CARD), b" ") + padded(data, b"\0")


def put(folder: str, name: str, data: bytes | Iterable[bytes]) -> None:
    """Write a file, whole or by parts, under another name and move it into place: a task that runs again writes the same file."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/_{name}.tmp") as out:
        for part in [data] if isinstance(data, bytes) else data:
            out.write(part)
    store.move(f"{root}/_{name}.tmp", f"{root}/{name}")


def _encoded(pdf: pd.DataFrame, fields: list[tuple[str, str, int]]) -> bytes:
    dtype = np.dtype([(f"c{k}", f"S{width}" if kind == "string" else SINK[kind][1]) for k, (_, kind, width) in enumerate(fields)])
    rows = np.zeros(len(pdf), dtype)
    for k, (name, kind, width) in enumerate(fields):
        c = pdf[name]
        if kind == "string":
            rows[f"c{k}"] = [b"" if v is None or v != v else str(v).encode("ascii", "replace")[:width] for v in c]
        elif kind == "boolean":
            rows[f"c{k}"] = [b"\0" if v is None or v != v else b"T" if v else b"F" for v in c]
        elif SINK[kind][2] is None:
            rows[f"c{k}"] = pd.to_numeric(c).to_numpy(float, na_value=np.nan)
        else:
            rows[f"c{k}"] = [SINK[kind][2] if v is None or v != v else int(v) for v in c]
    return rows.tobytes()


def write_table(df: DataFrame, folder: str) -> int:
    """``df`` as binary tables of one schema in a folder that all executors see, a file or more a partition; returns the rows.

    Blanks are NaN, the least integer or the empty text.  Texts are as wide as the longest one, in ASCII.
    """
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    longest = df.agg(*[F.max(F.length(F.col(f"`{n}`"))).alias(n) for n in texts]).head() if texts else {}
    fields = [(f.name, f.dataType.typeName(), max(longest[f.name] or 1, 1) if f.name in texts else 0) for f in df.schema.fields]
    wrong = [n for n, kind, _ in fields if kind != "string" and kind not in SINK]
    if wrong:
        raise ValueError(f"columns without a form in a binary table: {wrong}")
    width = sum(w if kind == "string" else np.dtype(SINK[kind][1]).itemsize for _, kind, w in fields)
    about = [(card(f"TTYPE{k}", n), card(f"TFORM{k}", f"{w}A" if kind == "string" else SINK[kind][0]), *([card(f"TNULL{k}", SINK[kind][2])] if kind in SINK and SINK[kind][2] is not None else [])) for k, (n, kind, w) in enumerate(fields, 1)]
    primary = unit([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", True)])

    def save(part: int, k: int, frames: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(frames)
        head = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", width), card("NAXIS2", len(pdf)), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(fields))]
        put(folder, f"part-{part:05d}-{k:03d}.fits", primary + unit([*head, *[c for cs in about for c in cs]], _encoded(pdf, fields)))
        return pd.DataFrame({"rows": [len(pdf)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k, frames = TaskContext.get().partitionId(), 0, []
        for b in batches:
            frames.append(b)
            if sum(map(len, frames)) >= FILE_ROWS:
                yield save(part, k, frames)
                k, frames = k + 1, []
        if frames or (part == 0 and k == 0):
            yield save(part, k, frames or [pd.DataFrame({n: [] for n, _, _ in fields})])

    return df.mapInPandas(run, "rows long").agg(F.sum("rows")).head()[0] or 0


def write_image(cells: DataFrame, folder: str, band: int = 1000) -> int:
    """(x, y, v) as images of ``band`` rows each, in double precision, in a folder that all executors see; returns the number of bands.

    Each band's header says where it begins, and ``read_image`` puts them together; blanks and cells that are
    missing are NaN.
    """
    nx = cells.agg(F.max("x")).head()[0] or 0
    ny = cells.agg(F.max("y")).head()[0] or 0

    def run(g: pd.DataFrame) -> pd.DataFrame:
        k = int(g["band"].iloc[0])
        rows = min(band, ny - k * band)
        v = np.full((rows, nx), np.nan)
        v[g["y"].to_numpy() - 1 - k * band, g["x"].to_numpy() - 1] = g["v"].to_numpy(float, na_value=np.nan)
        head = [card("SIMPLE", True), card("BITPIX", -64), card("NAXIS", 2), card("NAXIS1", nx), card("NAXIS2", rows), card("LTV2", float(-k * band))]
        put(folder, f"band-{k:05d}.fits", unit(head, v.astype(">f8").tobytes()))
        return pd.DataFrame({"band": [k]})

    d = cells.select(F.col("x").cast("int"), F.col("y").cast("int"), F.col("v").cast("double"), F.floor((F.col("y") - 1) / band).alias("band"))
    return d.groupBy("band").applyInPandas(run, "band long").count()


def unit_counts(spark: SparkSession, path: str) -> DataFrame:
    """path, units, and how many of them are images and tables."""
    h = headers(spark, path)
    kind = h.where((F.col("key") == "XTENSION") | (F.col("key") == "SIMPLE")).select("path", "hdu", F.col("value").endswith("TABLE").alias("table")).distinct()
    return kind.groupBy("path").agg(F.count("*").alias("units"), F.count(F.when(F.col("table"), 1)).alias("tables"), F.count(F.when(~F.col("table"), 1)).alias("images"))


def keep_units(spark: SparkSession, path: str, folder: str, keep: list[int]) -> int:
    """Copies of the files with only the given units; returns the number of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                with opened(p) as f:
                    found = [(at, start + -(-data_size(h) // BLOCK) * BLOCK) for _, h, _, at, start in units(f)]
                    spans = [found[k] for k in keep if k < len(found)]
                    put(folder, p.rsplit("/", 1)[-1], (f.read_at(min(RANGE, end - at), at) for begin, end in spans for at in range(begin, end, RANGE)))
                yield pd.DataFrame({"path": [p]})

    return files(spark, path).mapInPandas(run, "path string").count()
