"""Fill-in-middle transformation with a learned rank index.

A text's units (code points, or words with the white space after them) begin at byte offsets that grow with
their rank.  The index learns that curve: it is a chain of straight segments, each as long as a line can stay
within ``ERROR`` bytes of every offset (the cone of admissible slopes from the segment's first point), and a
one-byte residual for each rank.  To cut at a rank, its segment predicts an offset and the rank's residual
corrects it, exactly.  The text itself stays bytes and is never decoded.

Cuts come from the SHA-256 of the seed and the document's id, so that reruns and other cluster sizes agree.
The middle of a document goes to its end, in one of two forms: psm (prefix, suffix, middle) and spm (suffix,
prefix, middle); plain documents stay as they are.  As no transformed text holds a mark, its three parts, and
so the text, can be told from the output (``restored``).

The index of a text is built by stretches of ``STRETCH`` bytes, so that a very long text costs its bytes and one
byte for each unit besides the stretch at hand.

Defined results: a null text is the empty text, which is plain; a text that holds a mark is plain; a null id is
hashed as an empty one; both cuts may fall together or at an end, which leaves parts empty; repeated rows get
the same cuts; an empty table gives no rows; other columns pass by untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, held, lean, pick, read_table, text_or_empty, with_text

ERROR = 32  # bytes between a segment and any of its offsets; residuals must fit in a byte
STRETCH = 1 << 20
FIRST_LOOK = 512  # points tried for a new segment; doubled as long as one line fits

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = "1"
PLAIN_FROM = 90  # per cent of texts that are transformed
SPM_BELOW = 20  # per cent of those in the form spm

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def starts_of(data: np.ndarray, before: int | None, units: str) -> np.ndarray:
    """Offsets in ``data`` at which a unit begins; ``before`` is the byte ahead of it, none at the start of a text."""
    if units == "chars":
        return np.flatnonzero((data & 0xC0) != 0x80)
    space = SPACE[data]
    ahead = np.empty_like(space)
    ahead[1:] = space[:-1]
    ahead[0] = True if before is None else SPACE[before]
    found = np.flatnonzero(ahead & ~space)
    if before is None and (not len(found) or found[0] > 0):
        found = np.concatenate([[0], found])  # white space at the start is a unit of its own
    return found


def fit(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rank, first offset, slope) of segments that stay within ``error`` of all ``offsets``.

    From a segment's first point every later one leaves a range of slopes; the segment ends before the point that
    leaves none.  The ranges are cut by running extremes, over ever more points.
    """
    first, base, slope = [], [], []
    at, n = 0, len(offsets)
    while at < n:
        look = FIRST_LOOK
        while True:
            rise = (offsets[at + 1 : at + look] - offsets[at]).astype(np.float64)
            run = np.arange(1, len(rise) + 1, dtype=np.float64)
            low, high = np.maximum.accumulate((rise - error) / run), np.minimum.accumulate((rise + error) / run)
            crossed = low > high
            ends = int(crossed.argmax()) if len(crossed) and crossed[-1] else len(rise)
            if ends < len(rise) or at + look >= n:
                break
            look *= 2
        first.append(at)
        base.append(int(offsets[at]))
        slope.append((low[ends - 1] + high[ends - 1]) / 2 if ends else 0.0)
        at += ends + 1
    return np.array(first, np.int64), np.array(base, np.int64), np.array(slope, np.float64)


class RankIndex:
    """The byte offset of every boundary of a text: ``offset(rank)`` for ranks 0 to ``n``."""

    def __init__(self, text: bytes, units: str = "chars", error: int = ERROR):
        firsts, bases, slopes, residuals, n = [], [], [], [], 0
        for at in range(0, len(text), STRETCH):
            data = np.frombuffer(text, np.uint8, min(STRETCH, len(text) - at), at)
            offsets = starts_of(data, text[at - 1] if at else None, units) + at
            if at + STRETCH >= len(text):
                offsets = np.append(offsets, len(text))
            if not len(offsets):
                continue
            first, base, slope = fit(offsets, error)
            held_by = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(offsets))))
            guess = self.line(base[held_by], slope[held_by], np.arange(len(offsets)) - first[held_by])
            firsts.append(first + n)
            bases.append(base)
            slopes.append(slope)
            residuals.append((offsets - guess).astype(np.int8))
            n += len(offsets)
        self.n = max(n - 1, 0)
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(1, kind)
        self.first, self.base, self.slope, self.residual = joined(firsts, np.int64), joined(bases, np.int64), joined(slopes, np.float64), joined(residuals, np.int8)

    @staticmethod
    def line(base, slope, run):
        return base + np.floor(slope * run + 0.5).astype(np.int64)

    def offset(self, rank: int) -> int:
        k = int(np.searchsorted(self.first, rank, "right")) - 1
        return int(self.line(self.base[k], self.slope[k], rank - self.first[k])) + int(self.residual[rank])


def plan(doc_id: object, text: bytes, units: str = "chars", seed: str = SEED) -> tuple[int, str, int | None, int | None, list[bytes]]:
    """(units, form, units of the prefix, units of the middle, [prefix, middle, suffix]) of a text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    index = RankIndex(text, units)
    n = index.n
    if not text or h[2] % 100 >= PLAIN_FROM or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, [text]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    left, right = index.offset(a), index.offset(b)
    return n, "spm" if h[3] % 100 < SPM_BELOW else "psm", a, b - a, [text[:left], text[left:right], text[right:]]


def output(form: str, parts: list[bytes]) -> bytes:
    """The parts of a text behind their marks, the middle last."""
    if form == "plain":
        return parts[0]
    prefix, middle, suffix = parts
    order = [PREFIX, prefix, SUFFIX, suffix] if form == "psm" else [SUFFIX, suffix, PREFIX, prefix]
    return b"".join([*order, MIDDLE, middle])


def restored(text: bytes, form: str) -> bytes:
    """The text from its output and form."""
    if form == "plain":
        return text
    head, middle = text.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX, 1)
    else:
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX, 1)
    return prefix + middle + suffix


def _run(docs: DataFrame, units: str, seed: str, fields: list[tuple[str, T.DataType, pa.DataType]], finish: Callable) -> DataFrame:
    """``row`` of ``docs`` (row, doc_id, text) beside what ``finish`` makes of each text's plan."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("row", F.col("doc_id").cast("string").alias("mark"), text_or_empty().cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [finish(*plan(mark.as_py(), data.as_py(), units, seed)) for mark, data in zip(batch.column(1), batch.column(2))]
            columns = [pa.array([m[k] for m in made], kind) for k, (_, _, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", *[f[0] for f in fields]])

    return rows.mapInArrow(lean(run), T.StructType([docs.schema["row"], *[T.StructField(name, kind) for name, kind, _ in fields]]))


LONG, TEXT = (T.LongType(), pa.int64()), (T.StringType(), pa.string())
SHAPE = [("n", *LONG), ("form", *TEXT), ("prefix_units", *LONG), ("middle_units", *LONG)]


def transform(docs: DataFrame, units: str = "chars", seed: str = SEED) -> DataFrame:
    """``docs`` with the transformed text in place of theirs, and its length in n_chars; columns as they were.

    ``units`` is "chars" or "words": what a cut never divides.
    """
    whole = held(docs, "doc_id", "text")
    made = _run(whole, units, seed, [*SHAPE, ("made", T.BinaryType(), pa.binary())], lambda n, form, a, b, parts: (n, form, a, b, output(form, parts)))
    return with_text(made, docs, F.col("made").cast("string"))


def digests(docs: DataFrame, units: str = "chars", seed: str = SEED) -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units, and the SHA-256 of the output and of the text restored from it."""

    def finish(n: int, form: str, a: int | None, b: int | None, parts: list[bytes]) -> tuple:
        made = output(form, parts)
        return n, form, a, b, hashlib.sha256(made).hexdigest(), hashlib.sha256(restored(made, form)).hexdigest()

    kept = docs.select(F.struct(F.col("`doc_id`").alias("doc_id")).alias("row"), F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"))
    made = _run(kept, units, seed, [*SHAPE, ("output_sha256", *TEXT), ("restored_sha256", *TEXT)], finish)
    return made.select("row.doc_id", *[F.col(n) for n in made.columns if n != "row"])


def rank_index(docs: DataFrame, units: str = "chars") -> DataFrame:
    """doc_id, n, segments (first rank, first offset, slope) and residuals (a byte each) of every text, to be kept."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("`doc_id`").alias("doc_id"), F.coalesce(F.col("`text`"), F.lit("")).cast("binary").alias("data"))
    segment = pa.struct([("first", pa.int64()), ("base", pa.int64()), ("slope", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [RankIndex(data.as_py(), units) for data in batch.column(1)]
            chains = [[{"first": f, "base": b, "slope": s} for f, b, s in zip(m.first.tolist(), m.base.tolist(), m.slope.tolist())] for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.n for m in made], pa.int64()), pa.array(chains, pa.list_(segment)), pa.array([m.residual.tobytes() for m in made], pa.binary())], names=["doc_id", "n", "segments", "residuals"])

    return rows.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, segments array<struct<first:long,base:long,slope:double>>, residuals binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pick(read_table(spark, sf_dir, "documents"), "doc_id", "text")).withColumnsRenamed({"prefix_units": "prefix_chars", "middle_units": "middle_chars"})
