"""Best-fit packing by patterns and non-negative least squares.

Documents are tokenised, cut where they exceed the capacity and laid into sequences.  The
histogram of piece lengths (at most ``capacity`` bins, whatever the corpus) decides everything:

1. patterns of two to four lengths that fill a sequence exactly are enumerated,
2. non-negative least squares fits how often each is repeated so that the histogram is matched,
3. the counts are rounded down and what they leave over is packed best-fit decreasing.

The plan is a list of (pattern, repeats).  Pieces find their slot by their rank among pieces of the
same length; ranks come from salted windows, so one length may hold any share of the corpus.

Defined results: a null text is empty and gives one piece holding only the end id; repeated rows
are packed as often as they occur; doc_id may be null and of any type; pieces that tie take their rank by
their hash; a very long text is tokenised whole, in one row; an empty table gives no rows; columns of
the input other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cut, lean, pick

CAPACITY = 2048
END_ID = 0
#: Entries of each half of the per-worker memo of encoded units.
MEMO = 100_000
#: Patterns enumerated for each length in the histogram.
PATTERNS_PER_LENGTH = 6

PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


class UnitEncoder(dict):
    """Byte-level BPE, memoised by unit.

    A text is split at each single space between two non-space characters.  The pre-tokeniser always
    starts a new token there and looks no further, so units are encoded apart and joined.  Before that a
    text is split at the ``added`` tokens of the tokenizer, which have ids of their own.
    """

    _boundary = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, ranks_path: str, pattern: str, memo: int = MEMO, added: dict[str, int] | None = None):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._added = {token: np.array([i], dtype="<u4").tobytes() for token, i in (added or {}).items()}
        # the longest of those that begin at one place
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if self._added else None
        self._memo = memo
        self._older: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise KeyError(unit)  # not a unit of its own: the text is split the careful way
        ids = self._older.get(unit)
        if ids is None:
            ids = self.raw(" " + unit)
            if len(unit) > 48:
                return ids
        if len(self) >= self._memo:  # the present half becomes the older one, and what is in use moves on
            self._older = dict(self)
            self.clear()
        self[unit] = ids
        return ids

    def raw(self, text: str) -> bytes:
        return np.asarray(self._bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit words."""
        if self._marks is None or not self._marks.search(text):
            return self.plain(text)
        return b"".join([self._added[part] if k % 2 else self.plain(part) for k, part in enumerate(self._marks.split(text))])

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if not text:
            return b""
        units = text.split(" ")
        head = units[0]
        if head and not head[-1].isspace():
            try:
                return self.raw(head) + b"".join(map(self.__getitem__, units[1:]))
            except KeyError:
                pass
        units = self._boundary.split(text)
        return self.raw(units[0]) + b"".join([self.raw(" " + u) if u[-1].isspace() else self[u] for u in units[1:]])


@lru_cache(maxsize=2)
def unit_encoder(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> UnitEncoder:
    """One encoder for each worker process, so that its memo outlives a task."""
    return UnitEncoder(ranks_path, pattern, added=dict(added))


def added_tokens(json_path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens of a tokenizer's JSON file with their ids; those that take white space or bounds into account are refused."""
    with open(json_path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError(f"added tokens of {json_path} that aren't matched as they stand")
    return tuple((t["content"], t["id"]) for t in found)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenise(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """One row per piece, with its ids if asked for."""
    bounded_batches(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = unit_encoder(ranks_path, pattern, added)
        for batch in batches:
            out: list[tuple] = []
            tokens: list[np.ndarray] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.encode(text or "") + end
                for k, (s, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                    own = ids[4 * s : 4 * (s + n)]
                    out.append((doc_id, k, s, n, zlib.crc32(own)))
                    if with_ids:
                        tokens.append(np.frombuffer(own, dtype="<u4").astype(np.int32))
            cols = list(zip(*out)) if out else [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = np.cumsum([0, *map(len, tokens)], dtype=np.int32)
                values = np.concatenate(tokens) if tokens else np.empty(0, np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def patterns_for(hist: np.ndarray, capacity: int, per_length: int = PATTERNS_PER_LENGTH) -> list[tuple[int, ...]]:
    """Patterns of two to four present lengths that sum to the capacity; hist[L] counts length L."""
    present = np.flatnonzero(hist[:capacity])
    found: set[tuple[int, ...]] = set()
    if not len(present):
        return []
    has = hist[: capacity + 1] > 0
    weight = hist[present]
    for a in map(int, present):
        rest = capacity - a
        if has[rest]:
            found.add(tuple(sorted((a, rest), reverse=True)))
        fits = present[present < rest]
        partners = fits[has[rest - fits]] if len(fits) else fits
        if len(partners):
            common = np.argsort(-(np.minimum(hist[partners], hist[rest - partners])), kind="stable")[:per_length]
            found.update(tuple(sorted((a, int(b), rest - int(b)), reverse=True)) for b in partners[common])
        # four: this length, the two commonest that go with it, and what completes them
        top = present[np.argsort(-weight, kind="stable")[:24]]
        for i, b in enumerate(map(int, top)):
            for c in map(int, top[i : i + 3]):
                d = rest - b - c
                if 0 < d < capacity and has[d]:
                    found.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(found, reverse=True)


def fit_counts(patterns: list[tuple[int, ...]], hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares for A x = hist, where A[L, p] is how often pattern p has length L.

    Accelerated projected gradient on the sparse columns of A; the step is 1 / ||A||^2 by power iteration.
    """
    if not patterns:
        return np.zeros(0)
    rows = np.concatenate([np.array(p) for p in patterns])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    target = hist.astype(float)
    times = lambda x: np.bincount(rows, weights=x[cols], minlength=len(hist))
    back = lambda r: np.bincount(cols, weights=r[rows], minlength=len(patterns))
    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 1.0 / (1.05 * np.linalg.norm(back(times(v))))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(times(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal sequences are handled together."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, count]
    for length in range(min(capacity, len(hist) - 1), 0, -1):
        left = int(hist[length])
        for room in sorted(r for r in open_ if r >= length):
            if not left:
                break
            each = room // length
            groups, open_[room] = open_[room], []
            for own, n in groups:
                full = min(n, left // each)
                left -= full * each
                if full:
                    open_[room - each * length].append([own + (length,) * each, full])
                rest = n - full
                if rest and 0 < left < each:
                    open_[room - left * length].append([own + (length,) * left, 1])
                    rest -= 1
                    left = 0
                if rest:
                    open_[room].append([own, rest])
        each = capacity // length
        if left >= each:
            open_[capacity - each * length].append([(length,) * each, left // each])
        if left % each:
            open_[capacity - (left % each) * length].append([(length,) * (left % each), 1])
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in open_.values():
        for own, n in groups:
            merged[own] += n
    return sorted(merged.items(), reverse=True)


def plan_packing(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use exactly ``hist``: fitted patterns first, then the packed rest.

    The fit is rounded down.  Where taking all of it would strip the rest of its short pieces, a smaller
    share of the same fit is used, whichever needs the fewest sequences.
    """
    hist = hist.astype(np.int64)
    patterns = patterns_for(hist, capacity)
    fitted = fit_counts(patterns, np.where(np.arange(len(hist)) < capacity, hist, 0))
    best: tuple[int, list] | None = None
    for share in (1.0, 0.9, 0.75, 0.5):
        left, chosen = hist.copy(), []
        for p, x in zip(patterns, fitted):
            n = int(x * share + 1e-9)
            if not n:
                continue
            lengths, times = np.unique(np.array(p), return_counts=True)
            n = min(n, int((left[lengths] // times).min()))
            if n:
                left[lengths] -= n * times
                chosen.append((p, n))
        plan = chosen + best_fit(left, capacity)
        total = sum(n for _, n in plan)
        if best is None or total < best[0]:
            best = total, plan
    return best[1]


def slots(plan: Iterable[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length the runs [first rank, repeats, first sequence, offset], by first rank."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, n in plan:
        at = 0
        for length in pattern:
            runs[length].append((used[length], n, base, at))
            used[length] += n
            at += length
        base += n
    return {k: np.array(v, dtype=np.int64) for k, v in runs.items()}


def histogram(pieces: DataFrame, capacity: int) -> np.ndarray:
    """Counts by length; at most ``capacity`` rows reach the driver."""
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():
        hist[row["length"]] = row["count"]
    return hist


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds rank: 0, 1, ... within each length, by windows over (length, salt) and the salts' running totals.

    Even if all pieces had one length, no window would hold more than about the square root of their number.
    """
    salts = math.isqrt(total) + 1
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    bases = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("_k", F.row_number().over(within)).join(bases, ["length", "_salt"]).withColumn("rank", F.col("_base") + F.col("_k") - 1).drop("_salt", "_k", "_base")


def place(pieces: DataFrame, runs: dict[int, np.ndarray]) -> DataFrame:
    """Adds sequence_id and offset by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("rank")).to_numpy(zero_copy_only=False)
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                own, at = runs[int(n)], np.flatnonzero(length == n)
                k = np.searchsorted(own[:, 0], rank[at], side="right") - 1
                seq[at] = own[k, 2] + rank[at] - own[k, 0]
                off[at] = own[k, 3]
            keep = [i for i, x in enumerate(names) if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(seq), pa.array(off)], names=[*(names[i] for i in keep), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "rank")
    return pieces.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset: one row per piece."""
    pieces = cut(tokenise(pick(docs, "doc_id", "text"), ranks_path, pattern, capacity, with_ids, added), "pieces")
    hist = histogram(pieces, capacity)
    out = ranked(pieces, int(hist.sum()))
    return place(out, slots(plan_packing(hist, capacity), capacity)).select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from ``pack(..., with_ids=True)``: sequence_id, ids in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
