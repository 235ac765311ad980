"""SentencePiece encoding by streaming Viterbi, and decoding.

The lattice of a text has its character boundaries as states and the pieces as arcs.  For a unigram
model the best path maximises the sum of scores.  For a BPE model a path is admissible when each piece
is what merging makes of its own characters and no two neighbours would have merged differently side by
side; each boundary then has exactly one admissible predecessor, and the path equals that of the merges.

Only a window of boundaries as wide as the longest piece can still be extended.  From time to time the
back pointers of all boundaries in the window are followed; where they meet, everything before is
committed and forgotten, so memory is bounded by the stretch without a meeting point.

A boundary before a run of the space mark is crossed by no piece (the vocabulary is checked for that).
All paths meet there, so texts are cut at these boundaries and stretches between them memoised.

Defined results: a null text is the empty text and has no ids; characters that are in no piece become
their bytes, or the unknown id where the model has none; decoding restores the normalised text; repeated
rows are encoded alike; an empty table gives no rows; other columns pass unread; a very long text is encoded whole, in
one row, and needs memory for its ids and for one stretch between meeting points.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MARK = "▁"
MEMO = 500_000
#: Characters between two looks for a meeting point.
STRIDE = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message's fields."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[i]
            out |= (b & 127) << shift
            i += 1
            if b < 128:
                return out, i
            shift += 7

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        elif tag & 7 == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 8 if tag & 7 == 1 else 4
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


def is_bpe(model_file: str) -> bool:
    """Whether the trainer's model type (field 3 of field 2) is BPE (2)."""
    with open(model_file, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 2:
                return dict(_fields(value)).get(3, 1) == 2
    return False


def is_plain(model_file: str) -> bool:
    """Whether the normaliser (field 3) only adds a leading space and marks spaces: name (1) identity, no
    removal of white space (4), a leading space (3) and marks (5)."""
    with open(model_file, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 3:
                rules = dict(_fields(value))
                return rules.get(1) == b"identity" and not rules.get(2) and rules.get(3, 1) == 1 and rules.get(4, 1) == 0 and rules.get(5, 1) == 1
    return False


class Codec(dict):
    """Encoder and decoder of one model; as a dict, the younger half of the memo of units."""

    def __init__(self, model_file: str, memo: int = MEMO, stride: int = STRIDE):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bpe, self.memo, self.stride = is_bpe(model_file), memo, stride
        size = self.sp.get_piece_size()
        special = [self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) for i in range(size)]
        self.ids = {self.sp.id_to_piece(i): i for i in range(size) if not special[i]}
        self.scores = {p: self.sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(self.sp.id_to_piece(i)[3:5], 16): i for i in range(size) if self.sp.is_byte(i)}
        self.longest = max(map(len, self.ids), default=1)
        self.crossed = any(MARK in p.lstrip(MARK) for p in self.ids)
        # with the mark as a space, as decoding gives them
        self.pieces = [None if special[i] else self.sp.id_to_piece(i).replace(MARK, " ") for i in range(size)]
        self.plain = not self.crossed and is_plain(model_file)
        self._older: dict[str, bytes] = {}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.lowest = min(self.scores.values(), default=0.0) - 10
        self._fits: dict[tuple[str, str], bool] = {}
        self.rank = {p: k for k, p in enumerate(sorted(self.ids, key=lambda p: (-self.scores[p], self.ids[p])))}
        self.no_rank = len(self.rank)
        # pieces that merging can make, and the last merge of each longer one
        self.split = {p: parts for p in self.ids if len(p) > 1 and (parts := self.last_merge(p))} if self.bpe else {}
        self._valid = {p for p in self.ids if len(p) == 1 or p in self.split}
        self._ends: dict = {}
        for p in self._valid:
            node = self._ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        self._stretch = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    # merges

    def last_merge(self, p: str) -> tuple[str, str] | None:
        """The two parts whose merge makes ``p`` of its characters last; None if merging ends otherwise."""
        parts = list(p)
        while len(parts) > 1:
            ranks = [self.rank.get(x + y, self.no_rank) for x, y in zip(parts, parts[1:])]
            best = min(ranks)
            if best == self.no_rank:
                return None
            at = ranks.index(best)
            pair = parts[at], parts[at + 1]
            parts[at : at + 2] = [pair[0] + pair[1]]
        return pair

    def fits(self, a: str, b: str) -> bool:
        """Whether merging keeps ``a`` and ``b`` apart when they stand side by side.

        The merges that made both are undone from the latest to the first.  Had the parts that face each
        other at some time a better merge than the next one in history, it would have been taken.
        """
        key = (a, b)
        rank, split, limit = self.rank, self.split, self.no_rank
        left, right = split.get(a), split.get(b)
        while True:
            if rank.get(a + b, self.no_rank) < limit:
                ok = False
                break
            if left and (not right or rank[a] > rank[b]):
                limit, a = rank[a], left[1]
                left = split.get(a)
            elif right:
                limit, b = rank[b] + 1, right[0]  # of equal merges the left one comes first
                right = split.get(b)
            else:
                ok = True
                break
        if len(self._fits) >= self.memo:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    # the lattice

    def path(self, chars: Iterator[str] | str) -> Iterator[str]:
        """The pieces of the best path, committed as soon as all surviving paths agree on them."""
        ids, scores, longest = self.ids, self.scores, self.longest
        text = ""  # of the boundaries from ``base`` on
        base = 0
        # by boundary: length of the piece that ends there (0: none), and the score of the path
        back, total = [0], [0.0]
        last: list[str] = [""]
        for c in chars:
            text += c
            i = len(text)
            found, best, piece = 0, None, ""
            for n in range(min(longest, i), 0, -1):
                if n > 1 or c in ids:
                    p = text[i - n :]
                    if p not in ids or total[i - n] is None:
                        continue
                    if not self.bpe:
                        score = total[i - n] + scores[p]
                        if best is None or score > best:
                            found, best, piece = n, score, p
                    elif p in self._valid and (not last[i - n] or last[i - n] not in self._valid or self.fits(last[i - n], p)):
                        found, best, piece = n, 0.0, p
                        break
            if not found and (total[i - 1] is not None) and c not in ids:
                found, best, piece = 1, total[i - 1] + (0.0 if self.bpe else self.lowest), c
            back.append(found)
            total.append(best)
            last.append(piece)
            if i >= longest + self.stride:
                # follow the back pointers of the window; the latest boundary steps back until one is left
                alive = {j for j in range(max(i - longest + 1, 0), i + 1) if total[j] is not None}
                while len(alive) > 1:
                    j = max(alive)
                    alive.discard(j)
                    alive.add(j - back[j])
                meet = alive.pop() if alive else 0
                if meet:
                    yield from self._trace(last, back, meet)
                    text, back, total, last = text[meet:], [0, *back[meet + 1 :]], total[meet:], last[meet:]
                    base += meet
        yield from self._trace(last, back, len(text))

    @staticmethod
    def _trace(last: list[str], back: list[int], at: int) -> list[str]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= back[at]
        return out[::-1]

    def window(self, s: str) -> list[str]:
        """The path of a stretch that fits in one window, so that nothing is committed before its end.  BPE models only."""
        ends, valid, known, fits = self._ends, self._valid, self._fits, self.fits
        last: list[str] = [""]
        for i in range(len(s)):
            # pieces that end here, by walking back through the tree of reversed pieces
            node, found = ends, []
            for k in range(i, -1, -1):
                node = node.get(s[k])
                if node is None:
                    break
                if "" in node:
                    found.append(node[""])
            for p in reversed(found):
                a = last[i + 1 - len(p)]
                if not a or a not in valid or (ok := known.get((a, p))) or (ok is None and fits(a, p)):
                    last.append(p)
                    break
            else:
                last.append(s[i])
        out = []
        at = len(s)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def viterbi(self, normalised: str) -> list[int]:
        out: list[int] = []
        for p in self.window(normalised) if self.bpe and len(normalised) <= self.stride else self.path(normalised):
            known = self.ids.get(p)
            if known is not None:
                out.append(known)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            elif not out or out[-1] != self.sp.unk_id():  # unknown neighbours are one piece
                out.append(self.sp.unk_id())
        return out

    def __missing__(self, unit: str) -> bytes:
        """The ids of a unit behind one mark; the memo's older half is asked before the lattice."""
        ids = self._older.get(unit)
        if ids is None:
            ids = array("i", self.viterbi(MARK + unit)).tobytes()
            if len(unit) > 48:
                return ids
        if len(self) >= self.memo:  # the present half becomes the older one, and what is in use moves on
            self._older = dict(self)
            self.clear()
        self[unit] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        if not text:
            return np.empty(0, "<i4")
        if self.plain and "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
            return np.frombuffer(b"".join(map(self.__getitem__, text.split(" "))), dtype="<i4")
        s = self.sp.normalize(text)
        if self.crossed:
            return np.asarray(self.viterbi(s), dtype="<i4")
        parts = []
        for x in self._stretch.findall(s):
            one = x[0] == MARK and len(x) > 1 and x[1] != MARK
            parts.append(self[x[1:]] if one else array("i", self.viterbi(x)).tobytes())
        return np.frombuffer(b"".join(parts), dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined, the mark as a space, the leading space that encoding adds removed."""
        parts = list(map(self.pieces.__getitem__, ids.tolist()))
        if None in parts:
            at = 0
            while at < len(parts):
                if parts[at] is None:
                    end = at
                    while end < len(parts) and parts[end] is None:
                        end += 1
                    own = [int(x) for x in ids[at:end]]
                    raw = bytes(self.bytes_of[x] for x in own if x in self.bytes_of)
                    parts[at:end] = [raw.decode("utf-8", "replace") + " ⁇ " * (not raw and self.sp.unk_id() in own)] + [""] * (end - at - 1)
                    at = end
                else:
                    at += 1
        text = "".join(parts)
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """One codec for each worker process, so that its memo outlives a task."""
    return Codec(model_file)


def encode_table(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_ids, ids, round_trip (whether decoding gives the text back) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [own.encode(t) for t in texts]
            back = [own.decode(r) == (t or "") for r, t in zip(rows, texts)]
            n = np.array([len(r) for r in rows], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), ids, pa.array(back)], names=["doc_id", "n_ids", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids long, ids array<int>, round_trip boolean")


def decode_table(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text from (doc_id, ids)."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            texts = [own.decode(np.asarray(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id"), F.col("ids")).mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
