"""The trie of conversations' prefixes, as a node table with minimal perfect hashing.

Every distinct sequence of first turns is a node, named by a digest that is chained turn by turn.  The distinct
digests are enumerated with their members counted where they are.  They are dealt into shards, and each shard
gives its nodes slots by a minimal perfect hash: levels of bits, in which a key that meets no other keeps its
place and the rest go on to the next level.  A lookup compares the digest stored at its slot, so a key of another
shard is told apart.  Counts are scattered into flat arrays by slot, and children, leaves and savings added up
through an array of parents' slots, from the deepest nodes to the shallowest.

A shard holds whole connected parts of the trie.  A part are neighbouring nodes of one band, the power of
``BAND`` in which their number of members lies, and of one block of ``BLOCK`` depths.  Along a path the members
only fall, so the trie falls apart into parts of at most ``BAND`` paths each, whatever its size, and the parts of a
band need only what those below them add up to.  There are as many rounds as bands (six for 10^13 conversations)
times blocks in use (one, unless conversations are longer than ``BLOCK`` turns).

No conversation, node or list of members has to fit in a task: turns are numbered within ranges, digests chained by
blocks, members counted where they are, and the lists of ids hashed as a stream of sorted pieces.

Defined results: turns without a conv_id belong to no conversation; within one, turns are ordered by turn (null
first), role and text; a null role or text is empty; repeated rows are turns of their own; a very long text counts
only by its digest and its words; an empty table gives no rows; other columns are unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.table import positions
from .common import cut, lean, pick, read_table, spread_join
from .mixing import n_words

BLOCK = 1 << 14  # depths in a part
BAND = 1 << 8  # members of a part's top
SHARD_NODES = 1 << 17  # nodes of a shard, on average
BROADCAST_NODES = 1 << 17  # up to so many nodes above the first band are broadcast, of 20 bytes each
PIECE = 1 << 12  # ids in a piece of a list
ROOT = bytes(16)

# Every conversation takes over the first turns of the one whose id is the multiple of 20 below its own.
FAMILY = 20
TAKEN_OVER = 4  # less than so many turns


def digest_of(*parts: Column) -> Column:
    """16 bytes of the SHA-256."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, place, digest, words), the place from 0, and conversations as (conv_id, turns)."""
    text = lambda n: F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(""))
    t = conversations.where(F.col("`conv_id`").isNotNull()).select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    turn = digest_of(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    placed = cut(positions(t, ["conv_id", "turn", "role", "text"]).select("conv_id", "_at", turn.alias("digest"), n_words(F.col("text")).alias("words")), "turns")
    convs = cut(placed.groupBy("conv_id").agg(F.min("_at").alias("start"), F.count("*").alias("turns")), "conversations")
    counts = convs.select("conv_id", F.col("turns").alias("_n"))
    rows = spread_join(placed, convs.select("conv_id", "start"), "conv_id", "_at", counts=counts)
    return rows.select("conv_id", (F.col("_at") - F.col("start")).alias("place"), "digest", "words"), convs.select("conv_id", "turns")


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same after each conversation's first turns are replaced by as many of its family's first conversation."""
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    over = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN_OVER).cast("long")
    c = convs.select("conv_id", "turns", family.alias("family"), over.alias("over"))
    first = convs.select(F.col("conv_id").alias("family"), F.col("turns").alias("there"))
    c = c.join(first, "family", "left").withColumn("head", F.least("over", F.coalesce("there", F.lit(0))))
    c = cut(c.select("conv_id", "family", "over", "head", (F.col("head") + F.greatest(F.col("turns") - F.col("over"), F.lit(0))).alias("length")), "rebuilt")
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < TAKEN_OVER - 1)).withColumnRenamed("conv_id", "family")
    taken = heads.join(c.select("conv_id", "family", "head"), "family").where("place < head").select("conv_id", "place", "digest", "words")
    counts = convs.select("conv_id", F.col("turns").alias("_n"))
    own = spread_join(turns, c.select("conv_id", "over", "head"), "conv_id", "place", counts=counts).where("place >= over")
    own = own.select("conv_id", (F.col("place") - F.col("over") + F.col("head")).alias("place"), "digest", "words")
    return taken.unionByName(own), c.select("conv_id", F.col("length").alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch], start: bytes | None) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes | None]]]:
    """For rows sorted by (conv_id, block) and place: the digest chained so far within a block, and the one before it."""
    last, state = None, start
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        digests, befores = [], []
        for key, turn in zip(keys, batch.column(3).to_pylist()):
            fresh = key != last
            before = None if fresh else state
            state = hashlib.sha256((ROOT if fresh else state) + turn).digest()[:16]
            digests.append(state)
            befores.append(before)
            last = key
        yield batch, digests, befores


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and node on its path: conv_id, depth, node, parent, words, ends, block; written."""
    rows = turns.select("conv_id", F.floor(F.col("place") / BLOCK).cast("long").alias("block"), "place", "digest", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, digests, befores in _chained(batches, None):
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (0, 1, 2, 4)], pa.array(digests, pa.binary()), pa.array(befores, pa.binary())], names=["conv_id", "block", "place", "words", "node", "parent"])

    local = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place").mapInArrow(lean(run), "conv_id long, block long, place long, words long, node binary, parent binary")
    if (convs.agg(F.max("turns")).first()[0] or 0) > BLOCK:
        local = cut(local, "local")
        ends = local.where(F.col("place") % BLOCK == BLOCK - 1).select("conv_id", "block", "node")

        def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, state = None, ROOT
            for batch in batches:
                out = []
                for conv, node in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    state = hashlib.sha256(state + node).digest()[:16] if conv == last else node
                    last = conv
                    out.append(state)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.add(batch.column(1), 1), pa.array(out, pa.binary())], names=["conv_id", "block", "carry"])

        # one row for BLOCK turns
        carry = ends.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(carried, "conv_id long, block long, carry binary")
        local = local.join(carry, ["conv_id", "block"], "left")
        whole = lambda n: F.when(F.col("carry").isNull(), F.col(n)).otherwise(digest_of(F.col("carry"), F.col(n)))
        local = local.select("conv_id", "block", "place", "words", whole("node").alias("node"), F.when(F.col("parent").isNotNull(), whole("parent")).otherwise(F.col("carry")).alias("parent"))
    counts = convs.select("conv_id", F.col("turns").alias("_n"))
    local = spread_join(cut(local, "chained"), convs, "conv_id", "place", counts=counts)
    nodes = local.select("conv_id", (F.col("place") + 1).alias("depth"), "node", F.coalesce("parent", F.lit(ROOT)).alias("parent"), "words", (F.col("place") + 1 == F.col("turns")).alias("ends"), "block")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), (F.col("turns") == 0).alias("ends"), F.lit(0).cast("long").alias("block"))
    return cut(nodes.unionByName(root), "paths")


def ends_sha256(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: of the ids, ascending and joined by commas, of ``ends`` (node, conv_id).

    Sorted ranges give pieces of text, which are hashed one after another; a list never lies in memory whole.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1][0] for r in rows], pa.int64()), pa.array([",".join(map(str, r[1])) for r in rows], pa.string())], names=["node", "first", "ids"])

        last, ids = None, []
        for batch in batches:
            out = []
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (node != last or len(ids) == PIECE):
                    out.append((last, ids))
                    ids = []
                last = node
                ids.append(conv)
            yield made(out)
        if ids:
            yield made([(last, ids)])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])

        last, state = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if node != last:
                    if last is not None:
                        out.append((last, state.hexdigest()))
                    last, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield made(out)
        if last is not None:
            yield made([(last, state.hexdigest())])

    ranges = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(lean(pieces), "node binary, first long, ids string")
    return ranges.repartition("node").sortWithinPartitions("node", "first").mapInArrow(lean(hashed), "node binary, ends_sha256 string")


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 128-bit keys: levels of bits with twice as many places as keys still without one."""

    def __init__(self, keys: np.ndarray):
        self.levels, rest, used = [], np.arange(len(keys)), 0
        while len(rest):
            if len(self.levels) > 200:
                raise ValueError("keys of a perfect hash must differ")
            size = max(2 * len(rest), 8)
            place = self.place(keys[rest], len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((size, alone, used + np.cumsum(alone) - 1))
            used += int(alone.sum())
            rest = rest[~alone[place]]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (keys[:, 0] ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29)) ^ keys[:, 1]) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot, or -1, for keys that are none of the n."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            if not len(rest):
                break
            place = self.place(keys[rest], level, size)
            hit = alone[place]
            out[rest[hit]] = rank[place[hit]]
            rest = rest[~hit]
        return out


def keys_of(column: pa.ChunkedArray, missing: bytes = b"\xff" * 16) -> np.ndarray:
    """Digests as rows of two 64-bit integers."""
    return np.frombuffer(b"".join(missing if x is None else x for x in column.to_pylist()), np.uint64).reshape(-1, 2)


NODE = "node binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent binary, parent_conv_id long, top boolean"


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's node table: slots, scattered counts, and sums through the parents' slots."""
    given = [b for b in batches if b.num_rows]
    if not given:
        return
    t = pa.Table.from_batches(given)
    keys, above = keys_of(t["node"]), keys_of(t["parent"])
    table = PerfectHash(keys)
    slot = table.slots(keys)
    n = len(keys)

    def scattered(name: str) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[slot] = t[name].to_numpy()
        return out

    stored, parents = np.empty_like(keys), np.empty_like(above)
    stored[slot], parents[slot] = keys, above
    parent = table.slots(parents)
    known = (parent >= 0) & (stored[parent] == parents).all(axis=1)  # else the parent is of another shard
    depth, members, words, conv = scattered("depth"), scattered("n_convs"), scattered("words"), scattered("conv_id")
    children, leaves, saved = scattered("children"), scattered("leaves"), scattered("saved")
    np.add.at(children, parent[known], 1)
    leaves += children == 0
    saved += (members - 1) * words
    order = np.flatnonzero(known)
    order = order[np.argsort(-depth[order], kind="stable")]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    back = np.empty(n, np.int64)
    back[slot] = np.arange(n)  # the row of each slot
    parent_conv = pa.array(conv[np.where(known, parent, 0)], mask=~known)
    columns = [t["node"].take(pa.array(back)), *map(pa.array, (conv, depth, members, children, leaves, saved)), t["parent"].take(pa.array(back)), parent_conv, pa.array(~known)]
    yield from pa.table(columns, names=[c.split()[0] for c in NODE.split(", ")]).to_batches(max_chunksize=10_000)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of all prefixes of ``turns`` (conv_id, place, digest, words) of ``convs`` (conv_id, turns).

    Returns node, conv_id, depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    way = paths(turns, convs)
    counts = way.groupBy("node").agg(F.count("*").alias("_n"))
    band = F.lit(0)
    for k in range(1, 8):
        if BAND**k < 1 << 63:  # no more members can be counted
            band = band + (F.col("_n") > BAND**k).cast("int")
    big = cut(counts.where(F.col("_n") > BAND).select("node", band.alias("band"), "_n"), "big")
    if big.count() <= BROADCAST_NODES:
        banded = way.join(F.broadcast(big.drop("_n")), "node", "left")
    else:
        banded = spread_join(way, big.drop("_n"), "node", "conv_id", "left", counts=big.select("node", "_n"), total=way.count())
    banded = banded.withColumn("band", F.coalesce("band", F.lit(0)))
    banded = banded.withColumn("part", F.first("node").over(W.partitionBy("conv_id", "block", "band").orderBy("depth")))  # at most BLOCK rows each
    nodes = cut(
        banded.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"), F.first("block").alias("block"), F.first("band").alias("band"), F.first("part").alias("part"), F.count("*").alias("n_convs")),
        "nodes",
    )
    below, done = None, None
    for r in nodes.groupBy("block", "band").count().orderBy(F.desc("block"), "band").collect():  # a row for each round
        own = nodes.where((F.col("block") == r["block"]) & (F.col("band") == r["band"]))
        if below is None:
            own = own.withColumns({n: F.lit(0).cast("long") for n in ("children", "leaves", "saved")})
        else:
            own = own.join(below, "node", "left").fillna(0, ["children", "leaves", "saved"])
        shards = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), r["count"] // SHARD_NODES)
        part = cut(own.select("node", "parent", "depth", "n_convs", "words", "conv_id", "children", "leaves", "saved", "part").repartition(shards, "part").drop("part").mapInArrow(lean(_shard), NODE), "shards")
        # what the parts' tops hand up, to be taken in by the rounds of their parents
        tops = part.where("top AND parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        below = tops if below is None else below.unionByName(tops).groupBy("node").agg(*[F.sum(n).alias(n) for n in ("children", "leaves", "saved")])
        done = part if done is None else done.unionByName(part)
    if done is None:
        done = nodes.sparkSession.createDataFrame([], NODE)
    # a top's parent lies in a higher band or an earlier block
    higher = nodes.where(f"band > 0 OR (depth > 0 AND depth % {BLOCK} = 0)").select(F.col("node").alias("parent"), F.col("conv_id").alias("top_conv"))
    tops = spread_join(done.where("top AND parent IS NOT NULL").drop("parent_conv_id"), higher, "parent", "node", "left")
    joined = done.where("NOT top OR parent IS NULL").unionByName(tops.withColumnRenamed("top_conv", "parent_conv_id"))
    ends = ends_sha256(way.where("ends").select("node", "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return joined.join(ends, "node", "left").select("node", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    return prefix_trie(*ordered(conversations))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = ordered(pick(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"))
    found = prefix_trie(*rebuilt(turns, convs))
    return found.drop("node", "parent")
