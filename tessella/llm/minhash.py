"""Near-duplicates by BagMinHash.

A document is the multiset of its five-word shingles.  Each shingle's weight axis is cut into the
dyadic intervals [0, 1), [1, 2), [2, 4), [4, 8), ...; each interval has a Poisson process in time whose
rate is its length, seeded by shingle and interval alone.  A point also draws a place in its interval
and a signature slot; it counts for a document if its place lies below the shingle's
multiplicity there.  A slot keeps the earliest point that counts, so two documents agree in a slot with
the probability of their weighted Jaccard similarity.  A document's processes stop once they pass its
latest slot.

Signatures are banded.  Equal texts are one node.  In each bucket one pivot is tested against all, and
the verified links are closed into components.  Nodes of buckets that still hold several components are
joined across them by the rare elements that alike bags must share, which is exact.  Elements of one
component only are never joined on, and where an element meets several, the nodes of its largest component
meet those of the others but not one another.  So the work grows with the pairs between components, a group
of alike texts is met in proportion to its size, and no link between components is lost.

Defined results: a null text is the empty text; texts without words, and texts shorter than five words,
are alike only if their words are equal; repeated rows and copies share a class; class_id is the least
doc_id of the class (null ids come last; a class of null ids only has none and keeps its least node); an
empty table gives no rows; a very long text is one row of 2^31 shingles at most, worked out apart from
others; equally full pivots go by their hash; other columns pass unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, counted_join, cut, discard, held, hot_keys, lean, matched, pick, read_table, spread_both, spread_join, text_or_empty

K = 5
THRESHOLD = 0.8
#: 32 bands of 6: a pair at 0.8 shares a band with probability 0.99994, one at 0.4 with 0.12.
BANDS, ROWS = 32, 6
SLOTS = BANDS * ROWS
SPACES = r"[ \t-\r]+"
#: Shingles whose signatures are worked out together.
CHUNK = 150_000

U = np.uint64
_GOLDEN = U(0x9E3779B97F4A7C15)


def golden(k: int) -> np.uint64:
    """k steps of the golden-ratio sequence, modulo 2^64."""
    return U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def runs(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal (doc, h); h is sorted within doc."""
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(h)))


def bag_signatures(doc: np.ndarray, h: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """(n_docs, slots) tokens of the earliest points; documents without shingles have zeros.

    doc, h: document number and hash of every shingle, sorted by document and hash.
    """
    first, weight = runs(doc, h)
    d0, h0 = doc[first], h[first].view(U)
    best = np.full(n_docs * slots, np.inf)
    token = np.zeros(n_docs * slots, U)
    seeds, docs, rates, lows, weights = [], [], [], [], []
    low, size, level = 0, 1, 0
    while True:  # the intervals that some multiplicity reaches into
        at = np.flatnonzero(weight > low)
        if not len(at):
            break
        seeds.append(mix(h0[at] + golden(level + 1)))
        docs.append(d0[at])
        rates.append(np.full(len(at), float(size)))
        lows.append(np.full(len(at), low))
        weights.append(weight[at])
        low, size, level = low + size, (1 if low == 0 else 2 * size), level + 1
    if not seeds:
        return token.reshape(n_docs, slots)
    seed, own, rate, lows_, w = map(np.concatenate, (seeds, docs, rates, lows, weights))
    time = np.zeros(len(seed))
    step = 0
    while len(seed):
        step += 1
        a = mix(seed + golden(step))
        time = time - np.log(((a >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        b = mix(a ^ U(0xD6E8FEB86659FD93))
        slot = ((b >> U(32)) * U(slots) >> U(32)).astype(np.int64)
        place = lows_ + ((b & U(0xFFFFFFFF)).astype(np.float64) * (rate * 2.0**-32)).astype(np.int64)
        counts = place < w
        cell, t = (own * slots + slot)[counts], time[counts]
        np.minimum.at(best, cell, t)
        won = best[cell] == t
        token[cell[won]] = a[counts][won]
        latest = best.reshape(n_docs, slots).max(axis=1)
        on = time < latest[own]
        if not on.all():
            seed, own, rate, lows_, w, time = (x[on] for x in (seed, own, rate, lows_, w, time))
    return token.reshape(n_docs, slots)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) hashes of the rows of each band."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U) * _GOLDEN), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        h = mix(h ^ parts[:, :, r]) + _GOLDEN
    return h.view(np.int64)


def shingles(text: Column, k: int = K) -> Column:
    """Sorted 64-bit hashes of the k-word shingles; a shorter text is one shingle, one without words has none."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    # a transform over one-element arrays binds the words once
    every = lambda ws: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - k, F.lit(0))), lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(k))))
    found = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, F.sort_array(every(ws))).otherwise(F.array().cast("array<long>")))
    return F.element_at(found, 1)


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values, row number of each value, and row lengths."""
    ends = column.offsets.to_numpy()
    lengths = np.diff(ends)
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.repeat(np.arange(len(lengths)), lengths), lengths


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the text), n (shingles), bands."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, doc, n = flat(batch.column(2))
            ends = np.concatenate([[0], np.cumsum(n)])
            parts, at = [], 0
            while at < len(n):  # so many documents at once as hold CHUNK shingles, or one
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
                own = slice(ends[at], ends[stop])
                parts.append(band_hashes(bag_signatures(doc[own] - at, h[own], stop - at)))
                at = stop
            bands = np.concatenate(parts)[n > 0] if parts else np.empty((0, BANDS), np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), lists], names=["doc_id", "node", "n", "bands"])

    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("node"), shingles(text_or_empty()).alias("shingles"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, node long, n long, bands array<long>")


def numbered_elements(rows: DataFrame) -> DataFrame:
    """node, bag: each shingle with its occurrence number as 64-bit hashes, from (node, shingles)."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, doc, n = flat(batch.column(1))
            first, length = runs(doc, h)
            occurrence = np.arange(len(h)) - np.repeat(first, length)
            e = mix(h.view(U) + occurrence.astype(U) * _GOLDEN).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(e))], names=["node", "bag"])

    return rows.mapInArrow(lean(run), "node long, bag array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of the links (a, b): comp is the least node of the component.

    Least labels spread along links and jump to their label's label, so long chains close in few rounds.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    hot, total = hot_keys(both, "b"), labels.count()
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("b"), "comp"), "b", "a", hot=hot).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        lower = cut(lower, "labels")
        target = lower.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        jumped = cut(spread_join(lower, target, "comp", "node", total=total).select("node", "old", F.col("further").alias("comp")), "labels")
        discard(labels, lower)
        if jumped.where("old <> comp").isEmpty():
            discard(both)
            return jumped
        labels = jumped


def similar(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b) those whose multisets of shingles have at least the given similarity."""
    left = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    both = F.size(F.array_intersect("bag_a", "bag_b"))
    # a pivot may stand on either side of a large part of all pairs
    total = pairs.count()
    known = {n: {"counts": pairs.groupBy(n).agg(F.count("*").alias("_n")), "total": total} for n in "ab"}
    met = spread_join(spread_join(pairs, left, "a", "b", **known["a"]), right, "b", "a", **known["b"])
    return met.where(both >= threshold * (F.size("bag_a") + F.size("bag_b") - both)).select("a", "b")


def sized(pairs: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs whose sizes allow the similarity, smaller node first."""
    fits = pairs.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    return fits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(members: DataFrame, bags: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links (a, b) that connect all alike nodes; members: (key, node, n, _n) of buckets with several nodes, _n of them.

    The first pivot of a bucket is the node whose buckets are fullest: the copies of an original meet it
    in more bands than one another, so most groups close at once.  A bucket is settled when its members
    other than the pivot lie in one component; those of the others are joined exactly.
    """
    total = members.count()
    members = cut(members.withColumn("full", F.sum("_n").over(W.partitionBy("node"))), "members")
    pivot = members.groupBy("key").agg(F.max(F.struct("full", "node", "n")).alias("p"), F.max("_n").alias("_n")).select("key", F.col("p.node").alias("a"), F.col("p.n").alias("n_a"), "_n")
    pairs = counted_join(members, pivot, "key", "node", total).where("node <> a").select("a", "n_a", F.col("node").alias("b"), F.col("n").alias("n_b"))
    tested = cut(sized(pairs, threshold), "pairs")
    found = cut(similar(tested, bags, threshold), "similar")
    done = pivot.select("key", F.col("a").alias("node"))
    comps = components(found).select("node", "comp")
    left = members.join(done, ["key", "node"], "left_anti").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    left = cut(left, "left")
    open_ = left.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("_n").alias("_n")).where("x <> y").select("key", "_n")
    nodes = cut(counted_join(left, open_, "key", "node", total, "left_semi").select("node", "comp").distinct(), "unsettled")
    if nodes.isEmpty():
        return found
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("size"))
    nodes = spread_join(nodes, sizes, "comp", "node", counts=sizes.withColumnRenamed("size", "_n"))
    pairs = cut(crossing(nodes, bags, threshold).join(tested, ["a", "b"], "left_anti"), "pairs")
    return cut(found.union(similar(pairs, bags, threshold)), "similar")


def prefixes(nodes: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(e, k, node, comp, n, major): the elements by which nodes (node, comp, size of it) of different components can meet.

    Elements are ordered: first those of one component only, which link nothing new, then from rare to common.
    The first element that two bags with the similarity share is among the first n - ceil(threshold * n) + 1 of the
    larger, whatever the order.  So only nodes whose other elements are too few to fill that prefix appear here.
    ``major`` tells whether a node is of the largest component that holds the element.
    """
    own = bags.join(nodes, "node").select("node", "comp", "size", F.size("bag").alias("n"), F.explode("bag").alias("e"))
    common = own.groupBy("e").agg(F.count("*").alias("f"), (F.min("comp") != F.max("comp")).alias("several")).where("f > 1")
    common = cut(common, "elements")
    ranked = spread_join(own, common, "e", "node", "left", counts=common.select("e", F.col("f").alias("_n")), total=bags.join(nodes, "node").agg(F.sum(F.size("bag"))).first()[0])
    rank = F.row_number().over(W.partitionBy("node").orderBy("several", "f", "e"))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    ranked = ranked.withColumns({"f": F.coalesce("f", F.lit(1)), "several": F.coalesce("several", F.lit(False))}).withColumn("k", rank)
    first = cut(ranked.where((F.col("k") <= prefix) & F.col("several")).select("e", "k", "node", "comp", "size", "n"), "prefixes")
    most = first.groupBy("e").agg(F.max(F.struct("size", "comp"))["comp"].alias("most"), (F.min("comp") != F.max("comp")).alias("several"), F.count("*").alias("_n"))
    most = cut(most, "majors")
    met = spread_join(first, most.where("several").select("e", "most"), "e", "node", counts=most.select("e", "_n"))
    met = cut(met.select("e", "k", "node", "comp", "n", (F.col("comp") == F.col("most")).alias("major")), "meeting")
    discard(common, first, most)
    return met


def meetings(met: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``prefixes`` beside one another by their elements: a larger node, and b with its shorter prefix.

    Nodes of an element's major component meet only those of its others.  Among the others pairs within a component
    come up too, but not more of them than pairs with the major one, which is as large.
    """
    bound = 2 * threshold / (1 + threshold)
    # among the first n - ceil(bound * n) + 1 of the smaller, where bound = 2 threshold / (1 + threshold)
    smaller = met.where(F.col("k") <= F.col("n") - F.ceil(F.lit(bound) * F.col("n") - 1e-9) + 1)
    # each element is two keys: one for the larger nodes of the major component, one for those of others
    sides = F.explode(F.when(F.col("major"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    key = lambda side: F.xxhash64("e", side).alias("key")
    other = smaller.withColumn("side", sides).select(key("side"), F.col("k").alias("k_b"), F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"))
    return spread_both(met.select(key("major"), "k", "node", "comp", "n"), other, "key", "node", "b")


def crossing(nodes: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes (node, comp, size) in different components that can be alike, by prefix filtering."""
    met = prefixes(nodes, bags, threshold)
    # If this is the first element both share, no more than what follows it in either can be shared besides.
    reach = 1 + F.least(F.col("n") - F.col("k"), F.col("n_b") - F.col("k_b"))
    near = ((F.col("n_b") < F.col("n")) | ((F.col("n_b") == F.col("n")) & (F.col("node") < F.col("b")))) & (F.col("comp") != F.col("comp_b")) & (reach >= threshold / (1 + threshold) * (F.col("n") + F.col("n_b")) - 1e-6)
    return meetings(met, threshold).where(near).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_shingles, node, class_node: one row per row of ``docs``; a class without any id is known by its class_node."""
    docs = pick(docs, "doc_id", "text")
    rows = cut(signed(docs).withColumn("row", F.monotonically_increasing_id()), "signatures")
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row")), "nodes")
    # Each text's bands enter once, by one of its rows; copies and repeated rows are never dealt out by bucket.
    banded = rows.join(nodes.select("row"), "row", "left_semi").select("node", "n", F.explode("bands").alias("key"))
    several = cut(banded.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"), "several")
    members = cut(spread_join(banded, several, "key", "node", counts=several, total=BANDS * nodes.count()), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("first").alias("doc_id")), "node")
    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("node"), text_or_empty().alias("text"))
    texts = matched(texts, wanted, ["node", "doc_id"], "left_semi")
    bags = cut(numbered_elements(texts.select("node", shingles(F.col("text")).alias("shingles"))).dropDuplicates(["node"]), "bags")
    comps = components(links(members, bags, threshold)).select("node", "comp")
    named = comps.join(nodes, "node")
    least = cut(named.groupBy("comp").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("head"), F.count("*").alias("_n")), "least")
    headed = spread_join(named.select("node", "comp"), least.select("comp", "head"), "comp", "node", counts=least.select("comp", "_n"))
    of_node = nodes.join(headed.select("node", "head"), "node", "left")
    of_node = of_node.select("node", F.coalesce("head.first", "first").alias("class_id"), F.coalesce("head.node", "node").alias("class_node"))
    return spread_join(rows.select("doc_id", "node", F.col("n").alias("n_shingles")), cut(of_node, "classes"), "node", "doc_id").select("doc_id", "class_id", "n_shingles", "node", "class_node")


def leads() -> Column:
    """Whether a row is the one of its class that stays, or a copy of it."""
    return F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", leads().alias("kept"), "n_shingles")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the least doc_id; columns as they were."""
    kept = classes(docs).where(leads()).select("doc_id", "node").distinct()
    marked = held(docs, "doc_id", "text").select("row", "doc_id", F.xxhash64(text_or_empty()).alias("node"))
    return matched(marked, kept, ["doc_id", "node"], "left_semi").dropDuplicates(["doc_id", "node"]).select("row.*")
