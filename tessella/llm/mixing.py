"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash, and a source's mix takes the documents whose hash lies below the source's
threshold, so larger budgets hold all that smaller ones do and no document is sorted.  Thresholds come from
histograms: the sizes are summed by source and the first digit of the hash; the bucket in which the running
sum passes the budget is the boundary; only its rows are summed by their next digit, until a single row is
left, the first that no longer fits.  What the budget still lacks is filled by further thresholds among the
later documents that are small enough, until less than ``NEAR`` of the target is missing or none fits.

A source whose target exceeds its size is taken whole first, and once more up to the threshold of the rest.

Defined results: a null text has no words and is never taken; a null source is a source of its own, last in
order; rows alike in all columns are told apart by a number given when they are written, so a budget may
take some of them; the hash comes from doc_id and the text's length, whatever the id's type (null too); a
source without words has target 0; an empty table gives no rows; a very long text is one document, taken
whole or not; other columns pass by, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.table import positions
from .common import cut, discard, held, pick, read_table, spread_join

WEIGHTS = (5, 2, 1)  # by the sources' order, repeating
SHARE = 1.5  # the mix, in sizes of the input
MOST = 2  # a source's target, and a document's copies, stop at so many times its size
NEAR = 0.001  # a budget of which less is missing is met
ROUNDS = 12  # thresholds of a budget at most
DIGIT = 10  # bits of the hash in a histogram's bucket
HASH_BITS, NUMBER_BITS = 60, 63
#: A table of sources is broadcast up to so many bytes, and joined with hot keys dealt out beyond.
BROADCAST_BYTES = 4 << 20

SPACES = r"[ \t-\r]+"


def n_words(text: Column) -> Column:
    """The number of runs of other characters than white space."""
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != "")).cast("long")


def source_key(source: Column) -> Column:
    """Sources as a text without nulls, in the order of code points, null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def sized(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns ``carry``, all without it), key, size, h, number; written once.

    ``number`` tells equal rows apart; it is part of the written table, so every later reading agrees.
    """
    names = docs.columns if carry is None else carry
    own = {n: F.col(f"`{n}`") for n in docs.columns}
    source = own["source"] if "source" in own else F.lit(None)
    row = F.struct(*[own[n].alias(n) for n in names]).alias("row")
    text = F.coalesce(own["text"], F.lit(""))
    # 60 bits of an MD5, so that SQL can say the same
    mark = F.concat(F.coalesce(own["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.length(text).cast("string"))
    h = F.conv(F.substring(F.md5(mark), 1, HASH_BITS // 4), 16, 10).cast("long")
    return cut(docs.select(row, source_key(source).alias("key"), n_words(text).alias("size"), h.alias("h"), F.monotonically_increasing_id().alias("number")), "sized")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (key, source_size) with ``target``.

    A target is the level times the source's weight, but at most ``most`` times its size.  Each round sets the
    level so that the targets add up, and fixes those above their bound, which raises the level of the rest.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_at") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = cut(positions(sources, "key").select("key", "source_size", weight.cast("long").alias("weight"), (most * F.col("source_size")).alias("bound")), "sources")
    goal = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, met = 0.0, -1
    while True:
        full = (F.lit(level) * F.col("weight") > F.col("bound")) if met >= 0 else F.lit(False)
        n, caps, free = s.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("bound"))), F.sum(F.when(~full, F.col("weight")))).first()
        if (n or 0) <= met or not free:
            break
        level, met = (goal - (caps or 0)) / free, n or 0
    level = F.lit(level) * F.col("weight")
    return s.select("key", "source_size", F.when(level > F.col("bound"), F.col("bound").cast("double")).otherwise(level).alias("target"))


def beside(rows: DataFrame, side: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with a table of sources: broadcast, or with hot sources dealt out where ``counts`` are given."""
    if counts is None:
        return rows.join(F.broadcast(side), "key")
    return spread_join(rows, side, "key", "number", counts=counts)


def counts_of_many(sums: DataFrame) -> DataFrame | None:
    """The rows of each source, where the sources are too many for their table to be broadcast."""
    width = sums.agg(F.sum(F.octet_length("key") + F.lit(64 * (ROUNDS + 1)))).first()[0] or 0
    return None if width <= BROADCAST_BYTES else sums.select("key", "_n")


def digits(h: str, number: str) -> list[Column]:
    """The hash, then the number, as buckets that begin with ever more of their bits."""
    tops = lambda c, bits: [F.shiftright(F.col(c), max(bits - DIGIT * (k + 1), 0)) for k in range(-(-bits // DIGIT))]
    return tops(h, HASH_BITS) + tops(number, NUMBER_BITS)


def after(h: Column, number: Column, from_h: Column, from_number: Column) -> Column:
    return (h > from_h) | ((h == from_h) & (number > from_number))


def threshold(rows: DataFrame, budgets: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """For each key of ``budgets`` (key, budget, from_h, from_number, most): what fits of the rows behind ``from``.

    Returns key, h, number of the first row that would exceed the budget (null if all rows fit) and ``fits``,
    the sum of the sizes before it.  Only rows of a size of 1 to ``most`` count.
    """
    state = budgets.select("*", F.lit(None).cast("long").alias("bucket"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("one"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("number"))
    done = []
    at = digits("h", "number")
    for depth, bucket in enumerate(at):
        names = ["budget", "from_h", "from_number", "most", "below"]
        side = state.select("key", *names, F.col("bucket").alias("last"))
        live = (F.col("size") > 0) & (F.col("size") <= F.col("most")) & after(F.col("h"), F.col("number"), F.col("from_h"), F.col("from_number"))
        if depth:
            same_hash = HASH_BITS // DIGIT
            live = live & (at[depth - 1] == F.col("last"))
            if depth >= same_hash:  # within one hash: the number's digits follow
                side = side.join(state.select("key", F.col("h").alias("at_h")), "key")
                live = live & (F.col("h") == F.col("at_h")) if depth > same_hash else live
        found = beside(rows, side, counts).where(live).groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("h").alias("h"), F.min("number").alias("number"))
        upto = F.sum("n").over(W.partitionBy("key").orderBy("bucket"))
        summed = found.join(side.drop("last"), "key").withColumn("upto", F.col("below") + upto)
        first = summed.where(F.col("upto") > F.col("budget")).groupBy("key").agg(F.min_by(F.struct("bucket", "rows", "h", "number", (F.col("upto") - F.col("n")).alias("below")), "bucket").alias("b"))
        total = summed.groupBy("key").agg(F.max("upto").alias("all"))
        new = cut(side.drop("last", "at_h", "below").join(total, "key").join(first, "key", "left").select("key", "budget", "from_h", "from_number", "most", F.col("b.bucket").alias("bucket"), F.coalesce("b.below", "all").alias("below"), (F.coalesce(F.col("b.rows"), F.lit(1)) == 1).alias("one"), F.when(F.col("b.bucket").isNotNull(), F.col("b.h")).alias("h"), F.when(F.col("b.bucket").isNotNull(), F.col("b.number")).alias("number")), "boundary")
        done.append(new.where("one").select("key", "h", "number", F.col("below").alias("fits")))
        state = new.where("NOT one")
        if state.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def rules(rows: DataFrame, wanted: DataFrame, near: float = NEAR, counts: DataFrame | None = None) -> DataFrame:
    """For each key of ``wanted`` (key, source_size, target): how often all its documents are taken, and once more which.

    Returns key, source_size, target, whole, steps: an array of (from_h, from_number, h, number, most); a document of
    at most ``most`` words between the two keys is taken once more.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    start = wanted.select("key", "source_size", "target", whole.alias("whole")).withColumn("budget", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long"))
    kept = cut(start.select("*", F.array().cast("array<struct<from_h:bigint,from_number:bigint,h:bigint,number:bigint,most:bigint>>").alias("steps"), F.lit(-1).cast("long").alias("from_h"), F.lit(-1).cast("long").alias("from_number"), F.lit(False).alias("ended")), "mix")
    for _ in range(ROUNDS):
        open_ = (~F.col("ended")) & (F.col("budget") > 0) & (F.col("budget") >= near * F.col("target"))
        asked = kept.where(open_).select("key", "budget", "from_h", "from_number", F.col("budget").alias("most"))
        if asked.isEmpty():
            break
        found = threshold(rows, asked, counts).select("key", F.col("h").alias("to_h"), F.col("number").alias("to_number"), "fits")
        step = F.struct("from_h", "from_number", F.col("to_h").alias("h"), F.col("to_number").alias("number"), F.col("budget").alias("most"))
        hit = F.col("fits").isNotNull()
        next_ = kept.join(found, "key", "left").select(
            "key", "source_size", "target", "whole",
            F.when(hit, F.col("budget") - F.col("fits")).otherwise(F.col("budget")).alias("budget"),
            F.when(hit & (F.col("fits") > 0), F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"),
            F.coalesce("to_h", "from_h").alias("from_h"), F.coalesce("to_number", "from_number").alias("from_number"),
            (F.col("ended") | F.col("to_h").isNull()).alias("ended"),
        )
        new = cut(next_, "mix")
        discard(kept)
        kept = new
    return kept.select("key", "source_size", "target", "whole", "steps")


def copies(size: Column, h: Column, number: Column, whole: Column, steps: Column) -> Column:
    """How often a document is taken."""
    inside = lambda s: (size <= s["most"]) & after(h, number, s["from_h"], s["from_number"]) & (s["h"].isNull() | after(s["h"], s["number"], h, number))
    return F.when(size > 0, whole + F.exists(steps, inside).cast("int")).otherwise(0)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, near: float = NEAR, carry: list[str] | None = None) -> DataFrame:
    """row (the columns ``carry`` of ``docs``, all without it), size, source_size, target, copies: how often the mix takes it."""
    rows = sized(docs, carry)
    sums = cut(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")), "sums")
    wanted = cut(targets(sums.select("key", "source_size"), weights, share, most), "targets")
    many = counts_of_many(sums)
    taken = beside(rows, rules(rows, wanted, near, many), many)
    return taken.select("row", "size", "source_size", "target", copies(F.col("size"), F.col("h"), F.col("number"), F.col("whole"), F.col("steps")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    taken = mixed(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixed(pick(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source"), carry=["doc_id"])
    return taken.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
