"""Order MinHash fingerprints.

A text's k-mers are its runs of five words, each numbered by how often it occurred before.  One hash
deals them into ``GROUPS`` groups, and each group makes a tuple of its two k-mers of least hash, put back into the order in
which the text has them, and hashed.  A group without two of its own borrows the least k-mers of other groups, which it
asks in an order of its own, so that texts of a few hundred words or less keep their order too.  Two texts agree in a
tuple only if they share the k-mers and their order, so the share of agreeing tuples follows edit distance.

Only DataFrame functions are used.  Hash and position are packed in one long, so that the selection is
a sort of primitive arrays within a row; occurrence numbers are found by binary search in the sorted
array.  No word is ever shuffled.

Defined results: a null text is the empty text; a text of fewer than five words has one k-mer of all
its words, one without words has the empty fingerprint; two empty fingerprints are alike (1), an empty
and another are not (0); equal texts have equal fingerprints.  Rows of one doc_id follow one another by
the hash of their text; ids that aren't integers are ordered as texts; positions are packed in 27 bits, and
a row can't hold more words, at 16 bytes each in its 2 GB; an empty table gives no rows; other columns pass unread.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, read_table, text_or_empty

K = 5
TUPLE = 2
GROUP_BITS = 6
GROUPS = 1 << GROUP_BITS
PLACE_BITS = 27
PLACE_MASK = (1 << PLACE_BITS) - 1
#: Steps of the binary search for the start of a run of equal k-mers.
STEPS = [1 << b for b in range(PLACE_BITS - 1, -1, -1)]
SPACES = r"[ \t-\r]+"


def turns_of(g: int) -> list[int]:
    """When the group ``g`` asks each group for a k-mer: itself first, the others in an order drawn by a hash."""
    order = sorted(range(GROUPS), key=lambda d: (d != g, hashlib.md5(f"{g}, {d}".encode()).digest()))
    return [order.index(d) for d in range(GROUPS)]


TURNS = [turns_of(g) for g in range(GROUPS)]


def _high(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array<long>, for each tuple its number and a 32-bit hash, sorted; empty for a text without words."""
    w, a, b, c = (f"_{out}_{x}" for x in ("words", "kmers", "numbered", "chosen"))
    df = df.withColumn(w, F.filter(F.split(F.col(text), SPACES), lambda x: x != ""))
    at = lambda i: F.get(F.col(w), i)
    pack = lambda h, i: h.bitwiseAND(F.lit(~PLACE_MASK)).bitwiseOR(i)
    kmer = lambda i: pack(F.xxhash64(*(at(i + j) for j in range(K))), i.cast("long"))
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - K, F.lit(0)))
    df = df.withColumn(a, F.when(F.size(w) > 0, F.sort_array(F.transform(starts, kmer))).otherwise(F.array().cast("array<long>")))

    same = lambda x, k: F.coalesce(_high(F.get(F.col(a), k)) == _high(x), F.lit(False))
    steps = F.array(*[F.lit(s) for s in STEPS])

    def numbered(x: Column, k: Column) -> Column:
        first = F.aggregate(steps, k, lambda p, s: F.when((p >= s) & same(x, p - s), p - s).otherwise(p))
        occurrence = F.when(same(x, k - 1), k - first).otherwise(F.lit(0))
        return pack(F.xxhash64(_high(x), occurrence), x.bitwiseAND(F.lit(PLACE_MASK)))

    df = df.withColumn(b, F.sort_array(F.transform(a, numbered)))
    group = lambda x: F.shiftright(x, 64 - GROUP_BITS)
    other = lambda x, k: F.coalesce(group(F.get(F.col(b), k)) != group(x), F.lit(True))
    df = df.withColumn(c, F.filter(b, lambda x, k: other(x, k - TUPLE)))

    def hashed(g: Column, x: Column, y: Column) -> Column:
        """The tuple of the k-mers x and y, y null if there is one only; of place and identity ``_high``."""
        first = x.bitwiseAND(F.lit(PLACE_MASK)) < y.bitwiseAND(F.lit(PLACE_MASK))
        ordered = F.when(first, F.xxhash64(_high(x), _high(y))).otherwise(F.xxhash64(_high(y), _high(x)))
        h = F.when(y.isNull(), F.xxhash64(_high(x))).otherwise(ordered)
        return g.bitwiseAND(F.lit(GROUPS - 1)) * F.lit(1 << 32) + F.shiftrightunsigned(h, 32)

    nth = lambda k: F.get(F.col(c), k)
    begins = lambda x, k: F.coalesce(group(nth(k - 1)) != group(x), F.lit(True)) & F.coalesce(group(nth(k + 1)) == group(x), F.lit(False))
    full = F.filter(F.transform(c, lambda x, k: F.when(begins(x, k), hashed(group(x), x, nth(k + 1)))), lambda x: x.isNotNull())
    df = df.withColumn(f"{c}_full", full)
    numbers = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))

    heads, owners = f"{c}_heads", f"{c}_owners"
    df = df.withColumn(heads, F.filter(c, lambda x, k: F.coalesce(group(nth(k - 1)) != group(x), F.lit(True))))
    df = df.withColumn(owners, F.transform(heads, lambda x: group(x).bitwiseAND(F.lit(GROUPS - 1)).cast("int")))
    turns = F.expr("array(" + ", ".join(f"array({', '.join(map(str, row))})" for row in TURNS) + ")")
    head = lambda o, i: F.get(F.col(heads), F.get(o, F.lit(i)) % 128)

    def filled(g: Column) -> Column:
        """The tuple of a group without two k-mers of its own: the heads of the groups that come first by its turns."""
        first = lambda turn: F.slice(F.sort_array(F.transform(owners, lambda d, k: F.get(turn, d) * 128 + k)), 1, TUPLE)
        return F.element_at(F.transform(F.transform(F.array(F.get(turns, g.cast("int"))), first), lambda o: hashed(g, head(o, 0), head(o, 1))), 1)

    lacking = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(GROUPS - 1).cast("long")), numbers(f"{c}_full"))
    df = df.withColumn(out, F.when(F.size(b) > 0, F.sort_array(F.concat(F.col(f"{c}_full"), F.transform(lacking, filled)))).otherwise(F.array().cast("array<long>")))
    df = df.drop(heads, owners)
    return df.drop(w, a, b, c, f"{c}_full")


def fingerprint(sig: Column) -> Column:
    """The signature as text: ten hexadecimal digits for each tuple."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of agreeing tuples."""
    used = F.greatest(F.size(a), F.size(b))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(used, F.lit(1)))


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, h, next_id, next_h, n_chars): each row's next by descending (doc_id, h); the first follows the last.

    Rows are dealt out by range, so each window holds one range; only the first row of each range meets
    those of the others, and there are as many of these as partitions.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").desc()]
    dealt = cut(ids.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "order")
    own = W.partitionBy("_part").orderBy(*order)
    heads = dealt.groupBy("_part").agg(F.max_by(F.struct("doc_id", "h"), F.struct("doc_id", "h")).alias("head"))
    first = W.orderBy("_part")
    heads = heads.select("_part", F.coalesce(F.lead("head").over(first), F.first("head").over(first.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    follow = F.lead(F.struct("doc_id", "h")).over(own)
    rows = dealt.withColumn("_next", follow).join(F.broadcast(heads), "_part").withColumn("_next", F.coalesce("_next", "after"))
    return rows.select("doc_id", "h", "n_chars", F.col("_next.doc_id").alias("next_id"), F.col("_next.h").alias("next_h"))


#: Stands for a null doc_id in keys, so that joins are on plain equality and keep their partitioning; as text where ids are texts.
NO_ID = -(1 << 63)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, sig, edited_sig, next_sig of every row.

    Texts are shuffled once by their key; the part of a text that its predecessor needs travels once more.
    """
    kind = docs.schema["doc_id"].dataType
    whole = isinstance(kind, T.IntegralType)
    no_id = F.lit(NO_ID) if whole else F.lit(str(NO_ID))
    d = docs.select(F.coalesce(F.col("doc_id").cast("long" if whole else "string"), no_id).alias("doc_id"), text_or_empty().alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    follows = cut(successors(d.select("doc_id", "h", F.length("text").cast("long").alias("n_chars"))), "successors")
    # Repeated rows are equal in key and text: the first stands for all, and each copy is its own row of ``follows``.
    first = F.row_number().over(W.partitionBy("doc_id", "h").orderBy("doc_id", "h"))
    one = signature(d, "text", "sig").withColumn("_copy", first).where("_copy = 1").drop("_copy")
    wanted = follows.groupBy("doc_id", "h", "next_id", "next_h").agg(F.count("*").alias("copies"), F.first("n_chars").alias("n_chars"))
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "copies", "n_chars", F.col("next_id").alias("doc_id"), F.col("next_h").alias("h"))
    sent = wanted.join(one, ["doc_id", "h"])
    sent = sent.select(F.col("_id").alias("doc_id"), F.col("_h").alias("h"), "copies", "n_chars", F.col("sig").alias("next_sig"), F.expr("substring(text, 1, cast(n_chars div 2 as int))").alias("tail"))
    both = one.join(sent, ["doc_id", "h"])
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), "tail")
    doc_id = F.when(F.col("doc_id") != no_id, F.col("doc_id")).cast(kind).alias("doc_id")
    both = signature(both.select(doc_id, "n_chars", "copies", "sig", "next_sig", edited.alias("edited")), "edited", "edited_sig")
    return both.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "_k")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = edited_pairs(read_table(spark, sf_dir, "documents"))
    return p.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
