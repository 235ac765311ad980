"""Quality rules: base counts of a document, and cross-document line frequency.

Lines are normalised (lower case, runs of white space as one space, runs of digits as 0) and hashed.
For each host the distinct documents of every line are counted.  A line is frequent, and removed,
when more than ``MAX_DOCS`` different texts of one host hold it; copies of one text count once, so
that they don't make their own text frequent.  A document is rejected when what is removed exceeds
``DEPLETED`` of its words, or when it fails the base rule.

Everything is built of DataFrame functions.  Positions and hashes are packed in one long, so that
repeated word windows are found by sorting primitive arrays within a row and no word is shuffled.

Defined results: a null text has no words and fails the base rule; a null host is a host of its own;
repeated rows get the same verdict each and count as one document; a line in exactly ``MAX_DOCS`` texts
stays, and so does a document that loses exactly ``DEPLETED`` per cent of its words; positions are packed
in 27 bits, and a row can't hold more words, at 16 bytes each in its 2 GB; an empty table gives no rows;
other columns pass unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held, matched, pick, read_table, spread_join, text_or_empty, with_text

#: A line in more distinct documents of one host is frequent.
MAX_DOCS = 20
#: A document that loses more than this part of its words, in per cent, is depleted; at exactly so many it stays.
DEPLETED = 70
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words

# White space between words, and the symbols counted.
SPACES = r"[ \t-\r]+"
SYMBOLS = "[#*$%&|<>]+"

WINDOW = 3
PLACE_BITS = 27
PLACE_MASK = (1 << PLACE_BITS) - 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^ \t-\r]")


def normalised(line: Column) -> Column:
    folded = F.regexp_replace(F.lower(line), SPACES, " ")
    return F.regexp_replace(F.trim(folded), "[0-9]+", "0")


def line_hash(line: Column) -> Column:
    """The first 60 bits of the MD5 of the normalised line."""
    return F.conv(F.substring(F.md5(normalised(line)), 1, 15), 16, 10).cast("long")


def packed_windows(words: str) -> Column:
    """For each window of three words its hash, with the position in the low bits, sorted."""
    at = lambda i: F.get(F.col(words), i)
    pack = lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(F.lit(~PLACE_MASK)).bitwiseOR(i.cast("long"))
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    return F.when(F.size(words) >= WINDOW, F.sort_array(F.transform(starts, pack))).otherwise(F.array().cast("array<long>"))


def repeated_starts(words: str, packed: str) -> Column:
    """Positions of windows that have an equal one, in order.  Equal hashes are checked word by word.

    Windows of equal packed hashes but different words could part two equal ones in the sort.  A text with
    such windows, one in thousands of millions, is sorted by its whole hashes instead.
    """
    place = lambda v: v.bitwiseAND(F.lit(PLACE_MASK)).cast("int")

    def alike(x: Column, y: Column) -> Column:
        return F.coalesce(F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0, F.lit(False))

    def same_words(x: Column, y: Column) -> Column:
        i, j = place(x), place(y)
        same = F.get(F.col(words), i) == F.get(F.col(words), j)
        for k in range(1, WINDOW):
            same = same & (F.get(F.col(words), i + k) == F.get(F.col(words), j + k))
        return F.coalesce(same, F.lit(False))

    equal = lambda x, y: alike(x, y) & same_words(x, y)
    at = lambda k: F.get(F.col(packed), k)
    found = F.filter(packed, lambda x, k: equal(x, at(k - 1)) | equal(x, at(k + 1)))
    plain = F.transform(found, lambda x: x.bitwiseAND(F.lit(PLACE_MASK)))
    collided = F.exists(F.transform(packed, lambda x, k: alike(x, at(k + 1)) & ~same_words(x, at(k + 1))), lambda c: c)
    return F.sort_array(F.when(collided, repeated_by_words(words)).otherwise(plain))


def repeated_by_words(words: str) -> Column:
    """The same positions by a sort of the windows themselves."""
    word = lambda i: F.get(F.col(words), i)
    window = lambda i: F.struct(F.array(*(word(i + k) for k in range(WINDOW))).alias("w"), i.cast("long").alias("i"))
    ordered = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), window))
    # a transform over a one-element array binds the sorted windows once
    found = F.transform(F.array(ordered), lambda o: F.filter(o, lambda x, k: F.coalesce(x["w"] == F.get(o, k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(o, k + 1)["w"], F.lit(False))))
    return F.transform(F.element_at(found, 1), lambda x: x["i"])


def covered(starts: str) -> Column:
    """Words in the windows that begin at the given positions."""
    step = F.transform(starts, lambda x, k: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(F.col(starts), k + 1) - x, F.lit(WINDOW).cast("long"))))
    return F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x)


def base(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, host, the base counts, and the lines with a word as (hash, words)."""
    host = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    d = docs.select("doc_id", host.alias("host"), text_or_empty().alias("text"))
    d = d.withColumn("words", words_of(F.col("text")))
    d = d.withColumn("packed", packed_windows("words"))
    d = d.withColumn("starts", repeated_starts("words", "packed"))
    d = d.withColumn("own_lines", F.filter(F.split("text", "\n", -1), has_word))
    lines = F.transform("own_lines", lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).alias("n")))
    return d.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("own_lines") - F.size(F.array_distinct("own_lines"))).cast("long").alias("n_dup_lines"),
        covered("starts").alias("n_repeat_words"),
        lines.alias("lines"),
    )


#: So many frequent lines at most are broadcast, of about 60 bytes each; more are joined with hot ones dealt out.
BROADCAST_LINES = 100_000


def own_lines(counted: DataFrame) -> DataFrame:
    """doc_id, text_hash, and a key of host and hash for each different line."""
    host = F.coalesce(F.concat(F.lit("="), "host"), F.lit("~"))
    return counted.select("doc_id", "text_hash", host.alias("host"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).select("doc_id", "text_hash", "h", F.concat_ws(" ", "h", "host").alias("key"))


def frequent_lines(counted: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """key and _n (rows that hold it) of the lines to remove.

    Rows are first counted by text as well, so one line in a third of all documents meets
    map-side combined and spread.
    """
    texts = own_lines(counted).groupBy("key", "text_hash").agg(F.count("*").alias("_n"))
    return texts.groupBy("key").agg(F.count("*").alias("docs"), F.sum("_n").alias("_n")).where(F.col("docs") > max_docs).select("key", "_n")


def removals(counted: DataFrame, frequent: DataFrame) -> DataFrame:
    """doc_id, text_hash, removed: the hashes of frequent lines in each document that has any."""
    own = own_lines(counted)
    if frequent.count() <= BROADCAST_LINES:
        hit = own.join(F.broadcast(frequent.select("key")), "key", "left_semi")
    else:
        total = counted.agg(F.sum(F.size("lines"))).first()[0] or 0
        hit = spread_join(own, frequent.select("key"), "key", "text_hash", "left_semi", counts=frequent, total=total)
    return hit.groupBy("doc_id", "text_hash").agg(F.collect_set("h").alias("removed"))


def judged(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The base counts with base_failed, words_left, removed (line hashes) and kept, one row per row of ``docs``."""
    names = [n for n in ("doc_id", "text", "source") if n in docs.columns]
    counted = cut(base(pick(docs, *names)), "lines")
    distinct = counted.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", "host", "lines")
    gone = removals(distinct, cut(frequent_lines(distinct, max_docs), "frequent"))
    joined = matched(counted, gone, ["doc_id", "text_hash"], "left")
    kept_lines = F.filter("lines", lambda x: ~F.array_contains(F.col("removed"), x["h"]))
    left = F.when(F.col("removed").isNull(), F.col("n_words")).otherwise(F.aggregate(kept_lines, F.lit(0).cast("long"), lambda s, x: s + x["n"]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = joined.withColumn("words_left", left).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("words_left") >= (100 - DEPLETED) * F.col("n_words")))


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "documents")).select(*RESULT)


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` without its frequent lines and without the documents that are rejected; columns as they were."""
    verdict = judged(docs).where("kept").select("doc_id", "text_hash", "removed").dropDuplicates(["doc_id", "text_hash"])
    d = matched(held(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64(text_or_empty())), verdict, ["doc_id", "text_hash"])
    cleaned = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~has_word(x) | ~F.array_contains(F.col("removed"), line_hash(x))), "\n")
    return with_text(d, docs, F.when(F.col("removed").isNull(), F.col("text")).otherwise(cleaned))
