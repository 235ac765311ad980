"""Language identification by word-first backoff.

A known word scores by its log frequency in each language.  An unseen word is cut into character
n-grams of the greatest length; if none of them is known the next shorter length is tried, down to
single characters.  A document's score per language is the mean over its words.

The model is fitted on a bounded sample: about ``TRAIN_DOCS`` documents of each language, chosen by
a hash of id and text, in plain aggregations over the cluster.  Words, and n-grams that occur at least
``LEAST_COUNT`` times, of this sample reach the driver.

Defined results: a null text, or one without any letter, is ``und`` with score 0; a text whose words
have no known n-gram at all gets the commonest learned language with an even score; without any
learned language everything is ``und``; a null doc_id is neither learned from nor held out; repeated
rows are learned from once and predicted alike; languages that score alike go by their names; a very long
text is read in stretches of about ``STRETCH`` characters, cut between words; an empty table gives no
rows; other columns pass unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, hash_below, lean, pick, read_table

#: About so many documents of each language are learned from.
TRAIN_DOCS = 1000
LONGEST_GRAM = 5
#: n-grams seen less often say little; words are known from once on.
LEAST_COUNT = 2
MEMO = 100_000
#: Very long texts are read in stretches of about so many characters.
STRETCH = 1 << 20

WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: a known language, and not held out."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))


def sampled(rows: DataFrame, per_lang: int = TRAIN_DOCS) -> DataFrame:
    """lang, text of about ``per_lang`` different rows of each language, and never more than twice as many of all.

    A row is taken if the 64-bit hash of its id and text lies below a threshold that its language's count
    sets; equal rows have one hash and are learned from once.
    """
    counts = rows.groupBy("lang").count().collect()
    keep = F.lit(False)
    for r in counts:
        keep = keep | ((F.col("lang") == r["lang"]) & hash_below(per_lang / r["count"], "doc_id", "text"))
    chosen = rows.where(keep).select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).dropDuplicates(["lang", "h"])
    return chosen.select("lang", "text").limit(2 * per_lang * max(len(counts), 1))


def fit(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> dict | None:
    """languages, prior, and the value tables of words and of n-grams by length."""
    rows = sampled(training_rows(pick(docs, "doc_id", "text", "lang")), per_lang)
    word = F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")).alias("gram")
    words = rows.select("lang", word).groupBy("lang", "gram").agg(F.count("*").alias("n")).persist()
    padded = F.concat(F.lit("_"), "gram", F.lit("_"))
    # substring is positional from 1; a word of w characters has w + 3 - k padded n-grams of length k
    grams = words.select("lang", "n", F.explode(F.sequence(F.lit(1), F.lit(LONGEST_GRAM))).alias("k"), padded.alias("p")).where(F.length("p") >= F.col("k"))
    grams = grams.select("lang", "n", "k", F.explode(F.expr("transform(sequence(1, length(p) - k + 1), i -> substring(p, i, k))")).alias("gram")).where("gram <> '_'")
    grams = grams.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    both = words.select("lang", F.lit(0).alias("k"), "gram", "n").unionByName(grams)
    totals = {(r["lang"], r["k"]): r["t"] for r in both.groupBy("lang", "k").agg(F.sum("n").alias("t")).collect()}
    table = both.where((F.col("n") >= LEAST_COUNT) | (F.col("k") == 0)).toPandas()
    words.unpersist()
    langs = sorted({lang for lang, _ in totals})
    if not langs:
        return None
    prior = max(langs, key=lambda g: (totals.get((g, 0), 0), g))
    column = {g: i for i, g in enumerate(langs)}
    table["v"] = -np.log10(table["n"] / np.array([totals[x] for x in zip(table["lang"], table["k"])], dtype=float)) if len(table) else []
    penalty = float(table["v"].max() + 1) if len(table) else 7.0
    index: list[dict[str, int]] = [{} for _ in range(LONGEST_GRAM + 1)]
    for k, gram in zip(table["k"], table["gram"]):
        index[k].setdefault(gram, len(index[k]))
    values = [np.full((len(x), len(langs)), penalty, dtype=np.float32) for x in index]
    for lang, k, gram, v in zip(table["lang"], table["k"], table["gram"], table["v"]):
        values[k][index[k][gram], column[lang]] = v
    return {"langs": langs, "prior": column[prior], "index": index, "values": values}


class Backoff:
    """Scores texts with a fitted model; unseen words are memoised up to a bound."""

    def __init__(self, model: dict, memo: int = MEMO):
        self.m, self.learned, self.memo = model, model["index"][0], memo
        self.width = len(model["langs"])
        self.rows = np.zeros((len(self.learned) + memo, self.width), dtype=np.float32)
        self.rows[: len(self.learned)] = model["values"][0]
        self.other: dict[str, int] = {}

    def unseen(self, word: str) -> np.ndarray | None:
        padded = f"_{word}_"
        for k in range(min(LONGEST_GRAM, len(padded)), 0, -1):
            index = self.m["index"][k]
            hits = [index[g] for i in range(len(padded) - k + 1) if (g := padded[i : i + k]) in index]
            if hits:
                return self.m["values"][k][hits].mean(axis=0)
        return None

    def add(self, word: str) -> int:
        """The row of an unseen word, or -1 without evidence."""
        got = self.unseen(word)
        if got is None:
            self.other[word] = -1
            return -1
        at = len(self.learned) + len(self.other)
        self.rows[at] = got
        self.other[word] = at
        return at

    def total(self, words: list[str]) -> tuple[np.ndarray, int]:
        """The sum of the rows of the words that have any evidence, and their number."""
        at = list(map(self.learned.get, words))
        missing = [j for j, k in enumerate(at) if k is None]
        if missing:
            if len(self.other) + len(missing) > self.memo:
                self.other = {}
            if len(missing) > self.memo:  # more unseen words than the memo holds: one by one
                scores = [v for j in missing if (v := self.unseen(words[j])) is not None]
                at = [k for k in at if k is not None]
                known = self.rows[at].sum(axis=0, dtype=np.float64)
                return known + (np.sum(scores, axis=0, dtype=np.float64) if scores else 0.0), len(at) + len(scores)
            other = self.other.get
            for j in missing:
                k = other(words[j])
                at[j] = self.add(words[j]) if k is None else k
        rows = np.array(at, dtype=np.int64)
        rows = rows[rows >= 0]
        return self.rows[rows].sum(axis=0, dtype=np.float64), len(rows)

    def stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > STRETCH:
            end = re.compile(r"[\W\d_]").search(text, at + STRETCH)
            stop = end.start() if end else len(text)
            yield text[at:stop]
            at = stop
        yield text[at:]

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n, letters = np.zeros(self.width), 0, False
        for part in self.stretches(text or ""):
            words = WORD.findall(part.lower())
            letters = letters or any(c.isalpha() for w in words[:8] for c in w) or any(c.isalpha() for w in words for c in w)
            own, count = self.total(words)
            total, n = total + own, n + count
        if not letters:
            return "und", 0.0
        if not n:
            return self.m["langs"][self.m["prior"]], 1.0 / self.width
        mean = total / n
        best = int(mean.argmin())
        return self.m["langs"][best], float(1 / np.exp(-5.0 * (mean - mean[best])).sum())


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its text alone."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Backoff(shared.value)
        for batch in batches:
            got = [scorer.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
