"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document.  Their votes make at most
3^11 patterns; the counts of the patterns over all documents are all that expectation-maximisation
needs to estimate the share of good documents and how each labeller votes on either kind.  The posterior
of a pattern labels documents, and on a bounded sample of them (about ``SAMPLE`` different rows, by a
64-bit hash, at most twice as many) a logistic scorer over hashed words and word shapes is trained.  The scorer then judges every document.

Defined results: a null text is the empty text; a text without words scores 0 and is rejected; if no
documents exist the scorer is even and no rows come out; repeated rows score alike; a score of exactly
``KEEP`` is kept; very long texts are read whole, within one row; all columns pass, but for input
columns named quality_score or kept, in whose place the operator's own come.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, hash_below, held, others, pick, read_table, text_or_empty

#: About so many documents train the scorer.
SAMPLE = 4000
DIMENSIONS = 1 << 18
KEEP = 0.5
SPACES = r"[ \t-\r]+"
#: Densities mean little in shorter texts; the labellers of densities then abstain.
FEW_WORDS = 8

# Common function words of the languages looked at.
FUNCTION_WORDS = (
    "the of and to in is it that for with as was be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no"
    " le la les de des du un une et est en que qui dans pour par sur pas au aux avec ce il elle ne se plus ou son sa ses"
    " der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
    " el los las y en del se por con para una su al lo como más pero sus le ya o este sí porque esta son entre cuando muy sin sobre"
).split()

LABELLERS = ("symbols", "capitals", "exclamations", "bars", "function_words", "line_ends", "repeated_lines", "repeated_words", "word_length", "variety", "plain_words")


#: A word in the shapes text: letters within joints, one mark before and one after.
PLAIN = r"(?<!\S)[(\"'«„“]?[aA]+(?:['’-][aA]+)*[,.;:!?)\"'»”]?(?!\S)"


def shapes(text: Column) -> Column:
    """The text with each run of small letters as a, of capitals as A, of digits as 9; words stay apart."""
    return shapes_of_small(small(text))


def small(text: Column) -> Column:
    """The text with each run of small letters as a, a quarter as long."""
    return F.regexp_replace(text, r"\p{Ll}+", "a")


def shapes_of_small(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\p{Lu}+", "A"), r"\p{N}+", "9")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def measures() -> dict[str, Column]:
    """What the labellers look at, each worked out once for a document."""
    text, words, lines, shape = F.col("_text"), F.col("_words"), F.col("_lines"), F.col("_shape")
    n = F.greatest(F.size(words), F.lit(1))
    n_lines = F.greatest(F.size(lines), F.lit(1))
    # marks are counted in the shapes, which are a quarter as long as the text and keep them
    count = lambda marks: (F.length(shape) - F.length(F.regexp_replace(shape, marks, ""))) / n
    # runs of small letters are one letter there: without letters it is what the text is without letters
    letters = F.length(text) - F.length(F.regexp_replace("_small", r"\p{L}+", ""))
    capitals = F.length("_small") - F.length(F.regexp_replace("_small", r"\p{Lu}+", ""))
    return {
        "symbols": count(r"[#*$%&<>{}\\]+"),
        "exclamations": count("!+"),
        "bars": count(r"\|+"),
        "capitals": F.when(letters > 0, capitals / letters),
        "plain_words": F.regexp_count(shape, F.lit(PLAIN)) / n,
        "word_length": F.length(F.array_join(words, "")) / n,
        "function_words": F.size(F.filter("_low", lambda w: w.isin(FUNCTION_WORDS))) / n,
        "line_ends": F.size(F.filter(lines, lambda x: x.rlike(r"[.!?…:;\"'»”)]\s*$"))) / n_lines,
        "repeated_lines": (F.size(lines) - F.size(F.array_distinct(lines))) / n_lines,
        "repeated_words": F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))) / n,
        "variety": F.size(F.array_distinct(words)) / n,
    }


def votes() -> dict[str, Column]:
    """The vote of each labeller on its measure: 1 good, 0 bad, 2 none."""
    m = {k: F.col(f"_m_{k}") for k in LABELLERS}

    def vote(good: Column, bad: Column) -> Column:
        return F.when(F.size("_words") < FEW_WORDS, 2).when(bad, 0).when(good, 1).otherwise(2)

    return {
        "symbols": vote(m["symbols"] < 0.03, m["symbols"] > 0.15),
        "capitals": vote(m["capitals"] < 0.15, m["capitals"] > 0.4),
        "exclamations": vote(m["exclamations"] < 0.03, m["exclamations"] > 0.15),
        "bars": vote(m["bars"] < 0.02, m["bars"] > 0.15),
        "function_words": vote(m["function_words"] > 0.12, m["function_words"] < 0.04),
        "line_ends": vote(m["line_ends"] >= 0.6, m["line_ends"] < 0.2),
        "repeated_lines": vote(m["repeated_lines"] < 0.1, (m["repeated_lines"] > 0.4) & (F.size("_lines") > 3)),
        "repeated_words": vote(m["repeated_words"] < 0.05, m["repeated_words"] > 0.25),
        "word_length": vote(m["word_length"].between(2.5, 9.5), (m["word_length"] < 2) | (m["word_length"] > 14)),
        "variety": vote(m["variety"] > 0.35, m["variety"] < 0.12),
        "plain_words": vote(m["plain_words"] > 0.85, m["plain_words"] < 0.6),
    }


def with_parts(docs: DataFrame) -> DataFrame:
    """Adds _text, _words, _low (the words in small letters), _shape, _lines (those with a word) and the measures."""
    d = docs.withColumn("_text", text_or_empty())
    d = d.withColumns({"_words": words_of(F.col("_text")), "_low": F.transform(words_of(F.col("_text")), F.lower), "_small": small(F.col("_text"))})
    d = d.withColumn("_shape", shapes_of_small(F.col("_small")))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    return d.withColumns({f"_m_{k}": c for k, c in measures().items()})


def pattern() -> Column:
    """The votes as digits, in the order of LABELLERS."""
    v = votes()
    return F.concat(*[v[k].cast("string") for k in LABELLERS])


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> dict:
    """Expectation-maximisation over vote patterns.

    Returns the share of good documents, the vote probabilities [labeller, kind, vote] and the posterior
    of each pattern.  It starts from labellers that rarely fault a good document and fault a bad one now
    and then, since each looks at one defect; pseudo-counts of the same kind keep probabilities off 0.
    """
    k = len(LABELLERS)
    v = np.array([[int(c) for c in p] for p in patterns], dtype=np.int64).reshape(-1, k)
    counts = np.asarray(counts, dtype=float)
    prior = 0.85
    start = np.array([(0.35, 0.65), (0.03, 0.97)])  # of a bad and a good document: votes bad, good
    table = np.repeat(start[None], k, axis=0)
    good = np.full(len(v), prior)
    for _ in range(rounds):
        # an abstention says nothing about either kind
        full = np.log(np.concatenate([table, np.ones((k, 2, 1))], axis=2))
        log = np.stack([np.log(p) + sum(full[j, y, v[:, j]] for j in range(k)) for y, p in ((0, 1 - prior), (1, prior))])
        before, good = good, 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if len(v) and np.abs(good - before).max() < 1e-9:
            break
        prior = float((good @ counts + 17) / (counts.sum() + 20))
        for y, weight in ((0, counts * (1 - good)), (1, counts * good)):
            for j in range(k):
                seen = np.bincount(v[:, j], weights=weight, minlength=3)[:2] + 10 * start[y]
                table[j, y] = seen / seen.sum()
    return {"prior": prior, "table": table, "posterior": dict(zip(patterns, good.tolist()))}


def features() -> Column:
    """Hashed words and word shapes of a document; a word equal to the one before it has a shape of its own."""
    slot = lambda kind, x: F.pmod(F.xxhash64(kind, x), F.lit(DIMENSIONS)).cast("int")
    again = lambda i: F.when(F.get(F.col("_words"), i) == F.get(F.col("_words"), i - 1), 2).otherwise(1)
    return F.concat(F.transform("_low", lambda w: slot(F.lit(0), w)), F.transform("_shapes", lambda s, i: slot(again(i), s)))


def with_shapes(df: DataFrame) -> DataFrame:
    """Adds _shapes, the shape of each of _words."""
    return df.withColumn("_shapes", F.filter(F.split("_shape", SPACES), lambda w: w != ""))


def counted(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """slots, values and row numbers: each row's distinct slots with their share of the row."""
    if not rows:
        return np.empty(0, np.int32), np.empty(0), np.empty(0, np.int32)
    parts = []
    for at, own in enumerate(rows):  # one after another: beside the counts only one row's slots are sorted
        slots, n = np.unique(own, return_counts=True)
        parts.append((slots.astype(np.int32), n / max(len(own), 1), np.full(len(slots), at, np.int32)))
    slots, values, row = map(np.concatenate, zip(*parts))
    return slots, values, row


def train_scorer(rows: list[np.ndarray], target: np.ndarray, rounds: int = 60, rate: float = 4.0) -> np.ndarray:
    """Weights of a logistic scorer (the last is the bias) on soft labels, by full-batch Adagrad; both kinds weigh alike."""
    w = np.zeros(DIMENSIONS + 1)
    if not len(rows):
        return w
    slots, values, row = counted(rows)
    target = np.asarray(target, dtype=float)
    good, bad = max(target.sum(), 1.0), max((1 - target).sum(), 1.0)
    weight = target / good + (1 - target) / bad
    weight /= weight.sum()
    past = np.full(DIMENSIONS + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, weights=w[slots] * values, minlength=len(rows)) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        slope = np.append(np.bincount(slots, weights=error[row] * values, minlength=DIMENSIONS), error.sum())
        past += slope**2
        w -= rate * slope / np.sqrt(past) * 0.25
    return w


def listed(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as they lie in its buffers, so that none of their numbers is a Python object on the driver."""
    found = []
    for chunk in column.chunks:
        ends = chunk.offsets.to_numpy()
        found += np.split(chunk.values.to_numpy(), ends[1:-1]) if len(chunk) else []
    return found


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The label model over all documents and the scorer over the sample."""
    d = with_parts(pick(docs, "doc_id", "text"))
    table = d.groupBy(pattern().alias("pattern")).count().collect()  # at most 3^11 rows
    model = estimate([r["pattern"] for r in table], np.array([r["count"] for r in table]))
    total = max(sum(r["count"] for r in table), 1)
    # equal rows have one hash and are learned from once; the limit binds even a sample that chance made large
    chosen = pick(docs, "doc_id", "text").where(hash_below(sample / total, "doc_id", "text", F.lit(7)))
    chosen = chosen.withColumn("h", F.xxhash64("doc_id", "text")).dropDuplicates(["h"]).drop("h").limit(2 * sample)
    rows = with_shapes(with_parts(chosen)).where(F.size("_words") > 0).select(pattern().alias("pattern"), features().alias("slots")).toArrow()
    target = np.array([model["posterior"][p] for p in rows.column("pattern").to_pylist()], dtype=float)
    model["weights"] = train_scorer(listed(rows.column("slots")), target)
    return model


def scored(docs: DataFrame, model: dict, carry: list[str] | None = None) -> DataFrame:
    """``docs``, or only its columns ``carry``, with quality_score (0 to 1) and kept."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model["weights"])  # DIMENSIONS numbers, whatever the corpus

    @F.pandas_udf("double")
    def score(slots: pd.Series) -> pd.Series:
        w = shared.value
        z = np.array([w[x].mean() if len(x) else -np.inf for x in slots]) + w[-1]
        return pd.Series(np.where(np.isinf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -50, 50)))))

    # A filter on the score must stay above it: pushed below, it would split the text anew for every word.
    score = score.asNondeterministic()
    names = others(docs, "quality_score", "kept") if carry is None else carry
    row = F.struct(*[F.col(f"`{n}`") for n in names]).alias("row")
    words = with_shapes(docs.select(row, "text").withColumns({"_words": words_of(text_or_empty()), "_low": F.transform(words_of(text_or_empty()), F.lower), "_shape": shapes(text_or_empty())}))
    out = words.withColumn("_slots", features()).withColumn("_score", score("_slots")).select("row", "_score")
    return out.select(*[F.col(f"row.`{n}`") for n in names], F.col("_score").alias("quality_score"), (F.col("_score") >= KEEP).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return scored(docs, fit(docs), ["doc_id"])


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; columns as they were."""
    whole = held(docs, "text", "doc_id")
    return scored(whole, fit(whole), ["row"]).where("kept").select("row.*")
