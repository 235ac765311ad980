"""Shared plumbing of the corpus operators: inputs, lineage cuts and bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, discard, scratch, shared_dir  # noqa: F401  (the operators take them from here)
from ..plans.skew import counted_join, hot_keys, spread_both, spread_join  # noqa: F401

#: Rows in an Arrow batch.  With texts of a few KB a batch stays near 1 MB, and near 30 MB when every text is very long.
BATCH_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the Arrow batches handed to Python small, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lean(run):
    """``run`` over the batches of a task; when it ends, Arrow gives back the memory it keeps for reuse."""

    def freed(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return freed


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash with those of an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def matched(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on ``names`` in which nulls are equal; the columns of ``names`` come from ``left``."""
    other = right.withColumnsRenamed({n: f"__{n}" for n in names})
    same = [left[n].eqNullSafe(other[f"__{n}"]) for n in names]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return left.join(other, on, how).drop(*[f"__{n}" for n in names])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held(df: DataFrame, *names: str) -> DataFrame:
    """``row``, a struct of all columns of ``df``, beside the named ones: further columns may have any names.

    ``row.*`` gives the columns back as they were.
    """
    return df.select(F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("row"), *[F.col(f"`{n}`") for n in names])


def with_text(df: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` from ``row`` of ``df``, with ``text`` in place of theirs and its length in n_chars."""
    new = df.select("row", text.alias("text"))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return new.select(*[own.get(n, F.col(f"row.`{n}`")).alias(n) for n in docs.columns])


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but for those that an operator gives a value of its own."""
    return [n for n in df.columns if n not in names]


def hash_bound(share: float) -> int:
    """The signed 64-bit hash below which about ``share`` (less than 1) of all hashes lie."""
    return int(share * 2**64) - 2**63


def hash_below(share: float, *columns: Column | str) -> Column:
    """True for about ``share`` of all rows: those whose 64-bit hash lies in the lowest part of its range.

    Rows alike in all ``columns`` have one hash, so columns that tell rows apart belong in it.
    """
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*columns) < F.lit(hash_bound(share))
