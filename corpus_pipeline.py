"""A corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents, so a lost executor never costs more than the stage at hand.

1. quality classifier: documents below the threshold go
2. quality rules: documents that fail go; lines repeated across documents are removed from the rest
3. near-duplicates: the first document of each class stays
4. secret scans: found secrets are masked
5. packing: the documents' tokens are laid into sequences; returns the pieces

Defined results of every stage: a null text is the empty text, which has too few words to pass the quality rules, but
is packed as one end mark where a caller packs it; a null doc_id stays null, and a null source is a source of its
own; repeated rows get one verdict each in stages 1 and 2, are one document to stage 3, of which the first row stays
(of equal texts the one of the least doc_id, null ids last), and are masked and packed row by row in stages 4 and 5; an empty
table gives an empty table; very long texts are read whole; further columns, whatever their names, come out as
they were, until the last stage returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import minhash, packing, quality_classifier, quality_rules, secrets
from tessella.llm.common import cut, discard, read_table, scratch
from tessella.llm.queries import tokenizer


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.ledger(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=packing.added_tokens(tokenizer("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]

#: Posterior labels, signatures and the packing fit have no form in SQL; tests/llm/test_brute_force.py recomputes each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, one after another; what a stage has written besides its result goes when that is there."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(cut(stage(spark, docs, sf_dir), name))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
