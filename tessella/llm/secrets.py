"""Secret scans with an incremental blob ledger.

Each text is a version of a path (its document) and is addressed by the SHA-256 of its content.  The
ledger is a Parquet table of (blob, rule_version, findings), partitioned by the rule version.  A scan
takes the blobs of the given versions that have no entry under the present rule version, scans one copy
of each, appends the findings and joins them back to every path that holds the blob.  A blob of many
paths is dealt out for that join.

Defined results: a null text is the empty text; equal texts share one scan, whatever their number;
repeated rows come out as often as they occur; spans that begin together are in the order of their kinds;
a very long text is scanned whole, in one row; an empty table gives no rows; other columns of the input
pass by untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, held, lean, matched, pick, read_table, shared_dir, spread_join, text_or_empty, with_text

# The rules.  Base kinds first, in their order; (kind, pattern, group measured, least length).
BASE_RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    ("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", 0, 27),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("vcs", r"(?:gh[pousr]_|glpat-)[A-Za-z0-9_-]{20,}", 0, 24),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=-]{20,}", 0, 27),
    ("url", r"(?i:[a-z][a-z0-9+.-]{1,15})://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", 0, 12),
)
KINDS = [r[0] for r in (*BASE_RULES, *MORE_RULES)]

#: Derived from the rules: when one changes, the ledger has no entries of the new version and blobs are scanned anew.
RULE_VERSION = hashlib.sha256(repr((BASE_RULES, MORE_RULES)).encode()).hexdigest()[:16]

FINDING = "struct<kind:string,start:int,end:int>"


class Scanner:
    """All spans of a text as (start, kind index, end), in order."""

    def __init__(self):
        # Runs of 16 or more are the only hex runs kept, and a run always starts where none precedes it.
        quick = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}
        self.rules = [(k, re.compile(quick.get(kind, p), re.A), g, n) for k, (kind, p, g, n) in enumerate((*BASE_RULES, *MORE_RULES))]
        # Literals without which a rule can't match; they are looked for first.
        self.needs = {"access": ("AKIA",), "pem": ("-----BEGIN ",), "jwt": ("eyJ",), "vcs": ("gh", "glpat-"), "chat": ("xox",), "url": ("://",)}
        self.words = {"assign": ("pass", "secret", "token", "api"), "bearer": ("bearer",)}

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found, folded = [], text.lower()
        for k, rule, group, least in self.rules:
            kind = KINDS[k]
            if kind in self.needs and not any(x in text for x in self.needs[kind]):
                continue
            if kind in self.words and not any(x in folded for x in self.words[kind]):
                continue
            for m in rule.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append((m.start(), k, m.end()))
        return sorted(found)


def blobs(docs: DataFrame) -> DataFrame:
    """doc_id and blob (SHA-256 of the UTF-8 text) of every version."""
    return docs.select("doc_id", F.sha2(text_or_empty(), 256).alias("blob"))


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; an empty one is written there first if it has none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    schema = f"blob string, rule_version string, findings array<{FINDING}>"
    if not store.exists(folder):
        spark.createDataFrame([], schema).write.partitionBy("rule_version").parquet(path)
    return spark.read.schema(schema).parquet(path)


def scan_blobs(texts: DataFrame, rule_version: str) -> DataFrame:
    """blob, rule_version, findings of each (blob, text)."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner.spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rule_version] * len(found), pa.string()), pa.array(found, kind)], names=["blob", "rule_version", "findings"])

    return texts.select("blob", "text").mapInArrow(lean(run), f"blob string, rule_version string, findings array<{FINDING}>")


def update(docs: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Bring the ledger at ``ledger_path`` up to date with the texts of ``docs``; returns its (blob, findings) of the rule version."""
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text")
    known = open_ledger(spark, ledger_path).where(F.col("rule_version") == rule_version).select("blob")
    # One path stands for each unseen blob.  Only ids and hashes are shuffled to choose it, and counts combine map-side.
    unseen = blobs(docs).groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(known, "blob", "left_anti")
    # A repeated row of one id is scanned as often as it is repeated; the ledger keeps one entry.
    texts = docs.select("doc_id", F.sha2(text_or_empty(), 256).alias("blob"), text_or_empty().alias("text"))
    texts = matched(texts, unseen, ["blob", "doc_id"], "left_semi")
    scan_blobs(texts, rule_version).dropDuplicates(["blob"]).write.mode("append").partitionBy("rule_version").parquet(ledger_path)
    return open_ledger(spark, ledger_path).where(F.col("rule_version") == rule_version).groupBy("blob").agg(F.first("findings").alias("findings"))


def scan(docs: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """doc_id, blob, findings of every version; the ledger at ``ledger_path`` is brought up to date first."""
    entries = update(docs, ledger_path, rule_version)
    return spread_join(blobs(pick(docs, "doc_id", "text")), entries, "blob", "doc_id").select("doc_id", "blob", "findings")


#: The setting that names a standing ledger; runs then scan only what none of their predecessors has seen.
LEDGER_SETTING = "tessella.secrets.ledger"


def ledger(spark: SparkSession) -> str:
    """The session's standing ledger, or a new one in the shared folder where none is set."""
    return spark.conf.get(LEDGER_SETTING, None) or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def redact(docs: DataFrame, ledger_path: str, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask`` (overlapping spans as one); columns as they were."""
    bounded_batches(docs.sparkSession)
    entries = update(docs, ledger_path).where(F.size("findings") > 0)

    @F.pandas_udf("string")
    def hide(texts, founds):
        import pandas as pd

        out = []
        for text, found in zip(texts, founds):
            if found is None or text is None:
                out.append(text)
                continue
            parts, at, upto = [], 0, -1
            for f in sorted(found, key=lambda f: (f["start"], f["end"])):
                if f["start"] > upto:
                    if upto >= 0:
                        at = upto
                    parts += [text[at : f["start"]], mask]
                upto = max(upto, f["end"])
            parts.append(text[upto:] if upto >= 0 else text)
            out.append("".join(parts))
        return pd.Series(out, dtype=object)

    whole = held(docs, "doc_id", "text").withColumn("blob", F.sha2(text_or_empty(), 256))
    marked = spread_join(whole, entries, "blob", "doc_id", "left")
    return with_text(marked, docs, F.when(F.col("findings").isNotNull(), hide("text", "findings")).otherwise(F.col("text")))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def digest(scanned: DataFrame) -> DataFrame:
    """The result columns of the query from (doc_id, findings)."""
    text = lambda xs: F.array_join(F.transform(xs, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    base = F.filter("findings", lambda f: f["kind"].isin([r[0] for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(cut(scan(read_table(spark, sf_dir, "documents"), ledger(spark)), "findings"))


def brute_force(text: str | None) -> list[tuple[int, int, int]]:
    """Spans of the base rules straight from their definition, for tests."""
    out = []
    for k, (_, p, g, n) in enumerate(BASE_RULES):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "", re.A) if len(m[g]) >= n]
    return sorted(out)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
