"""Expressions that also write what they come by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rpn, sky
from ..sources import registry
from .lineage import cut


def evaluate(df: DataFrame, tokens: str | list[str], folder: str, carry: Sequence[str] = (), wcs: sky.TangentPlane | None = None) -> DataFrame:
    """``carry`` and ARITH_1, ARITH_2 .. of what the tokens leave on the stack, with files written on the way.

    tofile-NAME and tofilefree-NAME write ``carry`` and the value at that point to NAME in ``folder``, in the format
    of its suffix.  The expression is worked out once: results and files come from one written table, so that tasks
    that run again, or values drawn at random, can't make them differ.  A file that is there already is an error
    before anything is written.
    """
    files: dict = {}
    results = rpn.evaluate(df, tokens, wcs, files)
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    for name in files:
        path = hadoop(f"{folder}/{name}")
        if path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(path):
            raise ValueError(f"{folder}/{name} is there already")
    kept = [F.col(f"`{c}`") for c in carry]
    outs = [c.alias(f"ARITH_{k}") for k, c in enumerate(results, 1)]
    whole = cut(df.select(*kept, *outs, *[c.alias(f"_file_{k}") for k, c in enumerate(files.values())]), "evaluated")
    for k, name in enumerate(files):
        registry.write(whole.select(*kept, F.col(f"_file_{k}").alias("value")), f"{folder}/{name}")
    return whole.select(*kept, *[f"ARITH_{k}" for k in range(1, len(outs) + 1)])
