"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees (``spark.checkpoint.dir``).

    Where none is set, a local master gets a temporary one; on a cluster that is an error, since a folder
    of the driver's machine is not the executors'.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_open: list[list[DataFrame]] = []  # what is cut within each scratch


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    if _open:
        _open[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Whatever is cut within is deleted at the end, but for the frames given to the function it yields.

    What stays must not depend on what goes: it is cut itself.
    """
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _open.append(made)
    try:
        yield keep
    finally:
        _open.pop()
        paths = {getattr(df, "_tessella_path", None) for df in kept}
        discard(*[df for df in made if df._tessella_path not in paths])
        if _open:
            _open[-1] += [df for df in made if df._tessella_path in paths]


def discard(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for the given frames, once nothing that is still read depends on them."""
    for df in frames:
        path = getattr(df, "_tessella_path", None)
        if path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
