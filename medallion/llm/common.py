"""Helpers the operators share: columns, batches of bounded size, shared files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextvars import ContextVar
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medallion.plans.registry import table
from medallion.session import checkpoint_root, work_path

__all__ = ["Scratch", "checkpoint_root", "fresh", "filesystem", "groups", "table", "text_of", "work_path", "written"]

#: Texts are handled in groups of about so many characters, whatever an Arrow batch holds.
GROUP_CHARS = 4_000_000


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column; null is the empty text."""
    return F.coalesce(df[f"`{column}`"], F.lit(""))


class Scratch:
    """The work tables that ``written`` makes while it is open, to be deleted once nothing reads them.

    Each thread has its own: what other threads write meanwhile is theirs.
    """

    _open: ContextVar[Scratch | None] = ContextVar("open_scratch", default=None)

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        self._token = Scratch._open.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        Scratch._open.reset(self._token)
        if outer := Scratch._open.get():  # what is left is the outer one's
            outer.paths += self.paths

    def drop(self, spark: SparkSession, *still_read: DataFrame) -> None:
        """Delete the tables but those that ``still_read`` (frames as ``written`` returned them) hold."""
        kept = [f for df in still_read for f in df.inputFiles()]
        left = []
        for path in self.paths:
            if any(f"/{path.rpartition('/')[2]}/" in f for f in kept):  # a folder's name is its own
                left.append(path)
                continue
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        self.paths = left


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back: no executor loss makes it run again."""
    path = work_path(df.sparkSession, name)
    if scratch := Scratch._open.get():
        scratch.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name`` with as many underscores in front as keep it apart from the columns ``taken`` (case ignored)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow file system and path of a folder that all executors share."""
    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file://").removeprefix("file:")


def groups(batch: pa.RecordBatch, text: str, limit: int = GROUP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` characters; a longer text is alone."""
    sizes = pc.binary_length(batch.column(text)).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < len(sizes):
        yield batch.slice(start)


def frame(spark: SparkSession, rows: list[tuple[Any, ...]], schema: str) -> DataFrame:
    """A small frame of rows known to the driver."""
    return spark.createDataFrame(rows, schema)
