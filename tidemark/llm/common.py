"""Small helpers that the operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than ASCII white space. Fixed by the contracts of the queries.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: spark.checkpoint.dir.

    Where that setting is absent and the master is local (tests), a temporary folder is made once per session, for as long as Python runs.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder (in folders by the values of a column): cuts lineage, survives lost executors, is computed once.

    The shuffle files behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


class Tables:
    """Written tables of one call, which are deleted at its end; what the call returns must be written outside of them."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def __enter__(self) -> Tables:
        return self

    def written(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        self.held.append(written(df, name, by))
        return self.held[-1]

    def __exit__(self, *_) -> None:
        while self.held:
            removed(self.held.pop())


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that written() made."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession, n_bytes: int = 0, most_bytes: int = 64 << 20) -> int:
    """Number of partitions for a shuffle that an operator deals out by hand: spark.sql.shuffle.partitions, or more for more bytes."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // most_bytes))


def text_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts: one aggregate that reads no other column."""
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id written as text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices (without copying) of at most `rows` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def release() -> None:
    """Gives memory that a task no longer needs back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
