"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, discard, scope, shared_dir  # noqa: F401

#: ASCII white space, as a Java and RE2 character class.
SPACE = r"[\x09-\x0D\x20]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def arrow_rows(df: DataFrame, most: int = 1024) -> DataFrame:
    """``df``, its session set to send Python at most ``most`` rows in one Arrow batch: texts are
    long, and such buffers are memory beside the heap. Operators gather batches to blocks by bytes."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) > most or int(conf.get(name)) <= 0:
        conf.set(name, most)
    return df


def release() -> None:
    """Give freed memory back. Python workers outlive their tasks, and later ones share the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes, one row at least."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                kept.append(batch.slice(start, i - start))
                yield pa.concat_batches(kept)
                kept, start, size = [], i, 0
            size += n
        kept.append(batch.slice(start))
    if sum(b.num_rows for b in kept):
        yield pa.concat_batches(kept)
    kept.clear()
    release()
