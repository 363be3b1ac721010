"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardinia.sources.scratch import discard, scope
from cardinia.sources.scratch import materialised as written

__all__ = ["SPACES", "WORDS", "discard", "id_text", "lean", "scope", "table", "text_or_empty", "written"]

#: ASCII white space as the contracts name it.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_text(col: str | Column) -> Column:
    """An id as text, '' for null: what the hash orders are made of."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving its memory back to the system when a task ends.

    Spark keeps Python workers for later tasks, and the C library would keep for each
    the most that any task has needed. What a worker has imported before its first task
    stays out of these collections, which would take longer than many a task.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not gc.get_freeze_count():
            gc.freeze()
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped
