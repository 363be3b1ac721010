"""Join sketches of a stream: sums and maxima per cell, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinia.functions.hashing import HashFamily, KeyUse
from cardinia.operators.sketches import cells, residues


def streaming_sketch(stream: DataFrame, keys: tuple[KeyUse, ...], family: HashFamily, depth: int, width: int, signed: bool = True, time_column: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(row, bin, v) of all rows so far; with ``window``, of each window of ``time_column``, closed by a watermark.

    The state is a sketch (depth * width cells), whatever the length of the stream, so
    output mode 'complete' or 'update' is cheap; windows can be appended.
    """
    keep = []
    if window is not None:
        stream = stream.withWatermark(time_column, late)
        keep = [F.window(time_column, window).alias("window")]
    rows = residues(stream, keys, [*keep, F.lit(1).cast("long").alias("_n")])
    by = ["window"] if window is not None else []
    placed = cells(rows, keys, family, depth, width, "own" if signed else "none", [*by, "_n"])
    v = F.sum(F.col("sign") * F.col("_n")) if signed else F.sum("_n")
    return placed.groupBy(*by, "row", "bin").agg(v.alias("v"))
