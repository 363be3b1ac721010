"""Joins of many rows with one row for each key, where a few keys may hold most of the rows.

Keys with more than 1 / ``MOST`` of all rows are few, at most ``MOST``, whatever the size
of the table: they can be sent to every task. Their rows are dealt out by salts, and the
one row of the other side is copied to each salt. All other keys are joined as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bound on the number of hot keys, and the rows that a key needs at least to be one.
MOST, LEAST = 10_000, 1_000
SALTS = 64
#: Copies of a row that one task makes.
CHUNK = 1 << 16


def hot_keys(counts: DataFrame, key: str, rows: str, total: int | None = None, least: int | None = None) -> DataFrame | None:
    """(key): those of ``counts`` (a row for each key, with its ``rows``, ``total`` in all) that are hot; None without any."""
    if total is None:
        total = counts.agg(F.sum(rows)).first()[0] or 0
    found = counts.where(F.col(rows) > max(LEAST if least is None else least, total / MOST)).select(key)
    some = found.collect()  # MOST keys at most: each has more than 1 / MOST of all rows
    return counts.sparkSession.createDataFrame(some, found.schema) if some else None


def salted_join(rows: DataFrame, single: DataFrame, key: str, hot: DataFrame | None, spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``single``, which has a row for each key. ``spread``: whole numbers by which a hot key's rows are dealt out.

    Neither side may have a null key that has to match.
    """
    if hot is None:
        return rows.join(single, key, how)
    mark = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    left = rows.join(mark, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(spread, F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = single.join(mark, key, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def each_copy(rows: DataFrame, times: str, out: str, many: bool, chunk: int | None = None) -> DataFrame:
    """Each row ``times`` times, ``out`` from 0. With ``many``, rows with more than ``chunk`` copies are dealt out by chunks of them."""
    chunk = CHUNK if chunk is None else chunk
    few = rows.withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    if not many:
        return few
    chunks = rows.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{times}` - 1) div {chunk}"))))
    dealt = chunks.repartition(F.xxhash64(*chunks.columns))
    first = F.col("__chunk") * chunk
    return dealt.withColumn(out, F.explode(F.sequence(first, F.least(first + chunk, F.col(times)) - 1))).drop("__chunk")
