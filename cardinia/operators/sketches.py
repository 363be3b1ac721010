"""Join sketches as aggregations in the sparse form (row, bin, v).

Linear sketches (tug-of-war, count sketch, count-min) go straight from rows to cells:
partial aggregation leaves at most depth * width cells per task, so the shuffle does
not grow with the number of keys. Degree sketches need the frequency of each key, hence
one grouping by the keys before the maximum of each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinia.functions.hashing import HashFamily, KeyUse, encoded, residue, tuple_bin, tuple_negative, tuple_sign

DEPTH, WIDTH = 5, 100_000
METHODS = ("ams", "count-sketch", "count-min", "bound-sketch", "same-sign")


def distinct_rows(df: DataFrame, columns: list[str], count: str = "count") -> DataFrame:
    """Distinct rows with their multiplicity; NULLs are values here."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(count))


def regrouped(distinct: DataFrame, columns: list[str], count: str = "count") -> DataFrame:
    """Frequencies of fewer columns from distinct rows with counts."""
    return distinct.groupBy(*columns).agg(F.sum(count).alias(count))


def column_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    one = [F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.count_distinct(c).alias("distinct")) for c in columns]
    return df.agg(F.array(*one).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def residues(df: DataFrame, keys: tuple[KeyUse, ...], keep: list[Column] | None = None) -> DataFrame:
    """The keys' residues, of rows whose keys are all there (a NULL key joins with nothing)."""
    for k in keys:
        df = df.where(F.col(k.column).isNotNull())
    return df.select(*[F.expr(residue(encoded(f"`{k.column}`", k.kind))).alias(k.residue_name) for k in keys], *(keep or []))


def cells(rows: DataFrame, keys: tuple[KeyUse, ...], family: HashFamily, depth: int, width: int, signs: str = "none", keep: list[str] | None = None) -> DataFrame:
    """One row for each input row and sketch row: row, bin, and sign, or sign and negative."""

    def cell(r: int) -> Column:
        out = [F.lit(r).alias("row"), F.expr(tuple_bin(keys, family, r, width)).cast("int").alias("bin")]
        if signs != "none":
            out.append(F.expr(tuple_sign(keys, family, r, signs == "shared")).cast("long").alias("sign"))
        if signs == "shared":
            out.append(F.expr(tuple_negative(keys, family, r)).cast("long").alias("negative"))
        return F.struct(*out)

    return rows.select(*(keep or []), F.explode(F.array(*[cell(r) for r in range(depth)])).alias("s")).select(*(keep or []), "s.*")


def sketch(
    df: DataFrame,
    keys: tuple[KeyUse, ...],
    family: HashFamily,
    method: str = "count-sketch",
    depth: int = DEPTH,
    width: int = WIDTH,
    where: Column | str | None = None,
    by: list[str] | None = None,
    count: str | None = None,
) -> DataFrame:
    """(row, bin, v), and for same-sign ``neg``; with ``by``, one sketch for each of its values.

    method: 'ams' and 'count-sketch' sum signs, 'count-min' counts, 'bound-sketch' takes
    the largest frequency of a key tuple in the bin. ``count``: a column of multiplicities.
    """
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    if method == "ams" or (method == "count-sketch" and width == 1):
        method, width = "count-sketch", 1
    by = by or []
    if where is not None:
        df = df.where(where)
    times = F.col(count) if count else F.lit(1)
    rows = residues(df, keys, [*[F.col(b) for b in by], times.cast("long").alias("_n")])
    names = [k.residue_name for k in keys]
    if method == "bound-sketch":
        frequent = rows.groupBy(*by, *names).agg(F.sum("_n").alias("_n"))
        return cells(frequent, keys, family, depth, width, keep=[*by, "_n"]).groupBy(*by, "row", "bin").agg(F.max("_n").alias("v"))
    if method == "count-min":
        return cells(rows, keys, family, depth, width, keep=[*by, "_n"]).groupBy(*by, "row", "bin").agg(F.sum("_n").alias("v"))
    signed = cells(rows, keys, family, depth, width, "shared" if method == "same-sign" else "own", [*by, "_n"])
    aggs = [F.sum(F.col("sign") * F.col("_n")).alias("v")]
    if method == "same-sign":
        aggs.append(F.sum(F.col("negative") * F.col("_n")).alias("neg"))
    return signed.groupBy(*by, "row", "bin").agg(*aggs)


def memory_report(sketches: dict[str, DataFrame]) -> DataFrame:
    """Name, non-zero cells and bytes (16 a cell) of each sketch."""
    out = None
    for name, s in sketches.items():
        one = s.agg(F.count(F.lit(1)).alias("cells")).select(F.lit(name).alias("sketch"), "cells", (F.col("cells") * 16).alias("bytes"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no sketches")
    return out
