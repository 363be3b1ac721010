"""Contracting sketches along a join graph, and the estimates that come out.

Within a component (columns that joins equate) sketches multiply bin by bin. Across, a
relation with keys in two components has its key tuples in the sum of their bins, so the
message from one component to the other is a circular cross-correlation: a join on the
sketch row and a sum by the difference of bins, or for wide sketches a product of
Fourier transforms. Sketches have depth * width cells at most; the joins between them
hash on (row, bin), and Spark picks a broadcast when they are small.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinia.plans.query import Query

#: Widths from which correlation goes by Fourier transforms: the relational form makes cells * cells rows.
FFT_WIDTH = 2048
#: Parts that the cells of a sketch row are dealt out in for the relational form.
PARTS = 16
Correlation = Callable[[DataFrame, DataFrame, int], DataFrame]


def product(sketches: list[DataFrame]) -> DataFrame:
    """Bin by bin; a bin that one lacks is 0 in all."""
    out = sketches[0].select("row", "bin", F.col("v").cast("double").alias("v"))
    for s in sketches[1:]:
        out = out.join(s.select("row", "bin", F.col("v").cast("double").alias("w")), ["row", "bin"]).select("row", "bin", (F.col("v") * F.col("w")).alias("v"))
    return out


def correlate(sketch: DataFrame, message: DataFrame, width: int) -> DataFrame:
    """sum over y of sketch[x + y] * message[y], for each x, in exact arithmetic; a row's message is dealt out, its sketch copied to each part."""
    parts = F.sequence(F.lit(0), F.lit(PARTS - 1))
    a = sketch.select("row", F.col("bin").alias("s"), F.col("v").cast("double").alias("a"), F.explode(parts).alias("part"))
    b = message.select("row", F.col("bin").alias("y"), F.col("v").cast("double").alias("b"), F.pmod("bin", F.lit(PARTS)).cast("int").alias("part"))
    x = F.pmod(F.col("s") - F.col("y"), F.lit(width)).cast("int").alias("bin")
    return a.join(b, ["row", "part"]).groupBy("row", x).agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def correlate_fft(sketch: DataFrame, message: DataFrame, width: int) -> DataFrame:
    """The same by Fourier transforms, a task for each sketch row; sums of whole numbers are rounded to whole numbers."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"row": [], "bin": [], "v": []})
        x, y = np.zeros(width), np.zeros(width)
        np.add.at(x, a["bin"].to_numpy(), a["v"].to_numpy())
        np.add.at(y, b["bin"].to_numpy(), b["v"].to_numpy())
        v = np.fft.irfft(np.conj(np.fft.rfft(y)) * np.fft.rfft(x), width) if width > 1 else x * y
        if (x == np.rint(x)).all() and (y == np.rint(y)).all():
            v = np.rint(v)
        at = np.flatnonzero(v)
        return pd.DataFrame({"row": np.full(len(at), a["row"].iloc[0]), "bin": at, "v": v[at]})

    def plain(s: DataFrame) -> DataFrame:
        return s.select("row", "bin", F.col("v").cast("double").alias("v"))

    return plain(sketch).groupBy("row").cogroup(plain(message).groupBy("row")).applyInPandas(run, "row int, bin int, v double")


def contract(query: Query, sketches: dict[str, DataFrame], width: int, correlation: Correlation | None = None) -> DataFrame:
    """(row, v): the join size that each sketch row estimates. Rows that sum to nothing are missing."""
    if not query.is_tree():
        raise ValueError("only connected acyclic join graphs can be contracted")
    join = correlation or (correlate_fft if width >= FFT_WIDTH else correlate)
    members: dict[int, list[str]] = {}
    for alias, attrs in query.joined.items():
        for attr in attrs:
            members.setdefault(query.components[f"{alias}.{attr}"], []).append(alias)

    def message(alias: str, to: int) -> DataFrame:
        out = sketches[alias]
        for attr in sorted(query.joined[alias]):
            via = query.components[f"{alias}.{attr}"]
            if via != to:
                out = join(out, product([message(a, via) for a in members[via] if a != alias]), width)
        return out

    root = query.components[query.root()]
    return product([message(a, root) for a in members[root]]).groupBy("row").agg(F.sum("v").alias("v"))


def all_rows(per_row: DataFrame, depth: int) -> DataFrame:
    """With 0 for sketch rows without any cell."""
    rows = per_row.sparkSession.range(depth).select(F.col("id").cast("int").alias("row"))
    return rows.join(per_row, "row", "left").select("row", F.coalesce("v", F.lit(0.0)).alias("v"))


def summarised(per_row: DataFrame, depth: int, how: str | float = 0.5) -> DataFrame:
    """``estimate`` from the rows' estimates: 'min', 'mean', or a quantile, interpolated."""
    v = all_rows(per_row, depth)
    agg = F.min("v") if how == "min" else F.avg("v") if how == "mean" else F.percentile("v", F.lit(float(how)))
    return v.agg(agg.alias("estimate"))


def count_estimate(query: Query, sketches: dict[str, DataFrame], depth: int, width: int, how: str | float = 0.5, correlation: Correlation | None = None) -> DataFrame:
    """From count sketches (the median or another quantile, or the mean) or count-min sketches ('min')."""
    return summarised(contract(query, sketches, width, correlation), depth, how)


def bound_estimate(query: Query, counts: dict[str, DataFrame], degrees: dict[str, DataFrame], depth: int, width: int, correlation: Correlation | None = None) -> DataFrame:
    """An upper bound: for each relation, its count-min sketch and the others' degree sketches; the least over rows and relations."""
    best = None
    for alias, _ in query.tables:
        one = count_estimate(query, {a: counts[a] if a == alias else degrees[a] for a, _ in query.tables}, depth, width, "min", correlation)
        best = one if best is None else best.unionByName(one)
    if best is None:
        raise ValueError("a query without tables")
    return best.agg(F.min("estimate").alias("estimate"))


def same_sign_estimate(query: Query, sketches: dict[str, DataFrame], depth: int, width: int, how: str | float = 0.5, correlation: Correlation | None = None) -> DataFrame:
    """From same-sign sketches (v, neg). With an odd number of key factors the joint product of negative signs is -1 and is taken back twice."""
    factors = sum(len(attrs) for attrs in query.joined.values())
    whole = all_rows(contract(query, {a: s.select("row", "bin", "v") for a, s in sketches.items()}, width, correlation), depth)
    if factors % 2:
        negative = all_rows(contract(query, {a: s.select("row", "bin", F.col("neg").alias("v")) for a, s in sketches.items()}, width, correlation), depth)
        whole = whole.join(negative.withColumnRenamed("v", "n"), "row").select("row", (F.col("v") - 2 * F.col("n")).alias("v"))
    return summarised(whole, depth, how)
