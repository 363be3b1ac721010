"""Hybrid estimators: exact counts of frequent keys beside a sketch of the others."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(a: DataFrame, b: DataFrame, on: list[str], op, fill: float) -> DataFrame:
    left = a.select(*on, F.col("v").cast("double").alias("a"))
    right = b.select(*on, F.col("v").cast("double").alias("b"))
    both = left.join(right, on, "full")
    return both.select(*on, op(F.coalesce("a", F.lit(fill)), F.coalesce("b", F.lit(fill))).alias("v"))


@dataclass(frozen=True)
class Hybrid:
    """low, high: sketches (row, bin, v) of rare and of frequent keys; exact: (key, v) of the frequent ones.

    ``scale_degree`` False keeps degrees as they are under multiplication by a number,
    so that a scaled model still bounds from above.
    """

    low: DataFrame
    high: DataFrame
    exact: DataFrame
    degree: bool = False
    scale_degree: bool = True

    def _with(self, other: Hybrid, op, fill: float) -> Hybrid:
        on = ["row", "bin"]
        return replace(self, low=_joined(self.low, other.low, on, op, 0.0), high=_joined(self.high, other.high, on, op, 0.0), exact=_joined(self.exact, other.exact, ["key"], op, fill))

    def _scaled(self, op) -> Hybrid:
        def one(df: DataFrame, key: list[str]) -> DataFrame:
            return df.select(*key, op(F.col("v").cast("double")).alias("v"))

        return replace(self, low=one(self.low, ["row", "bin"]), high=one(self.high, ["row", "bin"]), exact=one(self.exact, ["key"]))

    def __add__(self, other: Hybrid) -> Hybrid:
        return self._with(other, lambda a, b: a + b, 0.0)

    def __mul__(self, other: Hybrid | float) -> Hybrid:
        if isinstance(other, Hybrid):
            return self._with(other, lambda a, b: a * b, 0.0)
        if self.degree and not self.scale_degree and other:
            return self
        return self._scaled(lambda v: v * F.lit(float(other)))

    __rmul__ = __mul__

    def __truediv__(self, other: Hybrid | float) -> Hybrid:
        if isinstance(other, Hybrid):
            return self._with(other, lambda a, b: F.try_divide(a, b), 1.0)
        return self._scaled(lambda v: F.try_divide(v, F.lit(float(other))))

    def total(self) -> DataFrame:
        """``total``: the sum of all absolute values."""
        parts = [df.select(F.abs(F.col("v").cast("double")).alias("v")) for df in (self.low, self.high, self.exact)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))

    def compared(self, number: float) -> DataFrame:
        """lt, le, gt, ge, eq of the total against a number."""
        n = F.lit(float(number))
        t: Column = F.col("total")
        return self.total().select((t < n).alias("lt"), (t <= n).alias("le"), (t > n).alias("gt"), (t >= n).alias("ge"), (t == n).alias("eq"))


def frequent_keys(df: DataFrame, key: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(key, v) of keys that occur ``least`` times or more, and the others' (key, v)."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("v"))
    return counts.where(F.col("v") >= least), counts.where(F.col("v") < least)
