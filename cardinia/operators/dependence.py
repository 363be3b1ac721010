"""Dependence between columns: distribution functions, randomised features, the RDC matrix.

Distribution functions and the dependence matrix are computed for whole tables: features
are column expressions, and what the canonical correlations need are sums of their
products (Gram matrices), of which each task gives one. Models learn on a bounded sample.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardinia.plans.dataset import CONTINUOUS, DISCRETE, Table
from cardinia.sources.scratch import materialised

FEATURES, SCALE = 20, 1 / 6
CATEGORIES, DISCRETE_DIM = 1024, 32
SAMPLE = 5000
#: Different values of a range that a distribution function is added up in, and the most ranges.
_RANGE, _MOST_CUTS = 100_000, 4096


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """(value, ecdf) for each different value: the share of all rows (NULLs included) that are not above it.

    Values are counted, once, cut in ranges of about _RANGE values, and added up in each
    range and over the ranges, so no task sees all values. NULL has 0.
    """
    counts = materialised(df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")), "ecdf-counts")
    there = counts.where("value IS NOT NULL")
    size = counts.agg(F.sum("n").alias("total"), F.count("value").alias("values")).first()
    ranges = min(_MOST_CUTS, max(2, size["values"] // _RANGE))
    cuts = there.agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first().c or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else None
    place = F.lit(0) if bounds is None else F.size(F.filter(bounds, lambda c: c < F.col("value")))
    placed = there.withColumn("part", place)
    parts = placed.groupBy("part").agg(F.sum("n").alias("m"))  # as many rows as there are ranges
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    upto = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("within", F.sum("n").over(upto)).join(F.broadcast(offsets), "part")
    known = summed.select("value", ((F.col("before") + F.col("within")) / F.lit(float(max(1, size.total or 0)))).alias("ecdf"))
    return known.unionByName(counts.where("value IS NULL").select("value", F.lit(0.0).alias("ecdf")))


def top_categories(df: DataFrame, column: str, k: int = CATEGORIES - 1) -> DataFrame:
    """(category, count) of the ``k`` most frequent values, ties to the smaller."""
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc_nulls_last("category")).limit(k)


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_i, col_j, pearson) for each pair of numeric columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = [F.struct(F.lit(a).alias("col_i"), F.lit(b).alias("col_j"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson")) for a, b in pairs]
    return df.agg(F.array(*one).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def sample_rows(df: DataFrame, columns: list[str], rows: int = SAMPLE) -> pd.DataFrame:
    """A sample of rows, in the order of a hash of their contents and their place in the table: copies are picked one by one, and a table read again gives the same."""
    picked = df.select(*columns).withColumn("__h", F.xxhash64(*columns, F.monotonically_increasing_id())).orderBy("__h", *columns).limit(rows)
    return picked.drop("__h").toPandas()


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """The same for tables with the same rows, in whatever order, and hardly for others."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{r.n}/{r.s}"


def _numbers(values: pd.Series) -> np.ndarray:
    """Ordered values as floats, NULL as nan."""
    if str(values.dtype).startswith("datetime"):
        return np.where(values.isna(), np.nan, values.astype("int64").to_numpy(float))
    return pd.to_numeric(values, errors="coerce").to_numpy(float)


def _seeded(seed: str) -> np.random.Generator:
    return np.random.default_rng(int(hashlib.md5(seed.encode()).hexdigest()[:15], 16))


def _share(known: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Share of n that is not above x; 0 for nan."""
    out = np.searchsorted(known, x, side="right") / max(1, n)
    return np.where(np.isnan(x), 0.0, out)


@dataclass
class ColumnFeatures:
    """Maps a column's values to ``k`` features, learnt on a sample."""

    name: str
    discrete: bool
    k: int
    scale: float
    known: list[np.ndarray] = field(default_factory=list)
    n: int = 0
    codes: dict | None = None
    vectors: np.ndarray | None = None
    noise: bool = False
    gaussian: np.ndarray | None = None
    mean: np.ndarray | None = None
    std: np.ndarray | None = None

    @staticmethod
    def learn(name: str, values: pd.Series, role: str, k: int = FEATURES, scale: float = SCALE, seed: int = 1) -> ColumnFeatures:
        out = ColumnFeatures(name, role == DISCRETE, k, scale, n=len(values))
        rng = _seeded(f"{seed}/{name}")
        if out.discrete:
            counts = values.astype(object).where(values.notna(), None).value_counts(dropna=False)
            out.noise = len(counts) > 0.95 * len(values)
            if not out.noise:
                order = sorted(counts.index, key=lambda v: (-counts[v], str(v)))
                kept = order if len(order) <= CATEGORIES else order[: CATEGORIES - 1]
                out.codes = {v: i for i, v in enumerate(kept)}
                size = len(kept) + (len(order) > len(kept))
                # A one-hot row times a Gaussian matrix is a row of it: a look-up.
                out.vectors = np.eye(size) if size <= DISCRETE_DIM else rng.normal(size=(size, DISCRETE_DIM))
        raw = out._raw(values)
        out.known = [np.sort(c[~np.isnan(c)]) for c in raw.T]
        copula = out._copula(raw)
        out.gaussian = rng.normal(size=(copula.shape[1], k)) * (scale * copula.shape[1])
        f = np.sin(copula @ out.gaussian)
        out.mean, std = f.mean(0) if len(f) else np.zeros(k), f.std(0) if len(f) else np.ones(k)
        out.std = np.where(std > 0, std, 1.0)
        return out

    def _raw(self, values: pd.Series) -> np.ndarray:
        if not self.discrete:
            return _numbers(values)[:, None]
        if self.noise:
            return np.array([_seeded(f"noise/{self.name}/{v}").normal(size=DISCRETE_DIM) for v in values]).reshape(len(values), DISCRETE_DIM)
        rare = len(self.vectors) - 1
        plain = values.astype(object).where(values.notna(), None)
        return self.vectors[[self.codes.get(v, rare) for v in plain]].reshape(len(values), self.vectors.shape[1])

    def _copula(self, raw: np.ndarray) -> np.ndarray:
        return np.stack([_share(k, c, self.n) for k, c in zip(self.known, raw.T, strict=True)], axis=1)

    def of(self, values: pd.Series) -> np.ndarray:
        return (np.sin(self._copula(self._raw(values)) @ self.gaussian) - self.mean) / self.std


def learn_features(sample: pd.DataFrame, table: Table, k: int = FEATURES, scale: float = SCALE, seed: int = 1) -> dict[str, ColumnFeatures]:
    return {c: ColumnFeatures.learn(c, sample[c], table.columns[c].role, k, scale, seed) for c in sample.columns}


def canonical_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """The first canonical correlation of two feature matrices; 0 where there is none."""
    both = np.concatenate([x, y, np.ones((len(x), 1))], axis=1)
    return correlation_of_gram(both.T @ both, slice(0, x.shape[1]), slice(x.shape[1], x.shape[1] + y.shape[1]))


def rdc_matrix(sample: pd.DataFrame, table: Table, features: dict[str, ColumnFeatures] | None = None, k: int = FEATURES, seed: int = 1) -> np.ndarray:
    """Dependence of each pair of columns, between 0 and 1; the identity on 10 k rows or fewer.

    Columns that are constant, or discrete and (nearly) unique, depend on nothing.
    """
    columns = list(sample.columns)
    out = np.eye(len(columns))
    if len(sample) <= 10 * k:
        return out
    features = features or learn_features(sample, table, k, seed=seed)
    f = {c: features[c].of(sample[c]) for c in columns}
    distinct = {c: sample[c].nunique() for c in columns}
    alone = {c for c in columns if distinct[c] <= 1 or (table.columns[c].role == DISCRETE and distinct[c] >= 0.99 * len(sample))}
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            if a not in alone and columns[j] not in alone:
                out[i, j] = out[j, i] = canonical_correlation(f[a], f[columns[j]])
    return out


def _category_features(df: DataFrame, column: str, rows: int, k: int, scale: float, seed: int) -> DataFrame | None:
    """(__value, __f0 .. __fk-1) of a discrete column's frequent categories, and of all others together (the row ``__rest``); None if it is nearly a key."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    different = counts.count()
    if different <= 1 or different > 0.95 * rows:
        return None
    top = counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(CATEGORIES if different <= CATEGORIES else CATEGORIES - 1).collect()
    n = np.array([r.n for r in top], float)
    if different > len(top):
        n = np.append(n, rows - n.sum())
    rng = _seeded(f"{seed}/{column}")
    vectors = np.eye(len(n)) if len(n) <= DISCRETE_DIM else rng.normal(size=(len(n), DISCRETE_DIM))
    # The share of rows whose component is not above each category's.
    copula = np.stack([(n[None, :] * (v[None, :] <= v[:, None])).sum(1) / rows for v in vectors.T], axis=1)
    f = np.sin(copula @ (rng.normal(size=(copula.shape[1], k)) * (scale * copula.shape[1])))
    kind = df.schema[column].dataType.simpleString()
    found = [(r.value, False, *x) for r, x in zip(top, f.tolist(), strict=False)] + ([(None, True, *f[-1].tolist())] if different > len(top) else [])
    return df.sparkSession.createDataFrame(found, ", ".join([f"__value {kind}", "__rest boolean", *[f"__f{i} double" for i in range(k)]]))


def rank_weights(column: str, k: int = FEATURES, scale: float = SCALE, seed: int = 1) -> list[float]:
    """What a continuous column's rank is multiplied by before the sine, for each feature."""
    return [float(x) for x in _seeded(f"{seed}/{column}").normal(size=k) * scale]


def table_features(df: DataFrame, table: Table, columns: list[str], k: int = FEATURES, scale: float = SCALE, seed: int = 1) -> tuple[DataFrame, list[str]]:
    """Feature columns <column>_0 .. of all rows, and the columns that have any: sines of weighted ranks, or of categories' mean ranks.

    Columns that are constant, or discrete and (nearly) unique, have none.
    """
    rows = df.count()
    out, having = df.select(*columns), []
    for c in columns:
        names = [f"{c}_{i}" for i in range(k)]
        if table.columns[c].role == DISCRETE:
            found = _category_features(df, c, rows, k, scale, seed)
            if found is None:
                continue
            known = found.where("NOT __rest").withColumn("__known", F.lit(True))
            rest = found.where("__rest").first()
            joined = out.join(F.broadcast(known), F.col(c).eqNullSafe(F.col("__value")), "left")  # CATEGORIES rows at most
            out = joined.select(*[out[x] for x in out.columns], *[F.when(F.col("__known"), F.col(f"__f{i}")).otherwise(F.lit(rest[f"__f{i}"] if rest else 0.0)).alias(names[i]) for i in range(k)])
        else:
            ranks = ecdf(df, c)
            if ranks.limit(2).count() < 2:
                continue
            ranks = ranks.where("value IS NOT NULL").select(F.col("value").alias("__value"), F.col("ecdf").alias("__rank"))
            out = out.join(ranks, F.col(c) == F.col("__value"), "left").drop("__value")
            rank = F.coalesce("__rank", F.lit(0.0))
            out = out.withColumns({n: F.sin(rank * F.lit(w)) for n, w in zip(names, rank_weights(c, k, scale, seed), strict=True)}).drop("__rank")
        having.append(c)
    return out.select(*[f"{c}_{i}" for c in having for i in range(k)]), having


def gram(features: DataFrame) -> DataFrame:
    """(i, j, s): the sums of the products of all pairs of columns, the last being 1. Each task gives one matrix."""
    n = len(features.columns) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for b in batches:
            x = np.stack([*(c.to_numpy(zero_copy_only=False) for c in b.columns), np.ones(b.num_rows)], axis=1)
            total += x.T @ x
        i, j = np.indices((n, n)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1))], names=["i", "j", "s"])

    return features.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def correlation_of_gram(g: np.ndarray, a: slice, b: slice) -> float:
    """The first canonical correlation of two groups of columns, from their Gram matrix (the last column being 1)."""
    n = g[-1, -1]
    if n == 0:
        return 0.0
    c = g[:-1, :-1] - np.outer(g[:-1, -1], g[-1, :-1]) / n

    def whitener(m: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(m)
        keep = values > max(values.max(initial=0), 0) * 1e-8
        return vectors[:, keep] / np.sqrt(values[keep]) if keep.any() else np.zeros((len(m), 0))

    left, right = whitener(c[a, a]), whitener(c[b, b])
    if not left.shape[1] or not right.shape[1]:
        return 0.0
    return float(min(1.0, np.linalg.svd(left.T @ c[a, b] @ right, compute_uv=False)[0]))


def rdc_rows(df: DataFrame, table: Table, columns: list[str], k: int = FEATURES, seed: int = 1) -> DataFrame:
    """(col_i, col_j, rdc) for each pair of columns, over all rows; 0 on 10 k rows or fewer."""
    features, having = table_features(df, table, columns, k, seed=seed)
    found: dict[tuple[str, str], float] = {}
    if having:
        size = len(having) * k + 1
        g = np.zeros((size, size))
        for r in gram(features).collect():  # the square of the number of features
            g[r.i, r.j] = r.s
        for i, a in enumerate(having):
            for j in range(i + 1, len(having)):
                found[a, having[j]] = correlation_of_gram(g, slice(i * k, i * k + k), slice(j * k, j * k + k)) if g[-1, -1] > 10 * k else 0.0
    out = [(a, b, found.get((a, b), 0.0)) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.sparkSession.createDataFrame(out, "col_i string, col_j string, rdc double")


__all__ = ["CONTINUOUS", "DISCRETE", "ColumnFeatures", "canonical_correlation", "ecdf", "fingerprint", "gram", "learn_features", "pearson_matrix", "rdc_matrix", "rdc_rows", "sample_rows", "table_features", "top_categories"]
