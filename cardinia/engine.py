"""The engine: estimates of COUNT(*) queries from sketches, and the evaluation of workloads."""

from __future__ import annotations

import hashlib
import pickle
import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardinia.functions.hashing import HashFamily, KeyUse
from cardinia.operators import contraction, dependence, evaluation, sketches, spn
from cardinia.plans.dataset import Dataset
from cardinia.plans.predicates import conjunction
from cardinia.plans.query import Query
from cardinia.sources import tables as sources
from cardinia.sources.scratch import materialised, scope

METHODS = ("ams", "count-sketch", "count-min", "bound-sketch", "bound-sketch-unfiltered", "same-sign")


def key_uses(query: Query, dataset: Dataset, alias: str) -> tuple[KeyUse, ...]:
    table = dict(query.tables)[alias]
    return tuple(KeyUse(c, dataset.column(table, c).kind, query.components[f"{alias}.{c}"], joins) for c, joins in sorted(query.joined[alias].items()))


class Engine:
    """Holds tables, hash functions and the sketches made so far.

    mode 'exact' sketches filtered rows; 'model' multiplies the sketches of a learnt
    model's leaves with probabilities. how: 'min', 'mean' or the quantile of the rows'
    estimates (pessimistic: the largest). Unfiltered sketches, and what a model's leaves
    hold, are kept as tables in the shared folder and reused by every query that joins on
    the same keys; ``cache_dir`` keeps the tables' rows with their leaves for later
    engines with the same rows and settings. ``scale_degree`` False keeps a model's degree
    sketches unscaled, so that its bound is one from above for their part.
    """

    def __init__(
        self,
        spark: SparkSession,
        dataset: Dataset,
        tables: dict[str, DataFrame],
        method: str = "count-sketch",
        depth: int = sketches.DEPTH,
        width: int = sketches.WIDTH,
        mode: str = "exact",
        how: str | float = 0.5,
        seed: int = 1,
        sign_k: int = 4,
        selectivity: str = "count-min",
        pessimistic: bool = False,
        k: int = 2,
        rdc_threshold: float = 0.01,
        min_cluster: float = 0.1,
        cluster_first: bool = False,
        clusterer: str = "gmm",
        exact_degree: bool = False,
        sample_rows: int = 10_000,
        cache_dir: str | None = None,
        scale_degree: bool = True,
    ):
        if method not in METHODS:
            raise ValueError(f"method {method!r} is none of {METHODS}")
        if mode not in ("exact", "model"):
            raise ValueError(f"mode {mode!r} is neither exact nor model")
        if method == "ams" or (method == "count-sketch" and width == 1):
            method, width = "ams", 1
        self.spark, self.dataset, self.tables = spark, dataset, tables
        self.method, self.depth, self.width, self.mode = method, depth, width, mode
        self.how = 1.0 if pessimistic and not isinstance(how, str) else how
        self.family = HashFamily(seed, sign_k)
        self.learning = {"threshold": rdc_threshold, "min_cluster": min_cluster, "k": k, "how": clusterer, "cluster_first": cluster_first}
        self.filters, self.pessimistic, self.exact_degree, self.sample_rows, self.cache_dir = selectivity, pessimistic, exact_degree, sample_rows, cache_dir
        self.scale_degree = scale_degree
        self.lock = Lock()
        self.models: dict[str, spn.TableModel] = {}
        self.kept: dict[tuple, DataFrame] = {}
        self.kinds = {t: {c: s.kind for c, s in x.columns.items()} for t, x in dataset.tables.items()}

    def model(self, table: str) -> spn.TableModel:
        """The table's model, learnt at its first use."""
        if table not in self.models:
            spec, df = self.dataset.tables[table], self.tables[table]
            tree, features = spn.learn(dependence.sample_rows(df, list(spec.columns), self.sample_rows), spec, spec.keys, **self.learning)
            rows = None
            if self.cache_dir:
                columns = list(spec.columns)
                what = pickle.dumps((table, str(tree), [(n.conditions, n.clusters) for n in tree.walk()], self.learning, self.sample_rows, dependence.fingerprint(df, columns)))
                path = f"{self.cache_dir}/{table}-{hashlib.sha256(what).hexdigest()[:16]}"
                rows = sources.cached(self.spark, path, lambda: spn.assigned(df.select(*tree.columns), tree, features), df.count())
            self.models[table] = spn.TableModel.build(df, spec, tree, features, self.filters, self.family, self.depth, self.width, self.pessimistic, rows, self.scale_degree)
        return self.models[table]

    def relation(self, query: Query, alias: str, kind: str, filtered: bool = True, exact: bool | None = None) -> DataFrame:
        """The alias's sketch: kind 'count-sketch', 'count-min', 'bound-sketch' or 'same-sign'."""
        table = dict(query.tables)[alias]
        keys = key_uses(query, self.dataset, alias)
        predicates = query.filters.get(alias, ()) if filtered else ()
        exact = self.mode == "exact" if exact is None else exact
        if not exact and kind != "same-sign":
            return self.model(table).relation(keys, predicates, kind)
        where = conjunction(predicates, self.kinds[table])
        if predicates:
            return sketches.sketch(self.tables[table], keys, self.family, kind, self.depth, self.width, where)
        name = (table, keys, kind)
        with self.lock:
            if name not in self.kept:
                self.kept[name] = materialised(sketches.sketch(self.tables[table], keys, self.family, kind, self.depth, self.width), "sketch", True)
            return self.kept[name]

    def _sketches(self, query: Query) -> dict[str, dict[str, DataFrame]]:
        """What the method needs: by role ('counts', 'degrees') and alias."""
        aliases = [a for a, _ in query.tables]
        kind = "count-sketch" if self.method == "ams" else self.method
        if kind in ("count-sketch", "count-min", "same-sign"):
            return {"counts": {a: self.relation(query, a, kind) for a in aliases}}
        counts = {a: self.relation(query, a, "count-min") for a in aliases}
        if kind == "bound-sketch":
            return {"counts": counts, "degrees": {a: self.relation(query, a, kind) for a in aliases}}
        # Degrees are exact, and without filters unless exact_degree asks for them.
        return {"counts": counts, "degrees": {a: self.relation(query, a, "bound-sketch", self.exact_degree, True) for a in aliases}}

    def _contracted(self, query: Query, found: dict[str, dict[str, DataFrame]]) -> DataFrame:
        counts = found["counts"]
        if "degrees" in found:
            return contraction.bound_estimate(query, counts, found["degrees"], self.depth, self.width)
        if self.method == "same-sign":
            return contraction.same_sign_estimate(query, counts, self.depth, self.width, self.how)
        return contraction.count_estimate(query, counts, self.depth, self.width, "min" if self.method == "count-min" else self.how)

    def estimate(self, sql: str | Query) -> DataFrame:
        """One row, ``estimate``. Negative estimates are left as they are; queries of one table are counted by selectivity."""
        query = sql if isinstance(sql, Query) else Query.parse(sql)
        return self._contracted(query, self._sketches(query)) if query.joins else self._single(query)

    def prepare(self, query: Query) -> None:
        """Makes what does not depend on the query's filters: the models, their leaves' sketches, unfiltered sketches."""
        bare = replace(query, filters={})
        if self.mode == "model":
            for _, table in query.tables:
                self.model(table)
        if query.joins and (self.mode == "model" or self.method == "bound-sketch-unfiltered"):
            self._sketches(bare)

    def _single(self, query: Query) -> DataFrame:
        if len(query.tables) != 1:
            raise ValueError("the join graph is not connected")
        alias, table = query.tables[0]
        ps = query.filters.get(alias, ())
        if self.mode == "model":
            rows = self.tables[table].agg(F.count(F.lit(1)).cast("double").alias("n"))
            return rows.select((F.col("n") * self.model(table).selectivity(ps)).alias("estimate"))
        return self.tables[table].where(F.expr(conjunction(ps, self.kinds[table]))).agg(F.count(F.lit(1)).cast("double").alias("estimate"))

    def true_cardinality(self, sql: str | Query) -> DataFrame:
        query = sql if isinstance(sql, Query) else Query.parse(sql)
        return evaluation.true_cardinality(query, self.tables, self.kinds)

    def _timed(self, query: Query) -> tuple[float, float, float]:
        """The estimate, the seconds for the relations' sketches under their filters, and those for contracting them."""
        start = time.perf_counter()
        if not query.joins:
            return float(self._single(query).first().estimate), time.perf_counter() - start, 0.0
        with scope():
            found = {role: {a: materialised(df, "relation") for a, df in by.items()} for role, by in self._sketches(query).items()}
            made = time.perf_counter()
            estimate = self._contracted(query, found).first().estimate
        return float(estimate), made - start, time.perf_counter() - made

    def evaluate(self, queries: Iterable[tuple[str, float | None]], threads: int = 4) -> DataFrame:
        """One row for each (sql, cardinality): query, estimate, cardinality (joined where not given), q_error, num_tables, components, ranged, and seconds.

        sketching_s: for what does not depend on filters (0 where an earlier query needed
        the same), inference_s: for the relations' sketches under filters, estimation_s:
        for contracting them. Queries are jobs of their own, ``threads`` of them at a time;
        only their numbers come to the driver.
        """
        asked = [(sql, known, Query.parse(sql)) for sql, known in queries]
        sketching = []
        for _, _, query in asked:  # one after another: they share what they make
            start = time.perf_counter()
            self.prepare(query)
            sketching.append(time.perf_counter() - start)

        def one(item: tuple[str, float | None, Query]) -> tuple[float, float, float, float]:
            _, known, query = item
            estimate, inference, estimation = self._timed(query)
            return estimate, float(known) if known is not None else self.true_cardinality(query).first().cardinality, inference, estimation

        with ThreadPoolExecutor(max(1, threads)) as pool:
            found = list(pool.map(one, asked))
        out = [
            (sql, e, c, len(q.tables), len(set(q.components.values())), "<" in sql or ">" in sql, s, i, t)
            for (sql, _, q), s, (e, c, i, t) in zip(asked, sketching, found, strict=True)
        ]
        schema = "query string, estimate double, cardinality double, num_tables int, components int, ranged boolean, sketching_s double, inference_s double, estimation_s double"
        df = self.spark.createDataFrame(out, schema)
        return df.withColumn("q_error", evaluation.q_error(F.col("estimate"), F.col("cardinality")))

    def diagnose(self, sql: str) -> DataFrame:
        """alias, l1, l1_independent: how far the model's sketch, and that of full independence, are from the exact one."""
        query = Query.parse(sql)
        out = None
        for alias, table in query.tables:
            keys, ps = key_uses(query, self.dataset, alias), query.filters.get(alias, ())
            spec = self.dataset.tables[table]
            exact = self.relation(query, alias, "count-sketch", exact=True)
            alone = spn.TableModel.build(self.tables[table], spec, spn.independent(list(spec.columns), spec.keys), None, self.filters, self.family, self.depth, self.width)
            one = evaluation.l1_error(exact, self.model(table).relation(keys, ps)).crossJoin(evaluation.l1_error(exact, alone.relation(keys, ps)).withColumnRenamed("l1", "l1_independent"))  # one row each
            one = one.select(F.lit(alias).alias("alias"), "l1", "l1_independent")
            out = one if out is None else out.unionByName(one)
        return out
