"""Sum-product models of one table: structure, row assignment, sketches of leaves, inference.

A model is a tree. Sum nodes cut rows into clusters, product nodes cut columns into
independent groups, leaves hold one filter column each, or all join keys together. The
tree is learnt on a bounded sample; the table is then read once, each row gets the
number of its leaf for every column by column expressions (labels of learnt clusters
come from one vectorised pass), and what the leaves hold is made once, when it is first
asked for, and kept in tables: join sketches of each set of keys, the counts of a filter
column's values or its interval sketches. A relation's sketch under filters is a sum over
key leaves, each times the probabilities that the tree puts beside it; it reads these
tables only, unless a key itself is filtered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardinia.functions.hashing import HashFamily, KeyUse, encoded
from cardinia.operators import clustering, dependence, selectivity, sketches
from cardinia.plans.dataset import Table
from cardinia.plans.predicates import UNRANGED, conjunction, integer_range
from cardinia.plans.query import Predicate
from cardinia.sources.scratch import materialised

KEYS = "#keys"


@dataclass
class Node:
    """kind: 'sum', 'product', 'leaf' (one filter column) or 'keys' (all join keys)."""

    kind: str
    columns: tuple[str, ...]
    children: list[Node] = field(default_factory=list)
    number: int = -1
    size: int = 0
    #: Sum nodes: SQL conditions of all children but the last, or learnt clusters.
    conditions: tuple[str, ...] = ()
    clusters: clustering.Clusters | None = None

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()

    def numbered(self) -> Node:
        for k, n in enumerate(self.walk()):
            n.number = k
        return self

    def describe(self) -> dict:
        return {"kind": self.kind, "columns": list(self.columns), "children": [c.describe() for c in self.children]}

    def __str__(self) -> str:
        return json.dumps(self.describe())


def independent(columns: list[str], keys: tuple[str, ...]) -> Node:
    """One product of the keys together and every other column alone."""
    mine = tuple(k for k in keys if k in columns)
    leaves = ([Node("keys", mine)] if mine else []) + [Node("leaf", (c,)) for c in columns if c not in mine]
    return leaves[0] if len(leaves) == 1 else Node("product", tuple(columns), leaves)


def clustered(columns: list[str], keys: tuple[str, ...], conditions: tuple[str, ...]) -> Node:
    """A sum of independent models, one for each condition and one for all other rows."""
    return Node("sum", tuple(columns), [independent(columns, keys) for _ in range(len(conditions) + 1)], conditions=conditions)


def column_groups(columns: list[str], keys: tuple[str, ...], matrix: np.ndarray, threshold: float) -> list[list[str]]:
    """Columns connected by dependences above the threshold; all that touch a key are one group, the first."""
    linked = matrix > threshold
    left = list(range(len(columns)))
    group_of: dict[int, int] = {}
    for start in left:
        if start in group_of:
            continue
        stack, mine = [start], len(set(group_of.values()))
        while stack:
            i = stack.pop()
            if i not in group_of:
                group_of[i] = mine
                stack += [j for j in left if linked[i, j] and j not in group_of]
    with_keys = {group_of[i] for i in left if columns[i] in keys}
    groups: dict[int, list[str]] = {}
    for i in left:
        groups.setdefault(-1 if group_of[i] in with_keys else group_of[i], []).append(columns[i])
    return [groups[g] for g in sorted(groups)]


def learn(
    sample: pd.DataFrame,
    table: Table,
    keys: tuple[str, ...],
    threshold: float = 0.01,
    min_cluster: float = 0.1,
    k: int = 2,
    how: str = "gmm",
    cluster_first: bool = False,
    seed: int = 1,
) -> tuple[Node, dict[str, dependence.ColumnFeatures]]:
    """The tree, learnt on a sample, and the features that its clusters are cut by.

    ``min_cluster``: rows below which columns are taken as independent; up to 1 a share
    of the sample, above a number of its rows. A ``threshold`` below 0 takes all columns
    as dependent, so that only sums are made until clusters are small.
    """
    features = dependence.learn_features(sample, table, seed=seed)
    least = min_cluster * len(sample) if min_cluster <= 1 else min_cluster
    values = {c: features[c].of(sample[c]) for c in sample.columns}
    keys = tuple(c for c in keys if c in sample.columns)

    def grow(columns: list[str], rows: np.ndarray, cut_rows: bool, depth: int) -> Node:
        if keys and set(columns) == set(keys):
            return Node("keys", tuple(columns))
        if len(columns) == 1:
            return Node("leaf", tuple(columns))
        small = len(rows) <= max(1.0, least) or depth > 32
        if small and not cut_rows:
            return independent(columns, keys)
        if not cut_rows:
            if threshold < 0:
                groups = [columns]
            else:
                some = rows[: dependence.SAMPLE]
                matrix = dependence.rdc_matrix(sample.iloc[some][columns], table, features)
                groups = column_groups(columns, keys, matrix, threshold)
            if len(groups) > 1:
                return Node("product", tuple(columns), [grow(g, rows, len(g) > 1 and set(g) != set(keys) and len(rows) > max(1.0, least), depth + 1) for g in groups])
        if len(rows) < 2:
            return independent(columns, keys)
        x = np.concatenate([values[c][rows] for c in columns], axis=1)
        found, labels = clustering.split(x, k, how, seed + depth)
        if labels.min() == labels.max():  # rows that features cannot tell apart
            return independent(columns, keys)
        children = [grow(columns, rows[labels == i], False, depth + 1) for i in range(k)]
        return Node("sum", tuple(columns), children, clusters=found)

    return grow(list(sample.columns), np.arange(len(sample)), cluster_first, 0).numbered(), features


def assigned(df: DataFrame, tree: Node, features: dict[str, dependence.ColumnFeatures] | None = None) -> DataFrame:
    """``df`` with ``leaf_<column>`` (and ``leaf_#keys``): the number of the row's leaf."""
    learnt = [n for n in tree.walk() if n.kind == "sum" and n.clusters is not None]
    if learnt:
        def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                f = {c: features[c].of(b[c]) for c in {c for n in learnt for c in n.columns}}
                for n in learnt:
                    b[f"__s{n.number}"] = n.clusters.labels(np.concatenate([f[c] for c in n.columns], axis=1)).astype("int32")
                yield b

        labels = [T.StructField(f"__s{n.number}", T.IntegerType()) for n in learnt]
        df = df.mapInPandas(label, T.StructType([*df.schema.fields, *labels]))

    def place(node: Node, column: str) -> Column:
        """The leaf of ``column`` for a row that reaches this node."""
        if node.kind in ("leaf", "keys"):
            return F.lit(node.number)
        if node.kind == "product":
            return place(next(c for c in node.children if column in c.columns), column)
        out = place(node.children[-1], column)
        for i in range(len(node.children) - 2, -1, -1):
            here = F.col(f"__s{node.number}") == i if node.clusters is not None else F.coalesce(F.expr(node.conditions[i]), F.lit(False))
            out = F.when(here, place(node.children[i], column)).otherwise(out)
        return out

    joined = {c for n in tree.walk() if n.kind == "keys" for c in n.columns}
    single = [c for c in tree.columns if c not in joined]
    out = df.withColumns({f"leaf_{c}": place(tree, c) for c in single} | ({f"leaf_{KEYS}": place(tree, sorted(joined)[0])} if joined else {}))
    return out.drop(*[f"__s{n.number}" for n in learnt])


@dataclass
class TableModel:
    """A tree with its assigned rows: gives the sketch of a relation under filters.

    ``scale_degree`` False leaves degrees as they are where filters let anything through,
    so that a scaled model still bounds from above.
    """

    table: Table
    tree: Node
    rows: DataFrame
    sizes: dict[int, int]
    method: str = "exact"
    family: HashFamily = field(default_factory=HashFamily)
    depth: int = 5
    width: int = 1000
    pessimistic: bool = False
    scale_degree: bool = True
    #: What the leaves hold, by what it is made of.
    kept: dict[tuple, Any] = field(default_factory=dict)

    def _kept(self, name: tuple, make: Callable[[], Any]) -> Any:
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    @staticmethod
    def build(df: DataFrame, table: Table, tree: Node, features=None, method: str = "exact", family: HashFamily | None = None, depth: int = 5, width: int = 1000, pessimistic: bool = False, rows: DataFrame | None = None, scale_degree: bool = True) -> TableModel:
        """``method``: how filter columns are estimated: 'exact', 'count-min' or 'count-sketch'; ``rows``: the table with its leaves, if it is kept somewhere."""
        tree.numbered() if tree.number < 0 else None
        if rows is None:
            rows = materialised(assigned(df.select(*tree.columns), tree, features), "model", True)
        leaves = [c for c in rows.columns if c.startswith("leaf_")]
        counts = rows.select(F.explode(F.array(*[F.col(f"`{c}`") for c in leaves])).alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        sizes = {r.leaf: r.n for r in counts.collect()}  # one row for each leaf of the tree
        model = TableModel(table, tree, rows, sizes, method, family or HashFamily(), depth, width, pessimistic, scale_degree)

        def fill(node: Node) -> int:
            below = [fill(c) for c in node.children]
            node.size = sum(below) if node.kind == "sum" else max(below) if below else sizes.get(node.number, 0)
            return node.size

        fill(tree)
        return model

    def probabilities(self, predicates: tuple[Predicate, ...]) -> dict[int, float]:
        """Leaf -> share of its rows that its column's filters let through; leaves without filters are left out."""
        out: dict[int, float] = {}
        keys = {c for n in self.tree.walk() if n.kind == "keys" for c in n.columns}
        by_column: dict[str, list[Predicate]] = {}
        for p in predicates:
            if p.column not in keys:
                by_column.setdefault(p.column, []).append(p)
        for column, ps in by_column.items():
            out |= self._column(column, tuple(ps))
        return out

    def _column(self, column: str, ps: tuple[Predicate, ...]) -> dict[int, float]:
        spec = self.table.columns[column]
        leaf, name = F.col(f"`leaf_{column}`").alias("leaf"), f"`{column}`"
        leaves = [n.number for n in self.tree.walk() if n.kind == "leaf" and n.columns == (column,)]
        if self.method == "exact" or spec.kind == "string" or not spec.intervals or any(p.op in UNRANGED for p in ps):
            values = self._kept((column, "values"), lambda: materialised(self.rows.groupBy(leaf, F.col(name)).agg(F.count(F.lit(1)).alias("#")), "model-values", True))
            hit = F.when(F.expr(conjunction(ps, {column: spec.kind})), F.col("#")).otherwise(0)
            return {r.leaf: float(r.p) for r in values.groupBy("leaf").agg((F.sum(hit) / F.sum("#")).alias("p")).collect()}
        signed, width = self.method == "count-sketch", selectivity.sketch_width(self.width)

        def sketched() -> tuple:
            e = F.expr(encoded(name, spec.kind))
            domain = self.rows.agg(F.min(e).alias("low"), F.max(e).alias("high")).first()
            cells = selectivity.interval_cells(self.rows.withColumn("leaf", leaf), column, spec.kind, spec.intervals, self.family, self.depth, width, signed, ["leaf"])
            return domain.low, domain.high, materialised(cells, "model-cells", True)

        low, high, cells = self._kept((column, signed), sketched)
        span = None if low is None else integer_range(ps, spec.kind, low, high)
        if span is None:
            return dict.fromkeys(leaves, 0.0)
        cover = selectivity.cover_rows(cells.sparkSession, span[0], span[1], spec.intervals)
        hits = {r.leaf: r.hits for r in selectivity.probe_cells(cells, cover, self.depth, width, self.family, signed, ["leaf"]).collect()}
        return {n: min(1.0, max(0.0, (hits.get(n) or 0.0) / max(1, self.sizes.get(n, 0)))) for n in leaves}

    def coefficients(self, probabilities: dict[int, float]) -> tuple[dict[int, float], float]:
        """Key leaf -> what its sketch is multiplied by; and the probability of all filters."""

        def infer(node: Node) -> tuple[dict[int, float], float]:
            if node.kind == "keys":
                return {node.number: 1.0}, 1.0
            if node.kind == "leaf":
                return {}, probabilities.get(node.number, 1.0)
            below = [infer(c) for c in node.children]
            if node.kind == "sum":
                total = sum(c.size for c in node.children)
                share = sum(p * c.size for (_, p), c in zip(below, node.children, strict=True)) / total if total else 0.0
                return {k: v for f, _ in below for k, v in f.items()}, share
            beside = [p for f, p in below if not f]
            together = (min(beside) if self.pessimistic else float(np.prod(beside))) if beside else 1.0
            within = [p for f, p in below if f]
            whole = [*within, together] if within else [together]
            chance = min(whole) if self.pessimistic else float(np.prod(whole))
            return {k: v * together for f, _ in below for k, v in f.items()}, chance

        return infer(self.tree)

    def leaf_sketch(self, keys: tuple[KeyUse, ...], method: str = "count-sketch", on_keys: tuple[Predicate, ...] = ()) -> DataFrame:
        """(leaf, row, bin, v): the join sketch of each key leaf; kept, unless keys are filtered."""

        def build() -> DataFrame:
            kinds = {c: s.kind for c, s in self.table.columns.items()}
            rows = self.rows.where(F.expr(conjunction(on_keys, kinds))).withColumn("leaf", F.col(f"`leaf_{KEYS}`"))
            return sketches.sketch(rows, keys, self.family, method, self.depth, self.width, by=["leaf"])

        return build() if on_keys else self._kept((keys, method), lambda: materialised(build(), "model-sketch", True))

    def relation(self, keys: tuple[KeyUse, ...], predicates: tuple[Predicate, ...] = (), method: str = "count-sketch") -> DataFrame:
        """(row, bin, v) of the relation under its filters: the key leaves' sketches, each times its coefficient."""
        factors, _ = self.coefficients(self.probabilities(predicates))
        own = {c for n in self.tree.walk() if n.kind == "keys" for c in n.columns}
        built = self.leaf_sketch(keys, method, tuple(p for p in predicates if p.column in own))
        as_it_is = method == "bound-sketch" and not self.scale_degree
        scale = F.lit(0.0)
        for number, factor in factors.items():  # a handful: the tree's key leaves
            scale = F.when(F.col("leaf") == number, F.lit(float(factor > 0) if as_it_is else float(factor))).otherwise(scale)
        return built.select("row", "bin", (F.col("v") * scale).alias("v")).groupBy("row", "bin").agg(F.sum("v").alias("v"))

    def selectivity(self, predicates: tuple[Predicate, ...]) -> float:
        return self.coefficients(self.probabilities(predicates))[1]
