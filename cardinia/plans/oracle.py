"""DuckDB SQL for sketches and estimates, written from the definitions, to check operators against."""

from __future__ import annotations

from cardinia.functions.hashing import DUCKDB, HashFamily, KeyUse, encoded, residue, tuple_bin, tuple_negative, tuple_sign
from cardinia.plans.dataset import Dataset
from cardinia.plans.predicates import conjunction
from cardinia.plans.query import Predicate, Query


def where_sql(dataset: Dataset, table: str, predicates: tuple[Predicate, ...]) -> str:
    return conjunction(predicates, {c: s.kind for c, s in dataset.tables[table].columns.items()}, DUCKDB)


def sketch_sql(source: str, keys: tuple[KeyUse, ...], family: HashFamily, method: str, depth: int, width: int, where: str = "TRUE", value: str = "v") -> str:
    """row, bin, v; for same-sign, ``value`` picks v or neg."""
    there = " AND ".join(f"{k.column} IS NOT NULL" for k in keys)
    names = ", ".join(k.residue_name for k in keys)
    rows = f"SELECT {names}, count(*) AS n FROM (SELECT {', '.join(f'{residue(encoded(k.column, k.kind, DUCKDB))} AS {k.residue_name}' for k in keys)} FROM {source} WHERE ({where}) AND {there}) GROUP BY {names}"
    parts = []
    for r in range(depth):
        weight = "n"
        if method in ("ams", "count-sketch"):
            weight = f"{tuple_sign(keys, family, r)} * n"
        elif method == "same-sign":
            weight = f"{tuple_sign(keys, family, r, True) if value == 'v' else tuple_negative(keys, family, r)} * n"
        parts.append(f"SELECT {r} AS row, {tuple_bin(keys, family, r, width)} AS bin, {weight} AS w FROM base")
    agg = "max" if method == "bound-sketch" else "sum"
    return f"(WITH base AS ({rows}) SELECT CAST(row AS INTEGER) AS row, CAST(bin AS INTEGER) AS bin, CAST({agg}(w) AS BIGINT) AS v FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)"


def product_sql(sketches: list[str]) -> str:
    if len(sketches) == 1:
        return sketches[0]
    joined = " ".join(f"JOIN {s} AS s{i} USING (row, bin)" for i, s in enumerate(sketches[1:], 1))
    value = " * ".join(f"CAST(s{i}.v AS DOUBLE)" for i in range(len(sketches)))
    return f"(SELECT row, bin, {value} AS v FROM {sketches[0]} AS s0 {joined})"


def correlate_sql(sketch: str, message: str, width: int) -> str:
    return (
        f"(SELECT a.row AS row, CAST((a.bin - b.bin + {width}) % {width} AS INTEGER) AS bin, sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)) AS v "
        f"FROM {sketch} AS a JOIN {message} AS b ON a.row = b.row GROUP BY ALL)"
    )


def contract_sql(query: Query, sketches: dict[str, str], depth: int, width: int) -> str:
    """row, v for every sketch row."""
    members: dict[int, list[str]] = {}
    for alias, attrs in query.joined.items():
        for attr in attrs:
            members.setdefault(query.components[f"{alias}.{attr}"], []).append(alias)

    def message(alias: str, to: int) -> str:
        out = sketches[alias]
        for attr in sorted(query.joined[alias]):
            via = query.components[f"{alias}.{attr}"]
            if via != to:
                out = correlate_sql(out, product_sql([message(a, via) for a in members[via] if a != alias]), width)
        return out

    root = query.components[query.root()]
    whole = product_sql([message(a, root) for a in members[root]])
    return f"(SELECT r.row, coalesce(sum(CAST(s.v AS DOUBLE)), 0) AS v FROM (SELECT CAST(range AS INTEGER) AS row FROM range({depth})) AS r LEFT JOIN {whole} AS s ON s.row = r.row GROUP BY r.row)"


def summary_sql(rows: str, how: str | float) -> str:
    agg = "min(v)" if how == "min" else "avg(v)" if how == "mean" else f"quantile_cont(v, {float(how)})"
    return f"SELECT CAST({agg} AS DOUBLE) AS estimate FROM {rows}"


def keys_of(query: Query, dataset: Dataset, alias: str) -> tuple[KeyUse, ...]:
    table = dict(query.tables)[alias]
    return tuple(KeyUse(c, dataset.column(table, c).kind, query.components[f"{alias}.{c}"], j) for c, j in sorted(query.joined[alias].items()))


def relation_sql(query: Query, dataset: Dataset, alias: str, family: HashFamily, method: str, depth: int, width: int, filtered: bool = True, value: str = "v") -> str:
    table = dict(query.tables)[alias]
    where = where_sql(dataset, table, query.filters.get(alias, ())) if filtered else "TRUE"
    return sketch_sql(table, keys_of(query, dataset, alias), family, method, depth, width, where, value)


def estimate_sql(sql: str, dataset: Dataset, family: HashFamily, method: str, depth: int, width: int, how: str | float = 0.5) -> str:
    """The engine's estimate in exact mode."""
    q = Query.parse(sql)
    aliases = [a for a, _ in q.tables]

    def one(kinds: dict[str, str], unfiltered: tuple[str, ...] = (), value: str = "v") -> str:
        return contract_sql(q, {a: relation_sql(q, dataset, a, family, kinds[a], depth, width, a not in unfiltered, value) for a in aliases}, depth, width)

    if method in ("ams", "count-sketch"):
        return summary_sql(one(dict.fromkeys(aliases, method)), how)
    if method == "count-min":
        return summary_sql(one(dict.fromkeys(aliases, method)), "min")
    if method == "same-sign":
        whole = one(dict.fromkeys(aliases, method))
        if sum(len(a) for a in q.joined.values()) % 2 == 0:
            return summary_sql(whole, how)
        return summary_sql(f"(SELECT a.row, a.v - 2 * b.v AS v FROM {whole} AS a JOIN {one(dict.fromkeys(aliases, method), value='neg')} AS b USING (row))", how)
    choices = []
    for c in aliases:
        kinds = {a: "count-min" if a == c else "bound-sketch" for a in aliases}
        others = tuple(a for a in aliases if a != c) if method == "bound-sketch-unfiltered" else ()
        choices.append(summary_sql(one(kinds, others), "min"))
    return f"SELECT min(estimate) AS estimate FROM ({' UNION ALL '.join(choices)})"


def cardinality_sql(sql: str, dataset: Dataset) -> str:
    """The query itself."""
    q = Query.parse(sql)
    names = dict(q.tables)
    conditions = [f"{j.left[0]}.{j.left[1]} = {j.right[0]}.{j.right[1]}" for j in q.joins]
    for alias, ps in q.filters.items():
        for p in ps:
            kind = dataset.column(names[alias], p.column).kind
            text = conjunction((p,), {p.column: kind}, DUCKDB)
            conditions.append(f"{alias}.{text}")
    return f"SELECT CAST(count(*) AS DOUBLE) AS cardinality FROM {', '.join(f'{t} AS {a}' for a, t in q.tables)} WHERE {' AND '.join(conditions) or 'TRUE'}"


def interval_sql(source: str, column: str, kind: str, sizes: tuple[int, ...], family: HashFamily, depth: int, width: int, signed: bool) -> str:
    """size, row, bin, v of a column's interval sketch."""
    e = encoded(column, kind, DUCKDB)
    levels = ", ".join(str(s) for s in sizes)
    buckets = f"SELECT size, CAST(floor(value / size) AS BIGINT) AS bucket, count(*) AS n FROM (SELECT {e} AS value FROM {source} WHERE {column} IS NOT NULL), (SELECT unnest([{levels}]) AS size) GROUP BY ALL"
    parts = [f"SELECT size, {r} AS row, {family.bin('x', 0, r, width)} AS bin, {family.sign('x', 0, r) if signed else '1'} * n AS w FROM base" for r in range(depth)]
    return f"(WITH base AS (SELECT size, {residue('bucket')} AS x, n FROM ({buckets})) SELECT CAST(size AS BIGINT) AS size, CAST(row AS INTEGER) AS row, CAST(bin AS INTEGER) AS bin, CAST(sum(w) AS BIGINT) AS v FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)"


def cover_sql(left: int, right: int, sizes: tuple[int, ...]) -> str:
    """size, bucket: the greedy cover of [left, right] by aligned intervals, one step a row."""
    step, stop = min(sizes), right + min(sizes)

    def best(at: str) -> str:
        return "greatest(" + ", ".join([str(step), *(f"CASE WHEN {at} >= {left} AND {at} % {s} = 0 AND {at} + {s} <= {stop} THEN {s} ELSE 0 END" for s in sizes)]) + ")"

    first = f"CAST({left} // {step} * {step} AS BIGINT)"
    return f"(WITH RECURSIVE cover(p, size) AS (SELECT {first}, CAST({best(first)} AS BIGINT) UNION ALL SELECT p + size, CAST({best('(p + size)')} AS BIGINT) FROM cover WHERE p + size <= {right}) SELECT size, p // size AS bucket FROM cover)"


def probe_sql(cells: str, points: str, family: HashFamily, depth: int, width: int, signed: bool, source: str, without: str | None = None, digits: int | None = 9) -> str:
    """selectivity of a cover, less that of another."""
    parted = f"SELECT size, bucket, 1 AS part FROM {points}" + (f" UNION ALL SELECT size, bucket, -1 FROM {without}" if without else "")
    parts = [f"SELECT part, size, CAST({r} AS INTEGER) AS row, {family.bin('x', 0, r, width)} AS bin, {family.sign('x', 0, r) if signed else '1'} AS sign FROM asked" for r in range(depth)]
    per_size = "quantile_cont(s, 0.5)" if signed else "min(s)"
    share = f"greatest(0.0, least(1.0, sum(part * s) / (SELECT count(*) FROM {source})))"
    return (
        f"WITH asked AS (SELECT part, size, {residue('bucket')} AS x FROM ({parted})), probes AS ({' UNION ALL '.join(parts)}), "
        f"sums AS (SELECT p.part, p.size, p.row, CAST(sum(p.sign * coalesce(c.v, 0)) AS DOUBLE) AS s FROM probes AS p LEFT JOIN {cells} AS c ON c.size = p.size AND c.row = p.row AND c.bin = p.bin GROUP BY ALL), "
        f"sizes AS (SELECT part, size, {per_size} AS s FROM sums GROUP BY part, size) "
        f"SELECT {share if digits is None else f'round({share}, {digits})'} AS selectivity FROM sizes"
    )
