"""The registered queries of the engine, each with the SQL that gives the same rows.

Every query on tables reads them whole; those of the parser and of interval covers have
none to read. Wide sketches are the engine's default; here they are narrow where a SQL
engine has to follow a correlation cell by cell.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardinia.engine import Engine, key_uses
from cardinia.functions.hashing import DUCKDB, P61, HashFamily, KeyUse, encoded, polynomial, residue
from cardinia.operators import contraction, dependence, evaluation, hybrid, selectivity, sketches, spn
from cardinia.plans import oracle
from cardinia.plans.dataset import POWER_INTERVALS, TIME_INTERVALS, YEAR_INTERVALS, retail
from cardinia.plans.predicates import conjunction
from cardinia.plans.query import Query, workload_columns
from cardinia.sources import tables as sources
from cardinia.sources.scratch import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RETAIL = retail()
FAMILY = HashFamily(7)
DEPTH, WIDTH, NARROW = 5, 1024, 256

TWO_WAY = "SELECT COUNT(*) FROM lineitem AS l, orders AS o WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 30"
STAR = "SELECT COUNT(*) FROM lineitem l, part p, supplier s WHERE l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey AND p.p_size <= 20"
CHAIN = "SELECT COUNT(*) FROM lineitem l, orders o, customer c WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING' AND l.l_quantity > 30"
FOUR_WAY = "SELECT COUNT(*) FROM lineitem l, orders o, customer c, nation n WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey AND o.o_orderdate >= '1995-01-01'::timestamp"
SELF = "SELECT COUNT(*) FROM events a, events b WHERE a.user_id = b.user_id AND a.event_type = 'click'"
TRANSITIVE = "SELECT COUNT(*) FROM customer c, nation n, supplier s WHERE c.c_nationkey = n.n_nationkey AND n.n_nationkey = s.s_nationkey AND s.s_acctbal > 0"
NOTHING = "SELECT COUNT(*) FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 1000000"
WORKLOAD = (TWO_WAY, STAR, CHAIN, TRANSITIVE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, **how) -> Engine:
    tables = sources.read_dataset(spark, sf_dir, RETAIL)
    return Engine(spark, RETAIL, tables, **{"depth": DEPTH, "width": WIDTH, "seed": FAMILY.seed, **how})


def registered(name: str, sql: str | None = None):
    """Registers a query under ``name``, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def key(column: str, component: int = 0, joins: tuple[int, ...] = (0,), kind: str = "int") -> KeyUse:
    return KeyUse(column, kind, component, joins)


# Scans, projections, filters


@registered("scan_project_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def scan_project_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read_parquet(spark, f"{sf_dir}/orders.parquet", list(RETAIL.tables["orders"].columns))


def _filtered(name: str, sql: str, columns: tuple[str, ...]) -> None:
    q = Query.parse(sql)
    ((alias, base),) = q.tables

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kinds = {c: s.kind for c, s in RETAIL.tables[base].columns.items()}
        return table(spark, sf_dir, base).where(F.expr(conjunction(q.filters[alias], kinds))).select(*columns)

    registered(name, f"SELECT {', '.join(columns)} FROM {base} WHERE {oracle.where_sql(RETAIL, base, q.filters[alias])}")(run)


_filtered("filter_conjunctive", "SELECT * FROM lineitem l WHERE l.l_quantity > 30 AND l.l_returnflag = 'R' AND l.l_linenumber <> 2", ("l_orderkey", "l_linenumber", "l_quantity"))
_filtered("filter_like", "SELECT * FROM part p WHERE p.p_name LIKE 'R?D %'", ("p_partkey", "p_name"))
_filtered("filter_not_like", "SELECT * FROM part p WHERE p.p_name NOT LIKE 'R?D %' AND p.p_type NOT LIKE '%e'", ("p_partkey", "p_name"))
_filtered("filter_range_ts", "SELECT * FROM orders o WHERE o.o_orderdate BETWEEN '1995-01-01'::timestamp AND '1996-06-30 12:00:00'::timestamp", ("o_orderkey", "o_orderdate"))
_filtered("filter_in_list", "SELECT * FROM orders o WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH') AND o.o_totalprice >= 1000.5", ("o_orderkey", "o_orderpriority"))


@registered("coerce_timestamps", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN 'broken' ELSE CAST(o_orderdate AS VARCHAR) END AS TIMESTAMP) AS at FROM orders")
def coerce_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'broken' ELSE CAST(o_orderdate AS STRING) END")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("at")).select("o_orderkey", sources.typed("at", "timestamp"))


@registered("scan_csv_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def scan_csv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a CSV file with a header, and back."""
    path = f"{scratch_dir(spark)}/orders-{uuid.uuid4().hex}.csv"
    table(spark, sf_dir, "orders").write.option("header", True).option("escape", "\\").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return sources.read_csv(spark, path, RETAIL.tables["orders"])


@registered("scan_workload", " UNION ALL ".join(f"SELECT '{{}}' AS query, CAST({i} AS BIGINT) AS parent, {i}.5 AS cardinality".replace("{}", q.replace("'", "''")) for i, q in enumerate(WORKLOAD)))
def scan_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workload file of the queries above."""
    path = f"{scratch_dir(spark)}/workload-{uuid.uuid4().hex}"
    spark.createDataFrame([(f"{q}||{i}||{i}.5",) for i, q in enumerate(WORKLOAD)], "value string").write.text(path)
    return sources.read_workload(spark, path)


@registered("cached_counts", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
def cached_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built and kept at the first call, read at the second."""
    path = f"{scratch_dir(spark)}/cached-{uuid.uuid4().hex}"
    for _ in range(2):
        found = sources.cached(spark, path, lambda: sketches.distinct_rows(table(spark, sf_dir, "orders"), ["o_orderpriority"]))
    return found


@registered("describe_lineitem", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def describe_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.described(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("mean", F.round("mean", 6))


@registered("table_bytes", "SELECT 'p_partkey' AS \"column\", count(*) * 8 AS bytes FROM part UNION ALL SELECT 'p_type', CAST(sum(strlen(p_type)) AS BIGINT) FROM part UNION ALL SELECT 'p_size', count(*) * 4 FROM part")
def table_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.column_bytes(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"))


# Distinct rows and frequencies


@registered("distinct_row_counts", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL")
def distinct_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.distinct_rows(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@registered("key_frequency", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY ALL")
def key_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sketches.distinct_rows(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])
    return sketches.regrouped(both, ["o_custkey"])


@registered("frequency_with_nulls", "SELECT CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS k, count(*) AS count FROM orders GROUP BY ALL")
def frequency_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.distinct_rows(table(spark, sf_dir, "orders").select(F.expr("CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS k")), ["k"])


@registered("topk_categories", "SELECT p_type AS category, count(*) AS count FROM part GROUP BY ALL ORDER BY count DESC, category LIMIT 10")
def topk_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence.top_categories(table(spark, sf_dir, "part"), "p_type", 10)


@registered("column_bounds", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, count(DISTINCT {c}) AS \"distinct\" FROM lineitem" for c in ("l_orderkey", "l_quantity", "l_linenumber")))
def column_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.column_bounds(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity", "l_linenumber"])


@registered("nunique_columns", "SELECT count(DISTINCT o_custkey) AS o_custkey, count(DISTINCT o_orderpriority) AS o_orderpriority, count(DISTINCT o_orderdate) AS o_orderdate FROM orders")
def nunique_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(*[F.count_distinct(c).alias(c) for c in ("o_custkey", "o_orderpriority", "o_orderdate")])


@registered("frequent_keys", "SELECT user_id AS key, count(*) AS v FROM events GROUP BY ALL HAVING count(*) >= 12")
def frequent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.frequent_keys(table(spark, sf_dir, "events"), "user_id", 12)[0]


# Hash functions

_X = residue(encoded("o_orderkey", "int"))


@registered("hash_sign", "SELECT o_orderkey, " + ", ".join(f"CAST({FAMILY.sign('x', 0, r)} AS INTEGER) AS s{r}" for r in range(3)) + f" FROM (SELECT o_orderkey, {_X} AS x FROM orders)")
def hash_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_X).alias("x"))
    return x.select("o_orderkey", *[F.expr(FAMILY.sign("x", 0, r)).cast("int").alias(f"s{r}") for r in range(3)])


@registered("hash_bin", "SELECT o_orderkey, " + ", ".join(f"CAST({FAMILY.bin('x', 0, r, WIDTH)} AS INTEGER) AS b{r}" for r in range(3)) + f" FROM (SELECT o_orderkey, {_X} AS x FROM orders)")
def hash_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_X).alias("x"))
    return x.select("o_orderkey", *[F.expr(FAMILY.bin("x", 0, r, WIDTH)).cast("int").alias(f"b{r}") for r in range(3)])


_WIDE = HashFamily(7, prime=P61)


def _m61(number: str) -> str:
    return polynomial(f"CAST(x AS {number})", _WIDE.coefficients("sign", 0, 0), P61)


@registered("hash_m61", f"SELECT o_orderkey, CAST({_m61('HUGEINT')} AS BIGINT) AS h FROM (SELECT o_orderkey, {residue('o_orderkey', P61)} AS x FROM orders)")
def hash_m61(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(residue("o_orderkey", P61)).alias("x"))
    return x.select("o_orderkey", F.expr(_m61("DECIMAL(38, 0)")).cast("long").alias("h"))


@registered("encode_values", f"SELECT o_orderkey, {encoded('o_orderpriority', 'string', DUCKDB)} AS text, {encoded('o_orderdate', 'timestamp', DUCKDB)} AS at, {encoded('o_totalprice', 'double', DUCKDB)} AS price FROM orders")
def encode_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(encoded("o_orderpriority", "string")).alias("text"), F.expr(encoded("o_orderdate", "timestamp")).alias("at"), F.expr(encoded("o_totalprice", "double")).alias("price"))


_PAIR = (key("l_orderkey", 0, (0,)), key("l_partkey", 1, (1, 2)))


@registered("key_tuple_bin_sign", "SELECT l_orderkey, l_partkey, " + f"CAST(({FAMILY.bin('x', 0, 0, WIDTH)} + {FAMILY.bin('y', 1, 0, WIDTH)}) % {WIDTH} AS INTEGER) AS bin, CAST({FAMILY.sign('x', 0, 0)} * {FAMILY.sign('y', 1, 0)} * {FAMILY.sign('y', 2, 0)} AS BIGINT) AS sign FROM (SELECT l_orderkey, l_partkey, {residue('l_orderkey')} AS x, {residue('l_partkey')} AS y FROM lineitem)")
def key_tuple_bin_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketches.residues(table(spark, sf_dir, "lineitem"), _PAIR, [F.col("l_orderkey"), F.col("l_partkey")])
    return sketches.cells(rows, _PAIR, FAMILY, 1, WIDTH, "own", ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_partkey", "bin", "sign")


# Sketches


def _sketch(name: str, base: str, keys: tuple[KeyUse, ...], method: str, width: int = WIDTH, where: str | None = None, source: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, base)
        if source is not None:
            df = df.selectExpr(*[f"CASE WHEN {k.column} % 7 = 0 THEN NULL ELSE {k.column} END AS {k.column}" for k in keys])
        return sketches.sketch(df, keys, FAMILY, method, DEPTH, width, where)

    registered(name, f"SELECT row, bin, v FROM {oracle.sketch_sql(source or base, keys, FAMILY, method, DEPTH, 1 if method == 'ams' else width, where or 'TRUE')}")(run)


_sketch("sketch_ams", "lineitem", (key("l_orderkey"),), "ams")
_sketch("sketch_count", "lineitem", (key("l_orderkey"),), "count-sketch")
_sketch("sketch_count_pushdown", "lineitem", (key("l_orderkey"),), "count-sketch", where="l_quantity > 30 AND l_returnflag = 'R'")
_sketch("sketch_count_two_keys", "lineitem", _PAIR, "count-sketch")
_sketch("sketch_count_text_key", "orders", (key("o_orderpriority", kind="string"),), "count-sketch", 64)
_sketch("sketch_count_null_keys", "orders", (key("o_custkey"),), "count-sketch", source="(SELECT CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders)")
_sketch("sketch_countmin", "orders", (key("o_custkey"),), "count-min")
_sketch("sketch_degree", "orders", (key("o_custkey"),), "bound-sketch")
_sketch("sketch_degree_two_keys", "lineitem", _PAIR, "bound-sketch")


@registered("sketch_same_sign", f"SELECT a.row, a.bin, a.v, b.v AS neg FROM {oracle.sketch_sql('customer', (key('c_nationkey'),), FAMILY, 'same-sign', DEPTH, 64)} AS a JOIN {oracle.sketch_sql('customer', (key('c_nationkey'),), FAMILY, 'same-sign', DEPTH, 64, 'TRUE', 'neg')} AS b USING (row, bin)")
def sketch_same_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.sketch(table(spark, sf_dir, "customer"), (key("c_nationkey"),), FAMILY, "same-sign", DEPTH, 64)


@registered("sketch_interval", f"SELECT size, row, bin, v FROM {oracle.interval_sql('part', 'p_size', 'int', YEAR_INTERVALS, FAMILY, DEPTH, 1000, True)}")
def sketch_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectivity.interval_cells(table(spark, sf_dir, "part"), "p_size", "int", YEAR_INTERVALS, FAMILY, DEPTH, 1000, True)


@registered("memory_report", " UNION ALL ".join(f"SELECT '{n}' AS sketch, count(*) AS cells, count(*) * 16 AS bytes FROM {oracle.sketch_sql(t, (key(c),), FAMILY, 'count-sketch', DEPTH, WIDTH)}" for n, t, c in (("l_orderkey", "lineitem", "l_orderkey"), ("o_custkey", "orders", "o_custkey"))))
def memory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.memory_report({c: sketches.sketch(table(spark, sf_dir, t), (key(c),), FAMILY, "count-sketch", DEPTH, WIDTH) for t, c in (("lineitem", "l_orderkey"), ("orders", "o_custkey"))})


# Estimates


def _estimate(name: str, sql: str, method: str, how: str | float = 0.5, width: int = WIDTH) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, method=method, how=how, width=width).estimate(sql)

    registered(name, oracle.estimate_sql(sql, RETAIL, FAMILY, method, DEPTH, 1 if method == "ams" else width, how))(run)


_estimate("est_ams_2way", TWO_WAY, "ams")
_estimate("est_count_2way", TWO_WAY, "count-sketch")
_estimate("est_count_2way_max", TWO_WAY, "count-sketch", 1.0)
_estimate("est_count_2way_mean", TWO_WAY, "count-sketch", "mean")
_estimate("est_count_star", STAR, "count-sketch", width=NARROW)
_estimate("est_count_chain_3way", CHAIN, "count-sketch", width=NARROW)
_estimate("est_count_4way", FOUR_WAY, "count-sketch", width=NARROW)
_estimate("est_count_transitive", TRANSITIVE, "count-sketch")
_estimate("est_countmin_2way", TWO_WAY, "count-min")
_estimate("est_self_join", SELF, "count-sketch")
_estimate("est_bound_2way", TWO_WAY, "bound-sketch")
_estimate("est_bound_chain", CHAIN, "bound-sketch", width=NARROW)
_estimate("est_bound_unfiltered", TWO_WAY, "bound-sketch-unfiltered")
_estimate("est_same_sign", TRANSITIVE, "same-sign")
_estimate("est_zero_result", NOTHING, "count-sketch")


@registered("est_single_table", "SELECT CAST(count(*) AS DOUBLE) AS estimate FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def est_single_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a join key there is nothing to sketch: the count by selectivity."""
    return engine(spark, sf_dir).estimate("SELECT COUNT(*) FROM lineitem l WHERE l.l_quantity > 30 AND l.l_returnflag = 'R'")


def _correlation(name: str, how: contraction.Correlation) -> None:
    q = Query.parse(CHAIN)
    a, b = (oracle.relation_sql(q, RETAIL, x, FAMILY, "count-sketch", DEPTH, NARROW) for x in ("o", "c"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, width=NARROW)
        out = how(e.relation(q, "o", "count-sketch"), e.relation(q, "c", "count-sketch"), NARROW)
        return out.where("v <> 0").select("row", "bin", "v")

    registered(name, f"SELECT row, bin, v FROM {oracle.correlate_sql(a, b, NARROW)} WHERE v <> 0")(run)


_correlation("cross_correlation", contraction.correlate)
_correlation("cross_correlation_fft", contraction.correlate_fft)


@registered("hybrid_total", f"SELECT sum(abs(v)) AS total FROM (SELECT 2.0 * v AS v FROM {oracle.sketch_sql('(SELECT user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) < 12))', (key('user_id'),), FAMILY, 'count-sketch', DEPTH, 64)} UNION ALL SELECT 2.0 * v FROM {oracle.sketch_sql('(SELECT user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 12))', (key('user_id'),), FAMILY, 'count-sketch', DEPTH, 64)} UNION ALL SELECT 2.0 * count(*) FROM events GROUP BY user_id HAVING count(*) >= 12)")
def hybrid_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = hybrid.frequent_keys(table(spark, sf_dir, "events"), "user_id", 12)

    def sketched(counts: DataFrame) -> DataFrame:
        return sketches.sketch(counts.withColumnRenamed("key", "user_id"), (key("user_id"),), FAMILY, "count-sketch", DEPTH, 64, count="v")

    one = hybrid.Hybrid(sketched(low), sketched(high), high)
    return (one + one).total()


# Selectivities


def _exact(name: str, sql: str) -> None:
    q = Query.parse(sql)
    ((alias, base),) = q.tables

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kinds = {c: s.kind for c, s in RETAIL.tables[base].columns.items()}
        return selectivity.exact_selectivity(table(spark, sf_dir, base), q.filters[alias], kinds).select(F.round("selectivity", 9).alias("selectivity"))

    registered(name, f"SELECT round(sum(CASE WHEN {oracle.where_sql(RETAIL, base, q.filters[alias])} THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 9) AS selectivity FROM {base}")(run)


_exact("sel_exact_eq", "SELECT * FROM orders o WHERE o.o_orderpriority = '1-URGENT'")
_exact("sel_exact_range", "SELECT * FROM lineitem l WHERE l.l_quantity >= 10 AND l.l_quantity < 25")
_exact("sel_exact_like", "SELECT * FROM part p WHERE p.p_type LIKE 'p%'")


def _sketched(name: str, sql: str, base: str, column: str, sizes: tuple[int, ...], span: tuple[int, int], signed: bool, without: int | None = None) -> None:
    """``span``: the range that the filter means on this table's domain, and the point ``without`` which, for the SQL."""
    q = Query.parse(sql)
    ((alias, _),) = q.tables
    spec = RETAIL.column(base, column)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        built = selectivity.interval_sketch(table(spark, sf_dir, base), column, spec.kind, sizes, FAMILY, DEPTH, 1000, signed)
        return selectivity.sketched_selectivity(built, q.filters[alias], spark, without is not None).select(F.round("selectivity", 9).alias("selectivity"))

    cells = oracle.interval_sql(base, column, spec.kind, sizes, FAMILY, DEPTH, 1000, signed)
    point = None if without is None else oracle.cover_sql(without, without, sizes)
    registered(name, oracle.probe_sql(cells, oracle.cover_sql(*span, sizes), FAMILY, DEPTH, 1000, signed, base, point))(run)


_sketched("sel_countmin_point", "SELECT * FROM part p WHERE p.p_size = 15", "part", "p_size", YEAR_INTERVALS, (15, 15), False)
_sketched("sel_countmin_range", "SELECT * FROM part p WHERE p.p_size >= 7 AND p.p_size < 40", "part", "p_size", YEAR_INTERVALS, (7, 39), False)
_sketched("sel_countsketch_range", "SELECT * FROM part p WHERE p.p_size > 7 AND p.p_size <= 40", "part", "p_size", YEAR_INTERVALS, (8, 40), True)
_sketched("sel_countmin_not_equal", "SELECT * FROM part p WHERE p.p_size > 7 AND p.p_size <= 40 AND p.p_size <> 20", "part", "p_size", YEAR_INTERVALS, (8, 40), False, 20)
_TIME_SPAN = (788918400000000, 794015999999999)
_sketched("sel_countmin_time", "SELECT * FROM orders o WHERE o.o_orderdate >= '1995-01-01'::timestamp AND o.o_orderdate < '1995-03-01'::timestamp", "orders", "o_orderdate", TIME_INTERVALS, _TIME_SPAN, False)


@registered("interval_cover_time", f"SELECT size, bucket FROM {oracle.cover_sql(_TIME_SPAN[0] + 7, _TIME_SPAN[1], TIME_INTERVALS)}")
def interval_cover_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals of a span of two months that begins within a minute."""
    return selectivity.cover_rows(spark, _TIME_SPAN[0] + 7, _TIME_SPAN[1], TIME_INTERVALS)


@registered("interval_cover", "SELECT range AS point, 1 AS times FROM range(3, 1001)")
def interval_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of [3, 1000] that a cover by powers of two reaches, and how often."""
    buckets = selectivity.cover_rows(spark, 3, 1000, POWER_INTERVALS)
    points = buckets.select(F.explode(F.expr("sequence(bucket * size, (bucket + 1) * size - 1)")).alias("point"))
    return points.groupBy("point").agg(F.count(F.lit(1)).cast("int").alias("times"))


# The parser


@registered("parse_relations", "SELECT * FROM (VALUES ('l', 'lineitem'), ('o', 'orders'), ('c', 'customer')) AS t(alias, relation)")
def parse_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(Query.parse(CHAIN).tables), "alias string, relation string")


@registered("parse_joins", "SELECT * FROM (VALUES ('l.l_orderkey', 'o.o_orderkey'), ('o.o_custkey', 'c.c_custkey')) AS t(a, b)")
def parse_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(".".join(j.left), ".".join(j.right)) for j in Query.parse(CHAIN).joins], "a string, b string")


@registered("parse_filters", "SELECT * FROM (VALUES ('c', 'c_mktsegment', '=', 'BUILDING'), ('l', 'l_quantity', '>', '30')) AS t(alias, name, op, value)")
def parse_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(a, p.column, p.op, str(p.value)) for a, ps in Query.parse(CHAIN).filters.items() for p in ps]
    return spark.createDataFrame(found, "alias string, name string, op string, value string")


@registered("join_components", "SELECT * FROM (VALUES ('c.c_nationkey', 0), ('n.n_nationkey', 0), ('s.s_nationkey', 0)) AS t(node, component)")
def join_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(Query.parse(TRANSITIVE).components.items()), "node string, component int")


@registered("workload_keys", "SELECT * FROM (VALUES ('customer', 'key', 'c_custkey'), ('customer', 'key', 'c_nationkey'), ('customer', 'predicate', 'c_mktsegment'), ('lineitem', 'key', 'l_orderkey'), ('lineitem', 'key', 'l_partkey'), ('lineitem', 'key', 'l_suppkey'), ('lineitem', 'predicate', 'l_quantity'), ('nation', 'key', 'n_nationkey'), ('orders', 'key', 'o_custkey'), ('orders', 'key', 'o_orderkey'), ('part', 'key', 'p_partkey'), ('part', 'predicate', 'p_size'), ('supplier', 'key', 's_nationkey'), ('supplier', 'key', 's_suppkey'), ('supplier', 'predicate', 's_acctbal')) AS t(relation, role, name)")
def workload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(workload_columns(list(WORKLOAD)), "relation string, role string, name string")


# Models of a given structure

_LINEITEM = ["l_orderkey", "l_quantity", "l_returnflag"]
_MODEL_SQL = "SELECT COUNT(*) FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 30 AND l.l_returnflag = 'R'"
_L_KEY = (key("l_orderkey"),)


def _model(spark: SparkSession, sf_dir: str, tree: spn.Node, leaves: str = "exact", **how) -> spn.TableModel:
    return spn.TableModel.build(table(spark, sf_dir, "lineitem"), RETAIL.tables["lineitem"], tree, None, leaves, FAMILY, DEPTH, WIDTH, **how)


def _share(where: str, among: str = "TRUE") -> str:
    return f"(SELECT CAST(count(*) FILTER (WHERE {where}) AS DOUBLE) / count(*) FROM lineitem WHERE {among})"


def _independence(name: str, pessimistic: bool) -> None:
    q = Query.parse(_MODEL_SQL)
    parts = (_share("l_quantity > 30"), _share("l_returnflag = 'R'"))
    together = f"least({', '.join(parts)})" if pessimistic else " * ".join(parts)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = _model(spark, sf_dir, spn.independent(_LINEITEM, ("l_orderkey",)), pessimistic=pessimistic)
        return model.relation(_L_KEY, q.filters["l"]).select("row", "bin", F.round("v", 6).alias("v"))

    registered(name, f"SELECT row, bin, round(v * ({together}), 6) AS v FROM {oracle.sketch_sql('lineitem', _L_KEY, FAMILY, 'count-sketch', DEPTH, WIDTH)}")(run)


_independence("spn_independence_sketch", False)
_independence("spn_pessimistic_sketch", True)


def _leaves(name: str, leaves: str) -> None:
    """Filters on quantities by interval sketches of the leaf, whose width is that of the rule for join sketches of WIDTH."""
    q = Query.parse(_MODEL_SQL)
    signed, width = leaves == "count-sketch", selectivity.sketch_width(WIDTH)
    cells = oracle.interval_sql("lineitem", "l_quantity", "double", YEAR_INTERVALS, FAMILY, DEPTH, width, signed)
    # Quantities go from 1 to 50; a double above 30 may have the floor 30.
    share = f"({oracle.probe_sql(cells, oracle.cover_sql(30, 50, YEAR_INTERVALS), FAMILY, DEPTH, width, signed, 'lineitem', digits=None)})"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = _model(spark, sf_dir, spn.independent(_LINEITEM, ("l_orderkey",)), leaves)
        return model.relation(_L_KEY, q.filters["l"]).select("row", "bin", F.round("v", 6).alias("v"))

    together = f"({share} * {_share(chr(108) + '_returnflag = ' + repr('R'))})"
    registered(name, f"SELECT row, bin, round(v * {together}, 6) AS v FROM {oracle.sketch_sql('lineitem', _L_KEY, FAMILY, 'count-sketch', DEPTH, WIDTH)}")(run)


_leaves("spn_countmin_leaves", "count-min")
_leaves("spn_countsketch_leaves", "count-sketch")


def _degrees(name: str, scaled: bool) -> None:
    """Degree sketches under a model, times the filters' probability or as they are."""
    q = Query.parse(_MODEL_SQL)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = _model(spark, sf_dir, spn.independent(_LINEITEM, ("l_orderkey",)), scale_degree=scaled)
        return model.relation(_L_KEY, q.filters["l"], "bound-sketch").select("row", "bin", F.round("v", 6).alias("v"))

    share = f"{_share('l_quantity > 30')} * {_share(chr(108) + '_returnflag = ' + repr('R'))}" if scaled else "1.0"
    registered(name, f"SELECT row, bin, round(v * ({share}), 6) AS v FROM {oracle.sketch_sql('lineitem', _L_KEY, FAMILY, 'bound-sketch', DEPTH, WIDTH)}")(run)


_degrees("spn_degree", True)
_degrees("spn_degree_unscaled", False)


@registered("spn_key_filter", f"SELECT row, bin, CAST(v AS DOUBLE) AS v FROM {oracle.sketch_sql('lineitem', _L_KEY, FAMILY, 'count-sketch', DEPTH, WIDTH, 'l_orderkey < 5000')}")
def spn_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters on a join key are taken on the rows themselves."""
    q = Query.parse("SELECT COUNT(*) FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey AND l.l_orderkey < 5000")
    return _model(spark, sf_dir, spn.independent(_LINEITEM, ("l_orderkey",))).relation(_L_KEY, q.filters["l"])


def _two_clusters_sql() -> str:
    parts = []
    for cut in ("l_linenumber <= 3", "NOT l_linenumber <= 3"):
        cells = oracle.sketch_sql("lineitem", _L_KEY, FAMILY, "count-sketch", DEPTH, WIDTH, cut)
        parts.append(f"SELECT row, bin, v * ({_share('l_quantity > 30', cut)} * {_share(chr(108) + '_returnflag = ' + repr('R'), cut)}) AS v FROM {cells}")
    return f"SELECT row, bin, round(sum(v), 6) AS v FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


@registered("spn_sum_two_clusters", _two_clusters_sql())
def spn_sum_two_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = spn.clustered([*_LINEITEM, "l_linenumber"], ("l_orderkey",), ("l_linenumber <= 3",))
    found = _model(spark, sf_dir, tree).relation(_L_KEY, Query.parse(_MODEL_SQL).filters["l"])
    return found.select("row", "bin", F.round("v", 6).alias("v"))


_TOGETHER = f"{_share('l_quantity > 30')} * {_share(chr(108) + '_returnflag = ' + repr('R'))}"


@registered("spn_estimate_2way", f"SELECT round(estimate, 3) AS estimate FROM ({oracle.summary_sql(oracle.contract_sql(Query.parse(_MODEL_SQL), {'l': '(SELECT row, bin, v * (' + _TOGETHER + ') AS v FROM ' + oracle.sketch_sql('lineitem', _L_KEY, FAMILY, 'count-sketch', DEPTH, WIDTH) + ')', 'o': oracle.relation_sql(Query.parse(_MODEL_SQL), RETAIL, 'o', FAMILY, 'count-sketch', DEPTH, WIDTH)}, DEPTH, WIDTH), 0.5)})")
def spn_estimate_2way(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query.parse(_MODEL_SQL)
    model = _model(spark, sf_dir, spn.independent(_LINEITEM, ("l_orderkey",)))
    found = {"l": model.relation(_L_KEY, q.filters["l"]), "o": engine(spark, sf_dir).relation(q, "o", "count-sketch")}
    return contraction.count_estimate(q, found, DEPTH, WIDTH).select(F.round("estimate", 3).alias("estimate"))


@registered("spn_l1_error", f"SELECT round(sum(abs(coalesce(a.v, 0) - coalesce(b.v * ({_TOGETHER}), 0))), 3) AS l1 FROM {oracle.sketch_sql('lineitem', _L_KEY, FAMILY, 'count-sketch', DEPTH, WIDTH, chr(108) + '_quantity > 30 AND l_returnflag = ' + repr('R'))} AS a FULL JOIN {oracle.sketch_sql('lineitem', _L_KEY, FAMILY, 'count-sketch', DEPTH, WIDTH)} AS b ON a.row = b.row AND a.bin = b.bin")
def spn_l1_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query.parse(_MODEL_SQL)
    model = _model(spark, sf_dir, spn.independent(_LINEITEM, ("l_orderkey",)))
    exact = engine(spark, sf_dir).relation(q, "l", "count-sketch")
    return evaluation.l1_error(exact, model.relation(_L_KEY, q.filters["l"])).select(F.round("l1", 3).alias("l1"))


@registered("spn_learned_estimate")
def spn_learned_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain from learnt models of its three tables."""
    return engine(spark, sf_dir, mode="model").estimate(CHAIN)


# Dependence


@registered("ecdf", "SELECT DISTINCT o_totalprice AS value, round(cume_dist() OVER (ORDER BY o_totalprice), 12) AS ecdf FROM orders")
def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence.ecdf(table(spark, sf_dir, "orders"), "o_totalprice").select("value", F.round("ecdf", 12).alias("ecdf"))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]


@registered("pearson_matrix", " UNION ALL ".join(f"SELECT '{a}' AS col_i, '{b}' AS col_j, round(corr({a}, {b}), 9) AS pearson FROM lineitem" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]))
def pearson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence.pearson_matrix(table(spark, sf_dir, "lineitem"), _NUMERIC).withColumn("pearson", F.round("pearson", 9))


@registered("rdc_matrix")
def rdc_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependence.rdc_rows(table(spark, sf_dir, "lineitem"), RETAIL.tables["lineitem"], ["l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"])


_RANKED = ["l_quantity", "l_extendedprice"]


def _gram_sql(k: int = 3) -> str:
    """Features by window functions; one sum for each pair."""
    ranks = ", ".join(f"cume_dist() OVER (ORDER BY {c}) AS {c}" for c in _RANKED)
    features = [f"sin({c} * {w!r})" for c in _RANKED for w in dependence.rank_weights(c, k)] + ["1.0"]
    named = ", ".join(f"{f} AS f{i}" for i, f in enumerate(features))
    sums = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum(f{i} * f{j}), 3) AS s FROM f" for i in range(len(features)) for j in range(len(features)))
    return f"WITH r AS (SELECT {ranks} FROM lineitem), f AS (SELECT {named} FROM r) {sums}"


@registered("rdc_gram", _gram_sql())
def rdc_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dependence of two columns is computed from: the sums of their features' products, over all rows."""
    features, _ = dependence.table_features(table(spark, sf_dir, "lineitem"), RETAIL.tables["lineitem"], _RANKED, 3)
    return dependence.gram(features).select("i", "j", F.round("s", 3).alias("s"))


@registered("cluster_assign")
def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each leaf of a learnt model of orders."""
    spec = RETAIL.tables["orders"]
    df = table(spark, sf_dir, "orders").select(*spec.columns)
    tree, features = spn.learn(dependence.sample_rows(df, list(spec.columns), 10_000), spec, spec.keys, cluster_first=True)
    return spn.assigned(df, tree, features).groupBy(F.col(f"`leaf_{spn.KEYS}`").alias("leaf")).agg(F.count(F.lit(1)).alias("rows"))


# Evaluation


@registered("true_cardinality", oracle.cardinality_sql(FOUR_WAY, RETAIL))
def true_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).true_cardinality(FOUR_WAY)


@registered("true_cardinality_self", oracle.cardinality_sql(SELF, RETAIL))
def true_cardinality_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).true_cardinality(SELF)


def _error_sql(sql: str, width: int = WIDTH) -> str:
    return f"SELECT estimate, cardinality, greatest(greatest(estimate, 1) / greatest(cardinality, 1), greatest(cardinality, 1) / greatest(estimate, 1)) AS q_error FROM ({oracle.estimate_sql(sql, RETAIL, FAMILY, 'count-sketch', DEPTH, width)}), ({oracle.cardinality_sql(sql, RETAIL)})"


@registered("q_error", " UNION ALL ".join(f"SELECT estimate, cardinality, round(q_error, 9) AS q_error FROM ({_error_sql(s)})" for s in (TWO_WAY, TRANSITIVE)))
def q_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return e.evaluate([(TWO_WAY, None), (TRANSITIVE, None)]).select("estimate", "cardinality", F.round("q_error", 9).alias("q_error"))


@registered("evaluation_totals", f"SELECT count(*) AS queries, round(sum(q), 6) AS total_q_error, round(avg(q), 6) AS mean_q_error FROM ({' UNION ALL '.join(f'SELECT q_error AS q FROM ({_error_sql(s)})' for s in (TWO_WAY, TRANSITIVE))})")
def evaluation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = engine(spark, sf_dir).evaluate([(TWO_WAY, None), (TRANSITIVE, None)])
    return evaluation.totals(results, ["q_error"]).select("queries", F.round("total_q_error", 6).alias("total_q_error"), F.round("mean_q_error", 6).alias("mean_q_error"))


def _slices_sql() -> str:
    asked = [(s, Query.parse(s)) for s in (*WORKLOAD, SELF)]
    rows = " UNION ALL ".join(f"SELECT q_error AS q, {len(x.tables)} AS n, {len(set(x.components.values()))} AS c, {'<' in s or '>' in s} AS ranged FROM ({_error_sql(s, NARROW)})" for s, x in asked)
    labels = "['all', CASE WHEN ranged THEN 'range' ELSE 'equality' END, CASE WHEN c = 1 THEN 'transitive' ELSE 'non-transitive' END, 'tables=' || n]"
    numbers = ", ".join(f"round({f}, 6) AS {n}" for f, n in (("avg(q)", "mean"), ("min(q)", "min"), ("quantile_cont(q, 0.25)", "q25"), ("quantile_cont(q, 0.5)", "q50"), ("quantile_cont(q, 0.75)", "q75"), ("max(q)", "max")))
    return f"WITH s AS (SELECT unnest({labels}) AS slice, q FROM ({rows})) SELECT slice, count(*) AS count, {numbers} FROM s GROUP BY slice"


@registered("q_error_slices", _slices_sql())
def q_error_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.q_error_slices(engine(spark, sf_dir, width=NARROW).evaluate([(s, None) for s in (*WORKLOAD, SELF)]))
    return found.select("slice", "count", *[F.round(c, 6).alias(c) for c in ("mean", "min", "q25", "q50", "q75", "max")])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-way join: estimate, true count, and the factor between them."""
    e = engine(spark, sf_dir)
    estimate, truth = e.estimate(TWO_WAY), e.true_cardinality(TWO_WAY)
    both = estimate.withColumn("one", F.lit(1)).join(truth.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("q_error", evaluation.q_error(F.col("estimate"), F.col("cardinality")))


__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "key_uses"]
