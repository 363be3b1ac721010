import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardinia.llm import vector_search
from tests.oracle import SMALL, assert_same, connection

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, g int"


def brute(rows, k=5):
    fine = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64))) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({(i, tuple(v)) for i, v in fine if i % 50 == 0}):
        scores = sorted((-int(np.dot(q[1], v)), i) for i, v in fine if i != q[0] and len(v) == len(q[1]))
        out += [(q[0], r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def result(df, **how):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.top_k(df, **how).collect())


def rows_of(n, d=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.normal(0, 0.3, d)], 1, 5, "v", 2) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"block": 40, "group_bytes": 400}, {"bits": 1}, {"bits": 12}])
def test_against_brute_force(spark, how):
    rows = rows_of(400)
    rows += [(1000 + i, rows[7][1], None, None, None, None) for i in range(60)]  # one very common vector: ties
    rows += [(50, rows[50][1], 1, 5, "v", 2), (401, None, *[None] * 4), (402, [1.0, None], *[None] * 4), (403, [float("nan")] * 8, *[None] * 4), (450, [float("inf")] * 8, *[None] * 4)]
    rows += [(None, rows[3][1], *[None] * 4), (500, [], *[None] * 4), (501, [], *[None] * 4), (550, [1.0, 2.0], *[None] * 4), (-50, rows[9][1], *[None] * 4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(df, **how) == brute(rows)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame(rows_of(3), SCHEMA)
    assert result(df) == brute(rows_of(3)) and len(result(df)) == 2
    assert result(df.limit(0)) == []


def test_large_components(spark):
    rows = [(i, [3e15 * (1 + i % 7), -1e15 * i, 5.0], None, None, None, None) for i in range(60)]
    got = vector_search.top_k(spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "CAST(embedding AS ARRAY<FLOAT>) AS embedding")).collect()
    assert len(got) == 10 and all(abs(r.score) <= 2**63 - 1 for r in got)


@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 40), st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_bounds_hold(seed, bits, n, d):
    rng = np.random.default_rng(seed)
    vectors = np.floor(rng.normal(0, 200, (n, d)))
    file = vector_search.ApproximationFile.of(vectors, bits)
    q = np.floor(rng.normal(0, 200, (3, d)))
    low, slack = file.bounds(q)
    exact = q @ vectors.T
    assert (low <= exact).all() and (exact <= low + slack[:, None]).all()


def test_few_exact_vectors_are_read(spark):
    """Of 4,000 candidates for each of 80 queries."""
    rows = rows_of(4000, 16)
    found = vector_search.found_by_tasks(spark.createDataFrame(rows, SCHEMA).repartition(4), "vec_id", "embedding").agg({"reads": "sum"}).first()[0]
    assert 80 * 5 <= found < 80 * 300


def test_equal_rows_and_equal_vectors_do_not_pile_up(spark):
    """A third of all rows repeat one row, another third share its vector: neither makes a large block."""
    rows = rows_of(300)
    rows += [rows[100]] * 300 + [(10_000 + i, rows[100][1], *[None] * 4) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert result(df) == brute(rows)
    few = vector_search.candidates(df.selectExpr("vec_id AS id", "embedding AS v"), 5)
    assert few.count() == 300 and few.selectExpr("max(size(ids))").first()[0] == 6


def test_only_queries_and_scores_move(spark):
    """After the candidates are written, no exact vector goes through a shuffle: the searching plan has none."""
    files = vector_search.approximated(vector_search.candidates(spark.createDataFrame(rows_of(200), SCHEMA).selectExpr("vec_id AS id", "embedding AS v"), 5))
    context = spark.sparkContext
    sent, least = context.broadcast(vector_search._Queries([], 256)), context.broadcast(np.zeros(0))
    plan = vector_search.searched(files, sent, least, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    cells = vector_search.least_scores(files, sent, 5)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"[\[, ]x#", cells) and re.search(r"[\[, ]cells#", cells)


def test_sql(spark):
    assert_same(vector_search.top_k(spark.read.parquet(f"{SMALL}/embeddings.parquet")), vector_search.SQL, connection())
