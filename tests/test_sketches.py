"""Invariants of sketches, selectivities and contraction."""

import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardinia.catalogue import CHAIN, FAMILY, RETAIL, TRANSITIVE, TWO_WAY, engine, key
from cardinia.functions.hashing import P31, HashFamily
from cardinia.operators import contraction, selectivity, sketches
from cardinia.plans.query import Query
from tests.oracle import SMALL


def orders(spark):
    return spark.read.parquet(f"{SMALL}/orders.parquet")


def test_count_min_rows_hold_all_rows(spark):
    df = orders(spark).withColumn("o_custkey", F.expr("CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END"))
    n = df.where("o_custkey IS NOT NULL").count()
    s = sketches.sketch(df, (key("o_custkey"),), FAMILY, "count-min", 3, 64)
    assert {r.s for r in s.groupBy("row").agg(F.sum("v").alias("s")).collect()} == {n}


def test_degrees_do_not_exceed_counts(spark):
    both = [sketches.sketch(orders(spark), (key("o_custkey"),), FAMILY, m, 3, 64) for m in ("bound-sketch", "count-min")]
    joined = both[0].withColumnRenamed("v", "d").join(both[1], ["row", "bin"])
    assert joined.where("d > v").count() == 0 and joined.count() == both[1].count()


def test_tug_of_war_is_the_sum_of_signs(spark):
    ams = {r.row: r.v for r in sketches.sketch(orders(spark), (key("o_custkey"),), FAMILY, "ams", 3).collect()}
    wide = sketches.sketch(orders(spark), (key("o_custkey"),), FAMILY, "count-sketch", 3, 64)
    assert ams == {r.row: r.s for r in wide.groupBy("row").agg(F.sum("v").alias("s")).collect()}


def test_multiplicities_count(spark):
    counts = sketches.distinct_rows(orders(spark), ["o_custkey"])
    a = sketches.sketch(orders(spark), (key("o_custkey"),), FAMILY, "count-sketch", 3, 64)
    b = sketches.sketch(counts, (key("o_custkey"),), FAMILY, "count-sketch", 3, 64, count="count")
    assert sorted(a.collect()) == sorted(b.collect())


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        sketches.sketch(orders(spark), (key("o_custkey"),), FAMILY, "nothing")


def test_signs_and_bins_are_balanced(spark):
    x = spark.range(20000).select(F.expr(f"(id + 1) % {P31}").alias("x"))
    r = x.agg(F.avg(F.expr(FAMILY.sign("x", 0, 0))).alias("sign"), F.avg(F.expr(FAMILY.bin("x", 0, 0, 100))).alias("bin")).first()
    assert abs(r.sign) < 0.05 and abs(float(r.bin) - 49.5) < 2


def test_independence_is_a_parameter():
    assert len(HashFamily(1, sign_k=6).coefficients("sign", 0, 0)) == 6
    assert HashFamily(1).coefficients("sign", 0, 0) != HashFamily(2).coefficients("sign", 0, 0)


@given(st.integers(-500, 500), st.integers(0, 700), st.sampled_from([(1,), (1, 2, 4, 8, 16), (1, 5, 10, 30), (3, 12, 60)]))
@settings(max_examples=200, deadline=None)
def test_covers_reach_the_range_and_little_more(left, length, sizes):
    right = left + length
    cover = selectivity.interval_cover(left, right, sizes)
    points = [p for s, a, b in cover for i in range(a, b + 1) for p in range(i * s, (i + 1) * s)]
    assert len(points) == len(set(points))
    assert set(range(left, right + 1)) <= set(points)
    assert min(points) > left - min(sizes) and max(points) < right + 2 * min(sizes)


def test_selectivity_out_of_the_domain_and_without_predicates(spark):
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    s = selectivity.interval_sketch(part, "p_size", "int", (1, 4, 16), FAMILY, 3, 1000)
    far = Query.parse("SELECT * FROM part p WHERE p.p_size > 100000").filters["p"]
    assert selectivity.sketched_selectivity(s, far, spark).first()[0] == 0.0
    assert selectivity.sketched_selectivity(s, (), spark).first()[0] == 1.0
    every = Query.parse("SELECT * FROM part p WHERE p.p_size >= 0").filters["p"]
    assert selectivity.sketched_selectivity(s, every, spark).first()[0] == 1.0
    none = selectivity.interval_sketch(part.limit(0), "p_size", "int", (1, 4), FAMILY, 3, 1000)
    assert selectivity.sketched_selectivity(none, every, spark).first()[0] == 0.0


def test_count_min_never_underestimates(spark):
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    ps = Query.parse("SELECT * FROM part p WHERE p.p_size >= 5 AND p.p_size <= 23").filters["p"]
    exact = selectivity.exact_selectivity(part, ps, {"p_size": "int"}).first()[0]
    s = selectivity.interval_sketch(part, "p_size", "int", (1, 2, 4, 8), FAMILY, 5, 1000)
    assert exact - 1e-9 <= selectivity.sketched_selectivity(s, ps, spark).first()[0] <= exact + 0.05


def test_both_correlations_agree(spark):
    q = Query.parse(CHAIN)
    e = engine(spark, SMALL, width=128)
    s = [e.relation(q, a, "count-sketch") for a in ("o", "c")]
    got = [sorted((r.row, r.bin, r.v) for r in f(*s, 128).collect() if r.v) for f in (contraction.correlate, contraction.correlate_fft)]
    assert got[0] == got[1] and got[0]


def test_the_root_does_not_matter(spark, monkeypatch):
    q = Query.parse(CHAIN)
    e = engine(spark, SMALL, width=64)
    s = {a: e.relation(q, a, "count-sketch") for a, _ in q.tables}
    found = set()
    for node in q.nodes:
        monkeypatch.setattr(Query, "root", lambda self, n=node: n)
        found.add(tuple(sorted((r.row, r.v) for r in contraction.contract(q, s, 64).collect())))
    assert len(found) == 1


@pytest.mark.parametrize("sql", [TWO_WAY, CHAIN, TRANSITIVE])
def test_bounds_hold(spark, sql):
    truth = engine(spark, SMALL).true_cardinality(sql).first()[0]
    for method in ("bound-sketch", "bound-sketch-unfiltered", "count-min"):
        assert engine(spark, SMALL, method=method, width=256).estimate(sql).first()[0] >= truth


def test_two_way_estimates_are_close(spark):
    truth = engine(spark, SMALL).true_cardinality(TWO_WAY).first()[0]
    errors = [abs(engine(spark, SMALL, seed=s).estimate(TWO_WAY).first()[0] - truth) / truth for s in range(3)]
    assert statistics.median(errors) < 0.25


def test_estimates_of_no_rows_are_zero(spark):
    none = "SELECT COUNT(*) FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 10000"
    for method in ("ams", "count-sketch", "count-min", "bound-sketch", "same-sign"):
        assert engine(spark, SMALL, method=method).estimate(none).first()[0] == 0.0
    assert engine(spark, SMALL).true_cardinality(none).first()[0] == 0.0


def test_cyclic_graphs_are_refused(spark):
    with pytest.raises(ValueError):
        engine(spark, SMALL).estimate("SELECT COUNT(*) FROM events a, events b WHERE a.user_id = b.user_id AND a.event_id = b.event_id")


def test_one_table(spark):
    sql = "SELECT COUNT(*) FROM orders o WHERE o.o_totalprice > 1000"
    assert engine(spark, SMALL).estimate(sql).first()[0] == orders(spark).where("o_totalprice > 1000").count()


def test_unfiltered_sketches_are_kept(spark):
    e = engine(spark, SMALL)
    q = Query.parse(TWO_WAY)
    assert e.relation(q, "o", "count-sketch") is e.relation(q, "o", "count-sketch")
    assert RETAIL.tables["orders"].keys == ("o_orderkey", "o_custkey")
