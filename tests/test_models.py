"""Dependence, clustering, sum-product models and hybrid estimators."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cardinia.catalogue import CHAIN, FAMILY, RETAIL, TWO_WAY, engine, key
from cardinia.operators import clustering, dependence, evaluation, hybrid, selectivity, sketches, spn
from cardinia.plans.dataset import CONTINUOUS, DATASETS, Column, Table
from cardinia.plans.query import Query
from tests.oracle import SMALL

TOY = Table("toy", {"k": Column("int"), "a": Column("double", CONTINUOUS, (1, 2, 4, 8)), "b": Column("double", CONTINUOUS, (1, 2, 4, 8)), "c": Column("string")}, ("k",))


def toy(n=2000, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.uniform(0, 50, n)
    return pd.DataFrame({"k": rng.integers(0, 40, n), "a": a, "b": (a - 25) ** 2 / 10 + rng.normal(0, 0.5, n), "c": rng.choice(list("xyz"), n)})


def test_ecdf_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "x double")
    assert {(r.value, r.ecdf) for r in dependence.ecdf(df, "x").collect()} == {(1.0, 0.25), (2.0, 0.75), (None, 0.0)}
    assert dependence.ecdf(df.limit(0), "x").count() == 0


def test_dependence_is_found_where_correlation_is_not():
    data = toy()
    m = dependence.rdc_matrix(data[["a", "b", "c"]], TOY)
    assert abs(np.corrcoef(data.a, data.b)[0, 1]) < 0.2 < 0.8 < m[0, 1] and m[0, 2] < 0.3
    assert (dependence.rdc_matrix(data.head(200), TOY) == np.eye(4)).all()
    constant = data.assign(a=1.0)
    assert dependence.rdc_matrix(constant[["a", "b"]], TOY)[0, 1] == 0


def test_canonical_correlation():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    assert dependence.canonical_correlation(x, x @ rng.normal(size=(3, 3))) > 0.999
    assert dependence.canonical_correlation(np.zeros((10, 2)), x[:10]) == 0


@pytest.mark.parametrize("how", ["gmm", "kmeans"])
def test_clusters(how):
    x = np.concatenate([np.random.default_rng(0).normal(m, 0.1, (100, 2)) for m in (0, 5)])
    _, labels = clustering.split(x, 2, how)
    assert len(set(labels[:100])) == len(set(labels[100:])) == 1 and labels[0] != labels[-1]
    _, labels = clustering.split(np.zeros((10, 2)), 2, how)
    assert set(labels) == {0}  # nothing to cut by
    cut = clustering.median_cut(np.array([[0.0, 5.0], [0.0, 9.0], [0.0, 9.0], [0.1, 9.0]]))
    assert cut.labels(np.array([[0.0, 5.0], [0.0, 9.0]])).tolist() == [0, 1]


def test_keys_stay_together():
    groups = spn.column_groups(["k", "a", "j", "b"], ("k", "j"), np.array([[1, 0.9, 0, 0], [0.9, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]), 0.5)
    assert groups == [["k", "a", "j"], ["b"]]


@pytest.mark.parametrize("options", [{}, {"cluster_first": True}, {"threshold": -1.0, "how": "kmeans"}, {"min_cluster": 1.0}])
def test_learnt_models_assign_every_row_to_a_leaf_for_each_column(spark, options):
    data = toy()
    tree, features = spn.learn(data, TOY, TOY.keys, **options)
    df = spark.createDataFrame(data)
    out = spn.assigned(df, tree, features).toPandas()
    leaves = {n.number: n for n in tree.walk() if n.kind in ("leaf", "keys")}
    assert len(out) == len(data)
    for c in ("a", "b", "c", spn.KEYS):
        assert all(("k" if c == spn.KEYS else c) in leaves[x].columns for x in out[f"leaf_{c}"].unique())


def test_learnt_models_know_dependent_columns(spark):
    data = toy()
    df = spark.createDataFrame(data)
    q = Query.parse("SELECT COUNT(*) FROM toy t WHERE t.a > 40 AND t.b > 20")
    truth = ((data.a > 40) & (data.b > 20)).mean()
    tree, features = spn.learn(data, TOY, TOY.keys, threshold=0.3, min_cluster=0.02)
    learnt = spn.TableModel.build(df, TOY, tree, features).selectivity(q.filters["t"])
    alone = spn.TableModel.build(df, TOY, spn.independent(list(TOY.columns), TOY.keys)).selectivity(q.filters["t"])
    assert abs(learnt - truth) < abs(alone - truth)
    for method in ("count-min", "count-sketch"):
        assert abs(spn.TableModel.build(df, TOY, tree, features, method).selectivity(q.filters["t"]) - truth) < 0.2


def test_one_leaf_is_the_exact_sketch(spark):
    df = spark.createDataFrame(toy())
    model = spn.TableModel.build(df, TOY, spn.independent(["k"], ("k",)), None, "exact", FAMILY, 3, 64)
    exact = sketches.sketch(df, (key("k"),), FAMILY, "count-sketch", 3, 64)
    assert evaluation.l1_error(exact, model.relation((key("k"),))).first()[0] == 0


def test_filters_on_keys_are_exact(spark):
    df = spark.createDataFrame(toy())
    q = Query.parse("SELECT COUNT(*) FROM toy t WHERE t.k < 10")
    model = spn.TableModel.build(df, TOY, spn.independent(["k", "a"], ("k",)), None, "exact", FAMILY, 3, 64)
    exact = sketches.sketch(df, (key("k"),), FAMILY, "count-sketch", 3, 64, "k < 10")
    assert evaluation.l1_error(exact, model.relation((key("k"),), q.filters["t"])).first()[0] == 0


def test_pessimistic_is_the_least(spark):
    df = spark.createDataFrame(toy())
    q = Query.parse("SELECT COUNT(*) FROM toy t WHERE t.a > 40 AND t.c = 'x'")
    tree = spn.independent(list(TOY.columns), TOY.keys)
    p = spn.TableModel.build(df, TOY, tree, pessimistic=True).selectivity(q.filters["t"])
    data = toy()
    assert p == pytest.approx(min((data.a > 40).mean(), (data.c == "x").mean()))


def test_engine_with_models(spark):
    e = engine(spark, SMALL, mode="model", selectivity="exact")
    truth = e.true_cardinality(TWO_WAY).first()[0]
    assert 1 / 3 < e.estimate(TWO_WAY).first()[0] / truth < 3
    report = e.diagnose(TWO_WAY).toPandas()
    assert list(report.alias) == ["l", "o"] and (report.l1 >= 0).all()


def test_a_models_leaves_are_sketched_once(spark):
    """A second query on the same keys, with other filters, reads no row of the table again."""
    df = spark.createDataFrame(toy())
    for method in ("exact", "count-min"):
        model = spn.TableModel.build(df, TOY, spn.independent(list(TOY.columns), TOY.keys), None, method, FAMILY, 3, 64)
        first, second = (Query.parse(f"SELECT COUNT(*) FROM toy t WHERE t.a > {n} AND t.c = '{c}'").filters["t"] for n, c in ((10, "x"), (40, "y")))
        model.relation((key("k"),), first).count()
        wanted = model.relation((key("k"),), second).toPandas().sort_values(["row", "bin"])
        model.rows = None
        again = model.relation((key("k"),), second).toPandas().sort_values(["row", "bin"])
        assert (wanted.v.to_numpy() == again.v.to_numpy()).all()


def test_degrees_may_stay_unscaled(spark):
    df = spark.createDataFrame(toy())
    q = Query.parse("SELECT COUNT(*) FROM toy t WHERE t.a > 40")
    tree = spn.independent(list(TOY.columns), TOY.keys)
    whole, scaled = (spn.TableModel.build(df, TOY, tree, None, "exact", FAMILY, 3, 64, scale_degree=s).relation((key("k"),), q.filters["t"], "bound-sketch").agg({"v": "sum"}).first()[0] for s in (False, True))
    share = (toy().a > 40).mean()
    assert scaled == pytest.approx(whole * share)


def test_the_cache_knows_settings_and_rows(spark, tmp_path):
    def leaves(**how):
        e = engine(spark, SMALL, mode="model", cache_dir=str(tmp_path), **how)
        e.model("customer")
        return e

    leaves()
    one = set(os.listdir(tmp_path))
    leaves()
    assert set(os.listdir(tmp_path)) == one and len(one) == 1
    leaves(k=3, rdc_threshold=-1.0)
    assert len(os.listdir(tmp_path)) == 2
    e = engine(spark, SMALL, mode="model", cache_dir=str(tmp_path))
    e.tables["customer"] = e.tables["customer"].withColumn("c_acctbal", F.col("c_acctbal") + 1)  # as many rows, but others
    e.model("customer")
    assert len(os.listdir(tmp_path)) == 3


def test_whole_tables_give_the_dependence_matrix(spark):
    data = toy()
    found = {(r.col_i, r.col_j): r.rdc for r in dependence.rdc_rows(spark.createDataFrame(data).repartition(3), TOY, ["k", "a", "b", "c"]).collect()}
    assert found["a", "b"] > 0.8 > 0.35 > max(found["a", "c"], found["b", "c"], found["k", "c"])
    features, having = dependence.table_features(spark.createDataFrame(data), TOY, ["a", "c"], k=3)
    assert having == ["a", "c"] and features.count() == len(data)
    ranks = data.a.rank(method="max") / len(data)
    want = np.sort(np.sin(ranks * dependence.rank_weights("a", 3)[0]))
    assert np.allclose(np.sort(features.toPandas()["a_0"]), want)
    assert dependence.rdc_rows(spark.createDataFrame(data.head(0), "k long, a double, b double, c string"), TOY, ["a", "c"]).first().rdc == 0


def test_negated_points_are_subtracted(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1, 2, 3, 4, 5, 6, 7, 8] * 25}))
    built = selectivity.interval_sketch(df, "x", "int", (1, 2, 4), FAMILY, 5, 1000)
    ps = Query.parse("SELECT COUNT(*) FROM t WHERE t.x > 2 AND t.x <> 5 AND t.x <> 5".replace("FROM t ", "FROM t t ")).filters["t"]
    assert selectivity.sketched_selectivity(built, ps, spark).first()[0] == pytest.approx(0.75)
    assert selectivity.sketched_selectivity(built, ps, spark, True).first()[0] == pytest.approx(0.625)


@pytest.mark.parametrize(("left", "right", "sizes"), [(3, 1000, (1, 2, 4, 8, 16)), (7, 7, (5, 10)), (0, 0, (1,)), (-13, 29, (1, 4, 8)), (10**9, 5 * 10**9, (60, 300, 600)), (5, 10**12, (1,)), (8, 31, (1, 2, 4, 8, 16, 32))])
def test_covers_reach_every_point_once(left, right, sizes):
    cover = selectivity.interval_cover(left, right, sizes)
    spans = [(s * a, s * (b + 1)) for s, a, b in cover]
    assert spans[0][0] == left // sizes[0] * sizes[0] and right < spans[-1][1] <= right + sizes[0]
    assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(a <= b and (s == sizes[0] or s * a >= left) for s, a, b in cover)


def test_evaluate_and_report(spark):
    results = engine(spark, SMALL).evaluate([(TWO_WAY, None), (CHAIN, 10.0)])
    assert results.where("q_error < 1").count() == 0
    slices = {r.slice: r["count"] for r in evaluation.q_error_slices(results).collect()}
    assert slices == {"all": 2, "range": 2, "transitive": 1, "non-transitive": 1, "tables=2": 1, "tables=3": 1}
    assert evaluation.totals(results, ["sketching_s", "inference_s", "estimation_s"]).first().queries == 2


def test_hybrid_algebra(spark):
    cell = spark.createDataFrame([(0, 0, 2.0), (0, 1, -3.0)], "row int, bin int, v double")
    exact = spark.createDataFrame([(7, 4.0)], "key long, v double")
    a = hybrid.Hybrid(cell, cell, exact)
    assert (a + a).total().first()[0] == 28 and (a * a).total().first()[0] == 42
    assert (a / a).total().first()[0] == 5 and (2 * a).total().first()[0] == 28 and (a / 2).total().first()[0] == 7
    r = a.compared(14).first()
    assert (r.lt, r.le, r.gt, r.ge, r.eq) == (False, True, False, True, True)
    assert hybrid.Hybrid(cell, cell, exact, True, False).__mul__(0.5).total().first()[0] == 14


def test_configurations():
    assert {n: len(f().tables) for n, f in DATASETS.items()} == {"stats-ceb": 8, "job-light": 6, "retail": 8}
    stats = DATASETS["stats-ceb"]()
    assert stats.tables["posts"].keys == ("OwnerUserId", "Id") and stats.tables["users"].dates == ("CreationDate",)
    assert DATASETS["job-light"]().tables["title"].fields[1] == "title"
    with pytest.raises(ValueError):
        stats.column("posts", "Nothing")
    with pytest.raises(ValueError):
        Table("t", {}, ("k",))


def test_pearson(spark):
    df = spark.createDataFrame(toy())
    r = dependence.pearson_matrix(df, ["a", "b"]).first()
    assert r.pearson == pytest.approx(np.corrcoef(toy().a, toy().b)[0, 1])
    assert df.agg(F.count("a")).first()[0] == 2000
