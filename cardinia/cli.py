"""Command line: estimate a workload and report its errors."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cardinia.engine import METHODS, Engine
from cardinia.operators import evaluation
from cardinia.plans.dataset import DATASETS
from cardinia.plans.query import workload_columns
from cardinia.sources import tables as sources


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cardinia", description=__doc__)
    p.add_argument("--method", choices=METHODS, default="count-sketch")
    p.add_argument("--depth", type=int, default=5)
    p.add_argument("--width", type=int, default=100_000)
    p.add_argument("--workload", required=True, help="lines of query||parent||cardinality")
    p.add_argument("--data", help="folder with one file for each table")
    p.add_argument("--format", choices=("parquet", "csv"), default="csv")
    p.add_argument("--writefile", help="folder for the results as CSV")
    p.add_argument("--k", type=int, default=2, help="clusters of a sum node")
    p.add_argument("--rdc_threshold", "--decompose", type=float, default=0.01)
    p.add_argument("--min_cluster", type=float, default=0.1)
    p.add_argument("--cluster_first", action="store_true")
    p.add_argument("--experiment", choices=sorted(DATASETS), default="stats-ceb")
    p.add_argument("--find_keys", action="store_true", help="report the columns that the workload uses, and stop")
    p.add_argument("--independence", type=int, default=4, help="of the sign hashes")
    p.add_argument("--pessimistic", action="store_true", help="least probability instead of the product; the largest estimate")
    p.add_argument("--exact_sketch", action="store_true", help="sketch filtered rows instead of learning models")
    p.add_argument("--percentile", type=float, default=0.5)
    p.add_argument("--mean", action="store_true")
    p.add_argument("--kmeans", action="store_true")
    p.add_argument("--same_sign", action="store_true")
    p.add_argument("--exact_degree", action="store_true", help="bound-sketch-unfiltered: filter the degrees, too")
    p.add_argument("--unscaled_degree", action="store_true", help="keep models' degree sketches as they are under filters")
    p.add_argument("--selectivity_estimator", choices=("exact", "count-min", "count-sketch"), default="count-min")
    p.add_argument("--check_error", action="store_true", help="compare the models' sketches with exact ones")
    p.add_argument("--pickle", help="folder that keeps the models' tables for later runs")
    p.add_argument("--sparse", action="store_true", help="accepted for compatibility: sketches are always sparse")
    p.add_argument("--cuda", action="store_true", help="accepted for compatibility: there is no other device than the executors")
    p.add_argument("--seed", type=int, default=1)
    return p


def run(spark: SparkSession, arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    workload = sources.read_workload(spark, a.workload)
    queries = [(r.query, r.cardinality) for r in workload.collect()]  # a list of queries
    if a.find_keys:
        spark.createDataFrame(workload_columns([q for q, _ in queries]), "table string, role string, column string").show(1000, False)
        return
    dataset = DATASETS[a.experiment]()
    engine = Engine(
        spark, dataset, sources.read_dataset(spark, a.data, dataset, a.format), "same-sign" if a.same_sign else a.method, a.depth, a.width,
        "exact" if a.exact_sketch else "model", "mean" if a.mean else a.percentile, a.seed, a.independence, a.selectivity_estimator, a.pessimistic,
        a.k, a.rdc_threshold, a.min_cluster, a.cluster_first, "kmeans" if a.kmeans else "gmm", a.exact_degree, cache_dir=a.pickle, scale_degree=not a.unscaled_degree,
    )
    results = engine.evaluate(queries)
    results.show(20, False)
    evaluation.q_error_slices(results).orderBy("slice").show(100, False)
    evaluation.totals(results, ["sketching_s", "inference_s", "estimation_s"]).show()
    if a.check_error:
        for sql, _ in queries:
            engine.diagnose(sql).show(100, False)
    if a.writefile:
        sources.write_csv(results, a.writefile)


if __name__ == "__main__":
    run(SparkSession.builder.appName("cardinia").config("spark.sql.session.timeZone", "UTC").getOrCreate())
