"""True cardinalities, q-errors and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardinia.plans.predicates import conjunction
from cardinia.plans.query import Query


def true_cardinality(query: Query, tables: dict[str, DataFrame], kinds: dict[str, dict[str, str]]) -> DataFrame:
    """``cardinality``, by joining. Only key columns are carried, grouped first with their multiplicities, so that hot keys do not multiply rows."""
    names = dict(query.tables)
    done: DataFrame | None = None
    placed: set[str] = set()
    waiting = [a for a, _ in query.tables]

    def relation(alias: str) -> DataFrame:
        keys = sorted(query.joined[alias])
        df = tables[names[alias]].where(F.expr(conjunction(query.filters.get(alias, ()), kinds[names[alias]])))
        for k in keys:
            df = df.where(F.col(k).isNotNull())
        return df.groupBy(*[F.col(k).alias(f"{alias}.{k}") for k in keys]).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias(f"#{alias}"))

    while waiting:
        ready = next((a for a in waiting if done is None or any(n.split(".")[0] in placed for k in query.joined[a] for n in query.joined_with(f"{a}.{k}"))), None)
        if ready is None:
            raise ValueError("the join graph is not connected")
        one = relation(ready)
        if done is None:
            done = one.withColumn("#", F.col(f"#{ready}")).drop(f"#{ready}")
        else:
            on = [F.col(f"`{ready}.{k}`") == F.col(f"`{n}`") for k in query.joined[ready] for n in query.joined_with(f"{ready}.{k}") if n.split(".")[0] in placed]
            condition: Column = on[0]
            for c in on[1:]:
                condition &= c
            done = done.join(one, condition).withColumn("#", (F.col("#") * F.col(f"`#{ready}`")).cast("decimal(38,0)")).drop(f"#{ready}")
        placed.add(ready)
        waiting.remove(ready)
        # Columns that only joins already made needed.
        needed = {f"{a}.{k}" for a in placed for k in query.joined[a] if any(n.split(".")[0] in waiting for n in query.joined_with(f"{a}.{k}"))}
        done = done.groupBy(*[F.col(f"`{c}`") for c in sorted(needed)]).agg(F.sum("#").cast("decimal(38,0)").alias("#"))
    return done.agg(F.coalesce(F.sum("#").cast("double"), F.lit(0.0)).alias("cardinality"))


def q_error(estimate: Column, cardinality: Column) -> Column:
    """The factor between the two, each counted as 1 at least."""
    e, c = F.greatest(estimate, F.lit(1.0)), F.greatest(cardinality, F.lit(1.0))
    return F.greatest(e / c, c / e)


def query_features(workload: DataFrame) -> DataFrame:
    """num_tables, components and range (whether a query has < or >) of each query, from its text."""

    def read(batches):
        for b in batches:
            parsed = [Query.parse(sql) for sql in b["query"]]
            b["num_tables"] = [len(q.tables) for q in parsed]
            b["components"] = [len(set(q.components.values())) for q in parsed]
            b["ranged"] = ["<" in sql or ">" in sql for sql in b["query"]]
            yield b

    more = [("num_tables", T.IntegerType()), ("components", T.IntegerType()), ("ranged", T.BooleanType())]
    schema = T.StructType([*workload.schema.fields, *[T.StructField(n, t) for n, t in more]])
    return workload.mapInPandas(read, schema)


def q_error_slices(results: DataFrame) -> DataFrame:
    """count, mean, min, quartiles and max of q_error: of all queries, of equality and range ones, of transitive and other ones, and by number of tables."""
    results = results.where("num_tables > 0")
    slices = F.array(
        F.lit("all"),
        F.when(F.col("ranged"), F.lit("range")).otherwise(F.lit("equality")),
        F.when(F.col("components") == 1, F.lit("transitive")).otherwise(F.lit("non-transitive")),
        F.concat(F.lit("tables="), F.col("num_tables").cast("string")),
    )
    q = F.percentile("q_error", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        results.select(F.explode(slices).alias("slice"), "q_error")
        .groupBy("slice")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("q_error").alias("mean"), F.min("q_error").alias("min"), q.alias("q"), F.max("q_error").alias("max"))
        .select("slice", "count", "mean", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")
    )


def l1_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """``l1``: the sum of the differences of two sketches' cells."""
    both = a.select("row", "bin", F.col("v").cast("double").alias("a")).join(b.select("row", "bin", F.col("v").cast("double").alias("b")), ["row", "bin"], "full")
    return both.agg(F.coalesce(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))), F.lit(0.0)).alias("l1"))


def totals(results: DataFrame, times: list[str]) -> DataFrame:
    """Sum and mean of the time columns (seconds), over processed queries."""
    aggs = [f(c).alias(f"{n}_{c}") for c in times for n, f in (("total", F.sum), ("mean", F.avg))]
    return results.where("num_tables > 0").agg(F.count(F.lit(1)).alias("queries"), *aggs)
