"""Reading tables and workloads, writing results, and the cache of derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardinia.plans.dataset import Dataset, Table

_TYPES = {"int": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp": T.StringType()}


def _schema(table: Table, header: list[str] | None) -> T.StructType:
    fields = list(table.fields or header or table.columns)
    return T.StructType([T.StructField(f, _TYPES[table.columns[f].kind] if f in table.columns else T.StringType()) for f in fields])


def read_csv(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """The configured columns of a CSV file, in the configured order.

    Backslash escapes, UTF-8; malformed lines are left out, and so are timestamps that
    cannot be read (NULL). Files without a header are named by ``table.fields``; of the
    others only the first line is looked at for the order of their columns.
    """
    reader = spark.read.option("escape", "\\").option("encoding", "UTF-8").option("mode", "DROPMALFORMED")
    header = None
    if table.fields is None:
        header = reader.option("header", True).csv(path).columns  # names only
        reader = reader.option("header", True).option("enforceSchema", True)
    raw = reader.schema(_schema(table, header)).csv(path)
    return raw.select(*[typed(c, spec.kind) for c, spec in table.columns.items()])


def typed(name: str, kind: str) -> Column:
    """A column read as text, in its kind; timestamps that cannot be read are NULL."""
    return F.expr(f"TRY_CAST(try_to_timestamp(`{name}`) AS TIMESTAMP_NTZ)").alias(name) if kind == "timestamp" else F.col(name)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_dataset(spark: SparkSession, folder: str, dataset: Dataset, form: str = "parquet") -> dict[str, DataFrame]:
    """Every table of the dataset from ``folder``/<name>.<form>, with its configured columns only."""
    if form == "parquet":
        return {n: read_parquet(spark, f"{folder}/{n}.parquet", list(t.columns)) for n, t in dataset.tables.items()}
    if form == "csv":
        return {n: read_csv(spark, f"{folder}/{n}.csv", t) for n, t in dataset.tables.items()}
    raise ValueError(f"no reader for {form}")


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    """query, parent, cardinality from lines ``query||parent||cardinality``."""
    raw = spark.read.schema("query string, gap1 string, parent long, gap2 string, cardinality double").option("sep", "|").option("quote", "").csv(path)
    return raw.select("query", "parent", "cardinality")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def cached(spark: SparkSession, path: str, build, rows: int | None = None) -> DataFrame:
    """The table at ``path`` if it is there (and has ``rows`` rows, if given); else it is built and written."""
    try:
        found = spark.read.parquet(path)
        if rows is None or found.count() == rows:
            return found
    except Exception as e:  # noqa: BLE001  only a missing path means a missing cache
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each numeric column: count, mean, min, quartiles, max."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.min(x).alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(x).alias("max")))
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def column_bytes(df: DataFrame) -> DataFrame:
    """Bytes that each column's values take: text by its UTF-8 length, others by their width."""
    width = {"int": 4, "bigint": 8, "double": 8, "float": 4, "timestamp_ntz": 8, "timestamp": 8, "boolean": 1, "date": 4}
    one = [F.struct(F.lit(c).alias("column"), F.coalesce(F.sum(F.octet_length(c)) if k in ("string", "binary") else F.count(F.lit(1)) * F.lit(width.get(k, 16)), F.lit(0)).cast("long").alias("bytes")) for c, k in df.dtypes]
    return df.agg(F.array(*one).alias("a")).select(F.explode("a").alias("s")).select("s.*")
