"""Selectivities of predicates: exact, and by count-min or count sketches over intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinia.functions.hashing import HashFamily, encoded, residue
from cardinia.plans.predicates import conjunction, integer_range
from cardinia.plans.query import Predicate


def sketch_width(width: int) -> int:
    """Width of the sketches of filter columns beside join sketches of ``width``."""
    return max(1000, width // 1000)


def exact_selectivity(df: DataFrame, predicates: tuple[Predicate, ...], kinds: dict[str, str]) -> DataFrame:
    """One row, ``selectivity``: the share of all rows (NULLs included) that qualify; 0 of none."""
    hit = F.when(F.expr(conjunction(predicates, kinds)), 1).otherwise(0)
    return df.agg(F.coalesce(F.try_divide(F.sum(hit).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("selectivity"))


def interval_cover(left: int, right: int, sizes: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(size, first, last): intervals [i * size, (i + 1) * size) that cover [left, right].

    Greedily from the left: the largest aligned interval that starts within the range and
    ends less than one smallest interval beyond it, else a smallest one. Runs of one size
    are one entry.
    """
    if left > right:
        raise ValueError("the range is empty")
    sizes = tuple(sorted(set(sizes)))
    step, stop = sizes[0], right + sizes[0]
    at, out = left // step * step, []
    while at <= right:
        size = max((s for s in sizes if left <= at and at % s == 0 and at + s <= stop), default=step)
        # The run ends where a larger interval fits, or where no more of this size do.
        larger = [q for s in sizes if s > size and (q := -(-(at + 1) // s) * s) + s <= stop]
        end = min([*larger, (right // step + 1) * step if size == step else at + (stop - at) // size * size])
        many = max(1, (end - at) // size)
        out.append((size, at // size, at // size + many - 1))
        at += many * size
    return out


@dataclass(frozen=True)
class IntervalSketch:
    """cells (size, row, bin, v) over the intervals of one column, and its domain."""

    cells: DataFrame
    kind: str
    signed: bool
    sizes: tuple[int, ...]
    depth: int
    width: int
    family: HashFamily
    low: int | None
    high: int | None
    rows: int


def _placed(df: DataFrame, family: HashFamily, depth: int, width: int, signed: bool, keep: list[str]) -> DataFrame:
    """row, bin and sign of each (size, bucket)."""
    x = df.withColumn("x", F.expr(residue("bucket")))
    one = [F.struct(F.lit(r).alias("row"), F.expr(family.bin("x", 0, r, width)).cast("int").alias("bin"), (F.expr(family.sign("x", 0, r)) if signed else F.lit(1)).cast("long").alias("sign")) for r in range(depth)]
    return x.select("size", *keep, F.explode(F.array(*one)).alias("s")).select("size", *keep, "s.*")


def interval_cells(df: DataFrame, column: str, kind: str, sizes: tuple[int, ...], family: HashFamily, depth: int, width: int, signed: bool, by: list[str] | None = None) -> DataFrame:
    """(size, row, bin, v): for each interval size, the rows of each interval, hashed; NULLs count nowhere."""
    by = by or []
    values = df.select(*by, F.expr(encoded(f"`{column}`", kind)).alias("value")).where("value IS NOT NULL").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    levels = values.select(*by, "value", "n", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])).alias("size"))
    buckets = levels.withColumn("bucket", F.expr("CAST(floor(value / size) AS BIGINT)")).groupBy(*by, "size", "bucket").agg(F.sum("n").alias("n"))
    return _placed(buckets, family, depth, width, signed, [*by, "bucket", "n"]).groupBy(*by, "size", "row", "bin").agg(F.sum(F.col("sign") * F.col("n")).alias("v"))


def interval_sketch(df: DataFrame, column: str, kind: str, sizes: tuple[int, ...], family: HashFamily, depth: int, width: int, signed: bool = False) -> IntervalSketch:
    """Count-min, or with ``signed`` count sketches, of a column. Needs one pass for its domain."""
    e = F.expr(encoded(f"`{column}`", kind))
    domain = df.agg(F.min(e).alias("low"), F.max(e).alias("high"), F.count(F.lit(1)).alias("rows")).first()
    sizes = tuple(sizes) or (1,)
    return IntervalSketch(interval_cells(df, column, kind, sizes, family, depth, width, signed), kind, signed, sizes, depth, width, family, domain.low, domain.high, domain.rows)


def cover_rows(spark, left: int, right: int, sizes: tuple[int, ...]) -> DataFrame:
    """(size, bucket) of an interval cover; ranges expand on the executors."""
    cover = spark.createDataFrame(interval_cover(left, right, sizes), "size long, lo long, hi long")
    return cover.select("size", F.explode(F.sequence("lo", "hi")).alias("bucket"))


def probe_cells(cells: DataFrame, probes: DataFrame, depth: int, width: int, family: HashFamily, signed: bool, by: list[str] | None = None) -> DataFrame:
    """``hits``: the estimated rows in the probed intervals: per size the least (count-min) or the median of the sketch rows' sums, summed over sizes.

    Cells that the sketch lacks are 0, and so are sketch rows without any cell.
    """
    by = by or []
    asked = _placed(probes, family, depth, width, signed, [])
    found = cells.join(asked, ["size", "row", "bin"]).groupBy(*by, "size", "row").agg(F.sum(F.col("sign") * F.col("v")).cast("double").alias("s"))
    listed = found.groupBy(*by, "size").agg(F.collect_list("s").alias("l"))  # ``depth`` numbers at most
    full = F.sort_array(F.concat("l", F.array_repeat(F.lit(0.0), F.lit(depth) - F.size("l"))))
    middle = (F.get(full, F.lit((depth - 1) // 2)) + F.get(full, F.lit(depth // 2))) / 2
    per_size = listed.select(*by, (middle if signed else F.get(full, F.lit(0))).alias("s"))
    return per_size.groupBy(*by).agg(F.sum("s").alias("hits")) if by else per_size.agg(F.sum("s").alias("hits"))


def sketched_selectivity(s: IntervalSketch, predicates: tuple[Predicate, ...], spark, subtract: bool = False) -> DataFrame:
    """One row, ``selectivity``, between 0 and 1; 1 without predicates, 0 out of the domain.

    <> has no effect; with ``subtract`` its point's own estimate is taken off (not of
    doubles, which count by their floor).
    """
    if not predicates:
        return spark.range(1).select(F.lit(1.0).alias("selectivity"))
    found = None if s.low is None or not s.rows else integer_range(predicates, s.kind, s.low, s.high, subtract and s.kind != "double")
    if found is None:
        return spark.range(1).select(F.lit(0.0).alias("selectivity"))
    hits = probe_cells(s.cells, cover_rows(spark, found[0], found[1], s.sizes), s.depth, s.width, s.family, s.signed)
    hits = hits.select(F.coalesce("hits", F.lit(0.0)).alias("hits"))
    for point in set(found[2]):
        hits = hits.unionByName(probe_cells(s.cells, cover_rows(spark, point, point, s.sizes), s.depth, s.width, s.family, s.signed).select((-F.coalesce("hits", F.lit(0.0))).alias("hits")))
    share = F.sum("hits") / F.lit(float(s.rows))
    return hits.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("selectivity"))
