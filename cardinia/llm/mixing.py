"""Mixing sources to target weights by a low-discrepancy schedule.

* Targets: sources in code point order (null last) weigh 3, 1, 2, 3, ...; together they
  share 150 % of all words, each at most twice its own, the excess reshared by weight.
  That is a water level: target = min(cap, level * weight), and the level is the largest
  of those that the sources give when taken by cap / weight.
* Blocks: a source's documents are shuffled by md5 of id and size and laid end to end;
  every ``block`` words are a block. Documents that agree in both lie side by side, and
  are one row until their places are known.
* Schedule: slot t maps the golden-ratio point frac(t / phi), in integers, through the
  cumulative targets to a source; the slot's rank among its source's slots says which
  block it takes: rank mod blocks, in pass rank div blocks. Ranks are counted in chunks
  of slots, so a source with a third of the slots is still ranked by many tasks.

A document's taken words are the words of it in the blocks that the slots take, repeats
counted. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardinia.llm import skew
from cardinia.llm._util import WORDS, id_text, text_or_empty, written
from cardinia.llm.sharding import bucket_digits

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Words of a block.
BLOCK = 64
#: 2 ** 31 / golden ratio, to the nearest odd number: t * GOLDEN mod 2 ** 31 visits every point once.
GOLDEN, POINTS = 1327217885, 1 << 31
#: Slots of a chunk.
CHUNK = 8192
#: The circle of points is cut in this many cells to look up a point's source by an equi-join.
CELLS = 1024


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row for all documents that agree in id, source and size, with their number (__times)."""
    sized = _sized(docs, id_col, text_col, source_col)
    return sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("__times"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")).alias("__skey"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORDS)).cast("long").alias("__size"),
    ).withColumn("__hash", F.md5(F.concat_ws("/", id_text("__id"), F.col("__size").cast("string"))))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row for each source: __skey, __rank (from 0), __words, __target, and the points __lo <= u < __hi that are its own.

    The window has one row for each source, nothing that grows with the rows.
    """
    by_source = sized.groupBy("__skey", "__source").agg(F.sum(F.col("__size") * F.col("__times")).alias("__words"))
    ranked = by_source.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = ranked.withColumns({"__w": weight, "__cap": F.col("__words") * cap}).withColumns({"__total": F.sum("__words").over(all_rows) * F.lit(share), "__all_w": F.sum("__w").over(all_rows)})
    before = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    spent, used = F.coalesce(F.sum("__cap").over(before), F.lit(0)), F.coalesce(F.sum("__w").over(before), F.lit(0))
    t = t.withColumn("__level_here", (F.col("__total") - spent) / (F.col("__all_w") - used))
    t = t.withColumn("__level", F.max("__level_here").over(all_rows))
    t = t.withColumn("__target", F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("__w")))
    upto = Window.orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("__hi", F.round(F.try_divide(F.sum("__target").over(upto), F.col("__total")) * POINTS).cast("long"))
    t = t.withColumn("__hi", F.when(F.sum("__target").over(upto) >= F.col("__total") * (1 - 1e-12), F.lit(POINTS)).otherwise(F.least(F.col("__hi"), F.lit(POINTS))))
    t = t.withColumn("__lo", F.lag("__hi", 1, 0).over(Window.orderBy("__rank")))
    return t.select("__skey", "__rank", "__words", "__target", "__total", "__lo", "__hi")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots: t, __rank (the source), turn (rank of the slot in its source), from 0."""
    spark = sources.sparkSession
    total = sources.agg(F.max("__total")).first()[0] or 0.0
    slots = spark.range(int(-(-total // block))).withColumnRenamed("id", "t")
    slots = slots.withColumn("__u", (F.col("t") % F.lit(POINTS)) * F.lit(GOLDEN) % F.lit(POINTS))
    width = POINTS // CELLS
    slots = slots.withColumn("__cell", F.expr(f"__u div {width}"))
    owners = sources.where("__hi > __lo").select("__rank", "__lo", "__hi", F.explode(F.expr(f"sequence(__lo div {width}, (__hi - 1) div {width})")).alias("__cell"))
    mapped = slots.join(owners, "__cell").where("__u >= __lo AND __u < __hi").select("t", "__rank")
    mapped = mapped.withColumn("__chunk", F.expr(f"t div {CHUNK}"))
    counts = mapped.groupBy("__rank", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__rank").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__rank", "__chunk", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__rank", "__chunk").orderBy("t")) - 1
    return mapped.withColumn("__within", within).join(offsets, ["__rank", "__chunk"]).select("t", "__rank", (F.col("__before") + F.col("__within")).alias("turn"))


def laid_out(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row's first word in its source's shuffled line of documents (__start)."""
    total = sized.agg(F.sum("__times").alias("n"), F.max("__times").alias("most")).first()
    rows = sized.join(sources.select("__skey", "__rank", "__words", "__target"), "__skey").withColumn("__bucket", F.substring("__hash", 1, bucket_digits(total.n or 0)))
    together = F.col("__size") * F.col("__times")
    sums = rows.groupBy("__rank", "__bucket").agg(F.sum(together).alias("__sum"))
    earlier = Window.partitionBy("__rank").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__rank", "__bucket", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__rank", "__bucket").orderBy("__hash", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum(together).over(within), F.lit(0)))
    rows = rows.join(offsets, ["__rank", "__bucket"])
    each = skew.each_copy(rows, "__times", "__copy", (total.most or 0) > skew.CHUNK)
    return each.withColumn("__start", F.col("__before") + F.col("__within") + F.col("__copy") * F.col("__size")).drop("__copy", "__times")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    block: int = BLOCK,
) -> DataFrame:
    """id, size, source_size, target, taken, source for each row.

    Null texts have size 0; rows of size 0 and sources without words are taken 0 times.
    A null source is a source, the last. Null ids are shuffled like empty ones, and rows
    that agree in id, source and size are interchangeable, but for the order of their
    takings. Texts of any length are counted whole. Reruns agree, whatever the
    partitions. An empty table gives an empty result; other columns, whatever their
    names, are not looked at.
    """
    sized = written(sized_rows(docs, id_col, text_col, source_col), "mix-sizes")
    sources = written(targets(sized, weights, share, cap), "mix-sources")
    blocks = sources.select("__rank", F.expr(f"greatest(1, (__words + {block - 1}) div {block})").alias("__blocks"))
    slots = schedule(sources, block).join(blocks, "__rank").where(F.expr(f"turn div __blocks < {cap}"))
    taken = slots.groupBy("__rank", (F.col("turn") % F.col("__blocks")).alias("__block")).agg(F.count(F.lit(1)).alias("__times"))
    rows = laid_out(sized, sources)
    end = F.col("__start") + F.col("__size")
    pieces = rows.where("__size > 0").withColumn("__block", F.explode(F.expr(f"sequence(__start div {block}, (__start + __size - 1) div {block})")))
    part = F.least(end, (F.col("__block") + 1) * block) - F.greatest(F.col("__start"), F.col("__block") * block)
    whole = ["__id", "__source", "__rank", "__size", "__words", "__target", "__start"]
    mixed = (
        pieces.withColumn("__part", part)
        .join(taken, ["__rank", "__block"], "left")
        .groupBy(*whole)
        .agg(F.sum(F.col("__part") * F.coalesce(F.col("__times"), F.lit(0))).alias("__taken"))
    )
    empty = rows.where("__size = 0").select(*whole, F.lit(0).cast("long").alias("__taken"))
    return mixed.unionByName(empty).select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__words").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__taken").alias("taken"),
        F.col("__source").alias(source_col),
    )


def copies(taken: Column, size: Column) -> Column:
    """How often a document stands in the mix: its taken words in whole documents."""
    return F.when(size > 0, F.floor(taken / size + F.lit(0.5))).otherwise(F.lit(0)).cast("int")


def repeated_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs``, each row as often as the mix takes it in whole documents (0, 1 or 2 times).

    Rows are joined to the mix by id; rows that share an id, or have none, follow the
    average of what the mix takes of them. Rows without words go; texts of any length
    stay whole, and an empty table stays empty.
    """
    mixed = mix(docs, id_col, text_col, source_col, **how)
    by_id = mixed.groupBy(F.col(id_col).alias("key")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = by_id.select("key", copies(F.col("taken"), F.col("size")).alias("times")).where("times > 0")
    # The row travels as one struct, so that no name of its columns can clash.
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("of"))
    joined = packed.join(times, F.col("of").eqNullSafe(F.col("key")))
    repeated = joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
