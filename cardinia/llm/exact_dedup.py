"""Exact deduplication by skew-safe combining.

Three combining stages, each of which compares full content, never digests alone:

1. local: every map task keeps one row for each distinct text that it has read;
2. salted: the local winners of a digest meet in ``salts`` groups, so that a text
   with a third of all rows is merged by many tasks;
3. global: the few salt winners of a digest meet and give the class of the text.

Rows then look up their class by digest, as often as they stand there; the rows of a
frequent text are dealt out by salts, its class copied to each (``skew``). Should two
different texts share a digest, the rows of that digest, and only they, are looked up
by digest and whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinia.llm import skew
from cardinia.llm._util import SPACES, text_or_empty, written

SALTS = 32


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def combine(texts: DataFrame, salts: int = SALTS) -> DataFrame:
    """(__id, __digest, __text) -> one row for each distinct text: __keep, __size."""
    salted = texts.withColumn("__salt", F.spark_partition_id() % F.lit(salts))
    # The map side of this aggregate is the local stage, its reduce side the salted one.
    winners = salted.groupBy("__digest", "__salt", "__text").agg(F.min("__id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
    # Partitioned by digest alone: different texts of one digest meet, too.
    return (
        winners.repartition("__digest")
        .groupBy("__digest", "__text")
        .agg(F.min("__keep").alias("__keep"), F.sum("__size").alias("__size"))
    )


def classes_of(texts: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each digest; __texts > 1 where different texts share it."""
    return combine(texts, salts).groupBy("__digest").agg(
        F.min("__keep").alias("__keep"), F.sum("__size").alias("__size"), F.count(F.lit(1)).alias("__texts")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("__id"), normalised(text_col).alias("__text"), *more)
    return texts.withColumns({"__digest": digest(F.col("__text")), "__sha": F.sha2("__text", 256)})


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_of,
) -> DataFrame:
    """Classes of equal texts: id, keep_id, group_size, kept, text_sha256 for each row.

    Texts are equal when identical after every run of ASCII white space became one
    space. Null counts as the empty text. Of a class one row stays, that with the
    smallest non-null id (of rows that repeat both id and text, any one; if every id of
    a class is null, one of its rows). Texts of any length are compared whole. An empty
    table gives an empty result. Columns other than id and text are not looked at.
    """
    keyed = _keyed(docs, id_col, text_col, digest)
    classes = written(classes_of(keyed.select("__id", "__digest", "__text"), salts), "dedup-classes")
    # Rows that repeat id and text meet here, so that exactly one of them can stay.
    rows = ["__digest", "__id", "__sha"]
    counted = keyed.groupBy(*rows).agg(F.count(F.lit(1)).alias("__rows"))
    spread = F.xxhash64("__id")  # equal ids of a text are one row by now
    hot = skew.hot_keys(classes, "__digest", "__size")
    joined = skew.salted_join(counted, classes.where("__texts = 1"), "__digest", hot, spread).select(*rows, "__rows", "__keep", "__size")
    clashes = classes.where("__texts > 1").select("__digest")
    if not clashes.isEmpty():
        clashed = keyed.join(clashes, "__digest", "left_semi")
        by_text = combine(clashed.select("__id", "__digest", "__text"), salts)
        counted = clashed.groupBy(*rows, "__text").agg(F.count(F.lit(1)).alias("__rows"))
        joined = joined.unionByName(counted.join(by_text, ["__digest", "__text"]).select(*joined.columns))
    each = skew.each_copy(joined, "__rows", "__number", hot is not None)
    return each.select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        (F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__number") == 0)).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """``docs`` without the rows of a class that do not stay.

    Rows are joined to their class by digest and id, so a frequent text is dealt out by
    its rows' ids, and travel as one struct, so that no name of their columns can clash.
    Null texts are empty ones, and one row of all empty texts stays; null ids stay only
    if a class has no others. Texts of any length are compared whole; an empty table
    stays empty.
    """
    keyed = _keyed(docs, id_col, text_col, digest, F.struct(*docs.columns).alias("row"))
    classes = written(classes_of(keyed.select("__id", "__digest", "__text"), salts), "dedup-classes")

    def staying(rows: DataFrame, found: DataFrame, *by: str) -> DataFrame:
        same = F.col("__id").eqNullSafe(F.col("__keep"))
        for k in by:
            same &= F.col(k) == F.col(f"{k}_of")
        joined = rows.join(found.select("__keep", *[F.col(k).alias(f"{k}_of") for k in by]), same)
        return joined.dropDuplicates([*by, "__id"]).select("row")

    kept = staying(keyed.select("__digest", "__id", "row"), classes.where("__texts = 1"), "__digest")
    clashes = classes.where("__texts > 1").select("__digest")
    if not clashes.isEmpty():
        clashed = keyed.join(clashes, "__digest", "left_semi")
        by_text = combine(clashed.select("__id", "__digest", "__text"), salts)
        kept = kept.unionByName(staying(clashed.select("__digest", "__text", "__id", "row"), by_text, "__digest", "__text"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


SQL = r"""
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""
