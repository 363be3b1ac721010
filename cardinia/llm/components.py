"""Connected components of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinia.llm import skew
from cardinia.llm._util import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label): the smallest vertex that each linked vertex reaches. Vertices without links are left out.

    Each round takes the smallest label among a vertex and its neighbours, and then the
    label of that label, so that chains halve. Links and labels stay distributed; each
    round's labels are written in the shared folder, which cuts the lineage. A vertex
    with a large share of all links, and a label with a large share of all vertices, is
    joined by salts.
    """
    both = links.select(F.col(a).alias("v"), F.col(b).alias("u")).unionByName(links.select(F.col(b).alias("v"), F.col(a).alias("u"))).where("v <> u").distinct()
    both = written(both, "links")
    first = both.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("links"))
    labels = written(first.select("v", F.least("v", "m").alias("label"), "links"), "labels")
    vertices = labels.count()
    hubs = skew.hot_keys(labels.select(F.col("v").alias("u"), "links"), "u", "links")
    while True:
        seen = skew.salted_join(both, labels.select(F.col("v").alias("u"), "label"), "u", hubs, F.xxhash64("v"))
        near = seen.groupBy("v").agg(F.min("label").alias("near"))
        low = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        heads = skew.hot_keys(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "n", vertices)
        jump = low.select(F.col("v").alias("label"), F.col("label").alias("further"))
        new = written(skew.salted_join(low, jump, "label", heads, F.xxhash64("v")).select("v", "old", F.least("label", "further").alias("label")), "labels")
        discard(labels)
        if new.where("old <> label").isEmpty():
            discard(both)
            return new.select("v", "label")
        labels = new
