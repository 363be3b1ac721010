"""A key with a third of all rows, without Spark's own remedies."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from cardinia.llm import exact_dedup, jaccard_join, skew
from cardinia.llm.components import components


@pytest.fixture
def plain(spark, monkeypatch):
    """No adaptive plans, no broadcasts, 48 partitions."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "48"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def balanced(df) -> bool:
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) < 5 * median(sizes)


def test_salted_joins_are_balanced(plain):
    rows = plain.range(60_000, numPartitions=4).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 20000 AS STRING) END AS k")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    single = counts.select("k", (F.col("n") * 2).alias("m"))
    hot = skew.hot_keys(counts, "k", "n")
    assert [r.k for r in hot.collect()] == ["hot"]
    for how in ("inner", "left"):
        joined = skew.salted_join(rows, single, "k", hot, F.xxhash64("id"), how)
        assert joined.count() == 60_000 and balanced(joined)
        assert not joined.join(single.withColumnRenamed("m", "other"), "k").where("m <> other").head(1)
    missing = skew.salted_join(rows, single.where("k <> 'hot'"), "k", hot, F.xxhash64("id"), "left")
    assert missing.where("m IS NULL").count() == 20_000


def test_copies_are_balanced(plain):
    rows = plain.createDataFrame([(1, 40_000), *[(i, 1) for i in range(2, 20_000)]], "id long, times long")
    out = skew.each_copy(rows, "times", "number", True, 500)
    assert out.count() == 40_000 + 19_998 and balanced(out)
    assert out.where("id = 1").agg(F.count_distinct("number"), F.min("number"), F.max("number")).first() == (40_000, 0, 39_999)


def test_exact_dedup_of_a_text_on_a_third_of_all_rows(plain):
    docs = plain.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same' ELSE concat('text ', id % 9000) END AS text")
    out = exact_dedup.exact_dedup(docs)
    assert balanced(out)
    got = out.where("doc_id % 3 = 0").agg(F.min("keep_id"), F.max("keep_id"), F.min("group_size"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (0, 0, 10_000, 1) and out.count() == 30_000


def test_components_of_a_star(plain, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 100)
    plain.conf.set("spark.sql.shuffle.partitions", "4")
    links = plain.range(1, 3000).selectExpr("CAST(0 AS BIGINT) AS a", "id AS b").union(plain.range(5000, 5030).selectExpr("id AS a", "id + 1 AS b"))
    found = {r.v: r.label for r in components(links).collect()}
    assert found == dict.fromkeys(range(3000), 0) | dict.fromkeys(range(5000, 5031), 5000)


def test_near_copies_of_a_third_of_all_rows(plain, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 20)
    plain.conf.set("spark.sql.shuffle.partitions", "4")
    common = " ".join(f"w{i}" for i in range(60))
    texts = {i: common + (f" x{i % 40}" if i % 2 else "") if i % 3 == 0 else " ".join(f"v{i}x{k}" for k in range(30)) for i in range(300)}
    docs = plain.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {i: 0 if i % 3 == 0 else i for i in texts}
