import hashlib
import zlib

import pytest

from cardinia.llm import oracle, sharding, skew
from tests.llm.common import awkward, frame
from tests.oracle import SMALL, connection


def result(df):
    return sorted((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in df.collect())


def test_against_the_formula(spark):
    rows = awkward()
    got = result(sharding.shard_rows(frame(spark, rows), shards=4))

    def crc(t):
        return zlib.crc32((t or "").encode())

    order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}/{len((r[1] or '').encode()) + 8}/{crc(r[1])}".encode()).hexdigest()[:3], r[0], len((r[1] or "").encode()), crc(r[1])))
    want = sorted((r[0], len((r[1] or "").encode()) + 8, crc(r[1]), "rows", *sharding.where_is(i, len(rows), 4), None) for i, r in enumerate(order))
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 24, 25, 26, 101, 1000, 1025])
def test_shards_are_even_and_slots_gapless(spark, n):
    df = spark.range(n).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    got = sharding.shard_rows(df).collect()
    slots: dict[int, list] = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(24)]
    assert len(got) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_walks_end_below_n(spark):
    n = 26  # of a square of 36: many numbers walk
    places = {sharding.where_is(i, n, 1)[1] for i in range(n)}
    assert places == set(range(n))


def test_partitions_do_not_matter(spark):
    rows = awkward()
    assert result(sharding.shard_rows(frame(spark, rows, 1))) == result(sharding.shard_rows(frame(spark, rows, 5)))


def test_seeds_differ(spark):
    df = frame(spark, awkward())
    assert result(sharding.shard_rows(df, seed="a")) != result(sharding.shard_rows(df, seed="b"))


def test_null_ids(spark):
    df = frame(spark, [(None, "a", *[None] * 11), (None, None, *[None] * 11), (3, "", *[None] * 11)])
    assert sorted((r.shard, r.slot) for r in sharding.shard_rows(df, shards=3).collect()) == [(0, 0), (1, 0), (2, 0)]


def test_a_third_of_all_rows_alike(spark, monkeypatch):
    """Equal rows are one row while they are numbered, and their copies are made in chunks."""
    monkeypatch.setattr(skew, "CHUNK", 7)
    rows = [(5, "same", *[None] * 11)] * 100 + [(None, f"t{i}", *[None] * 11) for i in range(100)] + [(i, "x", *[None] * 11) for i in range(100)]
    got = sharding.shard_rows(frame(spark, rows), shards=4).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(i % 4, i // 4) for i in sorted(range(300), key=lambda i: (i % 4, i // 4))]
    assert sum(r.doc_id == 5 and r.size == 12 for r in got) == 100
    assert sharding.bucket_digits(10**6) == 3 and sharding.bucket_digits(5 * 10**10) == 4


def test_long_walks_end(monkeypatch, spark):
    monkeypatch.setattr(sharding, "WALK", 1)
    df = spark.range(26).selectExpr("id AS row")
    placed = sharding.permuted(df, "row", 26, "place").collect()
    assert all(sharding.where_is(r.row, 26, 1)[1] == r.place for r in placed)


def test_sql(spark):
    got = result(sharding.shard_rows(spark.read.parquet(f"{SMALL}/documents.parquet")))
    want = connection().execute(f"SELECT doc_id, size, text_crc32, law, shard, slot, grown_shard FROM ({oracle.feistel_shards()}) ORDER BY 1").fetchall()
    assert got == want
