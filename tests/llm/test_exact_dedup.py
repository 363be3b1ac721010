import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cardinia.llm import exact_dedup
from tests.llm.common import awkward, frame
from tests.oracle import SMALL, assert_same, connection


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows]
    groups: dict[str, list] = {}
    for r, t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(r[0])
    out, seen = [], set()
    for r, t in zip(rows, norm, strict=True):
        kept = r[0] == min(groups[t]) and t not in seen
        if kept:
            seen.add(t)
        out.append((r[0], min(groups[t]), len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


@pytest.mark.parametrize("salts", [1, 7])
def test_against_brute_force(spark, salts):
    rows = awkward(["hot  copy"] * 30)
    assert result(exact_dedup.exact_dedup(frame(spark, rows), salts=salts)) == brute(rows)


@pytest.mark.parametrize("weak", [lambda t: F.length(t) % 3, lambda t: F.lit(0)])
def test_content_decides_where_digests_clash(spark, weak):
    rows = awkward(["hot  copy"] * 5)
    assert result(exact_dedup.exact_dedup(frame(spark, rows), digest=weak)) == brute(rows)


def test_null_ids_and_empty_tables(spark):
    df = frame(spark, [(None, "a", *[None] * 11), (4, "a", *[None] * 11), (None, "b", *[None] * 11)])
    df = df.union(df.where("text = 'b'"))
    found = sorted(((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(df).collect()), key=str)
    assert found == sorted([(None, 4, False), (4, 4, True), (None, None, True), (None, None, False)], key=str)
    assert sorted(r.text for r in exact_dedup.drop_copies(df).collect()) == ["a", "b"]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_dropping_keeps_all_columns(spark):
    rows = awkward(["hot  copy"] * 5)
    df = frame(spark, rows)
    for digest in (exact_dedup.sha256_of, lambda t: F.length(t) % 3):
        kept = exact_dedup.drop_copies(df, digest=digest)
        assert kept.schema == df.schema
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[3])
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_sql(spark):
    assert_same(exact_dedup.exact_dedup(spark.read.parquet(f"{SMALL}/documents.parquet")), exact_dedup.SQL, connection())
