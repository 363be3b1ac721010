import hashlib
import math
import re

import pytest

from cardinia.llm import mixing, oracle, skew
from tests.llm.common import awkward, frame
from tests.oracle import SMALL, assert_same, connection


def targets(words: dict[str | None, int]) -> dict[str | None, float]:
    """The contract's rule: share by weight, cap, share the excess again."""
    order = sorted((s for s in words if s is not None)) + [None] * (None in words)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(words.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * words[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * words[s]
            left -= out[s]
        free -= over
    return out


def brute(rows, block):
    size = [len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")) for r in rows]
    words: dict = {}
    for r, n in zip(rows, size, strict=True):
        words[r[3]] = words.get(r[3], 0) + n
    want = targets(words)
    order = sorted((s for s in words if s is not None)) + [None] * (None in words)
    total, upto, ends = sum(want.values()), 0.0, []
    for s in order:
        upto += want[s]
        ends.append(round(upto / total * mixing.POINTS) if total else 0)
    ends[-1] = mixing.POINTS
    turns = dict.fromkeys(order, 0)
    times: dict = {}
    for t in range(math.ceil(total / block)):
        u = t * mixing.GOLDEN % mixing.POINTS
        s = next(x for x, e in zip(order, ends, strict=True) if u < e)
        blocks = max(1, -(-words[s] // block))
        if turns[s] // blocks < 2:
            at = (s, turns[s] % blocks)
            times[at] = times.get(at, 0) + 1
        turns[s] += 1
    start, out = dict.fromkeys(order, 0), []
    for r, n in sorted(zip(rows, size, strict=True), key=lambda x: (hashlib.md5(f"{x[0][0]}/{x[1]}".encode()).hexdigest(), x[0][0], x[1])):
        a = start[r[3]]
        taken = sum(times.get((r[3], w // block), 0) for w in range(a, a + n))
        start[r[3]] += n
        out.append((r[0], n, words[r[3]], round(want[r[3]], 6), taken, r[3]))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken, r.source) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_against_brute_force(spark, block):
    rows = [r[:1] + (r[1] if len(r[1] or "") < 1000 else "w " * 300,) + r[2:] for r in awkward(["some words here " * 9] * 40)]
    assert result(mixing.mix(frame(spark, rows), block=block)) == brute(rows, block)


def test_shares_come_near_their_targets(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 90 AS INT)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 17) END AS source")
    got = mixing.mix(df).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 0.05 * by.target + 4 * mixing.BLOCK).all()
    assert abs(got.taken.sum() / got["size"].sum() - 1.5) < 0.02


def test_reruns_and_partitions_agree(spark):
    rows = awkward(["some words here " * 9] * 20)
    assert result(mixing.mix(frame(spark, rows, 1))) == result(mixing.mix(frame(spark, rows, 5)))


def test_nothing_to_mix(spark):
    df = frame(spark, awkward())
    assert mixing.mix(df.limit(0)).count() == 0
    only = mixing.mix(df.where("length(trim(coalesce(text, ''))) = 0")).collect()
    assert {(r.size, r.taken, r.target) for r in only} <= {(0, 0, 0.0)} and len(only) >= 2


def test_repeated_rows(spark):
    rows = awkward(["some words here " * 9] * 40)
    df = frame(spark, rows)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(df).collect()}
    out = mixing.repeated_rows(df)
    assert out.schema == df.schema
    counts: dict[int, int] = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    for i, (t, n) in taken.items():
        if i != rows[3][0]:  # a repeated row counts twice
            assert counts.get(i, 0) == (int(t / n + 0.5) if n else 0)


def test_a_third_of_all_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(skew, "CHUNK", 7)
    rows = [(5, "some same words", None, "s", *[None] * 9)] * 60 + [(i, "other words " * (i % 7), None, f"s{i % 4}", *[None] * 9) for i in range(100)]
    assert result(mixing.mix(frame(spark, rows), block=4)) == brute(rows, 4)


def test_sql(spark):
    assert_same(mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet")), oracle.mixture(), connection())
