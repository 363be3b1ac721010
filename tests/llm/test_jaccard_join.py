import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardinia.llm import components, jaccard_join, oracle, shingles
from cardinia.llm.bit_filter import bit_filter, holds
from tests.llm.common import awkward, frame
from tests.oracle import SMALL, assert_same, connection


def sets_of(texts):
    out = []
    for t in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        out.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    return out


def brute(rows):
    sets = sets_of([r[1] for r in rows])
    ids = [r[0] for r in rows]
    low = list(ids)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            if (low[i], low[j]) != (m, m):
                low[i] = low[j] = m
                changed = True
    return sorted((a, len(s), m) for a, s, m in zip(ids, sets, low, strict=True))


def result(df, **how):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, bits=16, **how).collect())


def near_copies(seed, groups=6, members=9, words=60):
    """Groups of texts with a few words changed: some similar enough, some not, some only by a chain."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        text = rng.choices(vocabulary, k=words)
        for _ in range(members):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text = text[: -rng.randint(1, 6)]
    common = " ".join(rng.choices(vocabulary, k=30))
    out += [common + " " + " ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(20)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"small": 2}), (3, {"small": 0, "dealt": 3}), (4, {"frequent": 0}), (5, {"frequent": 3, "small": 0, "dealt": 2})])
def test_against_brute_force(spark, monkeypatch, seed, how):
    """small 0 and 2 put (nearly) all buckets through pivots and late pairs, dealt cuts these, frequent salts the offers."""
    monkeypatch.setattr(jaccard_join, "CROWDED", 0)
    rows = awkward(near_copies(seed))
    assert result(frame(spark, rows), **how) == brute(rows)


def test_chains_through_dropped_pivots(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 40, 2)]
    rows = [(i, t, *[None] * 11) for i, t in enumerate(texts)]
    want = brute(rows)
    assert {x[2] for x in want} == {0}
    assert result(frame(spark, rows), small=0) == want


def test_nulls_and_nothing(spark):
    df = frame(spark, [(None, "a b c d e f", *[None] * 11), (7, "A b c d e f", *[None] * 11), (None, None, *[None] * 11), (8, "", *[None] * 11), (9, " ", *[None] * 11)])
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, bits=12).collect()), key=str)
    assert found == sorted([(None, 2, 7), (7, 2, 7), (None, 0, None), (8, 0, 8), (9, 0, 9)], key=str)
    assert result(df.limit(0)) == []


def test_dropping(spark):
    rows = awkward(near_copies(4))
    df = frame(spark, rows)
    out = jaccard_join.drop_near_copies(df)
    assert out.schema == df.schema
    assert sorted(r.doc_id for r in out.collect()) == sorted(a for a, _, m in brute(rows) if a == m)


@given(st.sets(st.integers(0, 2**64 - 1), max_size=40), st.sets(st.integers(0, 2**64 - 1), max_size=40))
@settings(max_examples=200, deadline=None)
def test_suffix_filter_never_drops_a_link(a, b):
    a |= set(list(b)[: len(b) * 9 // 10])
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert jaccard_join.linked(x, y) == (100 * len(a & b) >= 80 * len(a | b))
    apart = sum(int(p ^ q).bit_count() if p ^ q >= 0 else int((p ^ q) % 2**64).bit_count() for p, q in zip(jaccard_join.signature(x).tolist(), jaccard_join.signature(y).tolist(), strict=True))
    assert apart <= len(a ^ b)


@given(st.integers(1, 300), st.integers(1, 300))
@settings(max_examples=300, deadline=None)
def test_prefixes_are_long_enough(n, m):
    n, m = sorted((n, m))
    need = -(-4 * (n + m) // 9)
    if need <= n:  # the first common shingle of a linked pair is within both prefixes
        assert n - need <= n - -(-8 * n // 9) < jaccard_join.prefix_length(n)
        assert m - need < jaccard_join.prefix_length(m)


def test_shingles():
    s = shingles.Shingler()
    a, b = (s.hashes(shingles.words_of(t)) for t in ("A b\tc d e f", "a b c  d e"))
    assert len(a) == 2 and len(b) == 1 and b[0] in a
    assert len(s.hashes(shingles.words_of("a b"))) == 1 and len(s.hashes([])) == 0
    assert s.hashes([b"a", b"b"])[0] != s.hashes([b"b", b"a"])[0]
    assert shingles.words_of("É x Ab") == ["É x".encode(), b"ab"]


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(50)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(300, i) for i in range(301, 340)]
    parent: dict[int, int] = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    got = {r.v: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent}


def test_bit_filters_hold_all_keys(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS k")
    bits, raw = bit_filter(keys)
    inside = np.array([r.k for r in keys.collect()])
    outside = np.array([r.k for r in spark.range(10**6, 10**6 + 5000).selectExpr("xxhash64(id) AS k").collect()])
    assert holds(raw, bits, inside).all() and holds(raw, bits, outside).mean() < 0.2
    bits, raw = bit_filter(keys.limit(0))
    assert not holds(raw, bits, outside).any()


def test_sql(spark):
    assert_same(jaccard_join.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet")), oracle.jaccard_components(), connection())
