import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardinia.llm import oracle, skew, suffix_dedup
from cardinia.llm.suffix_array import Texts
from tests.llm.common import awkward, frame
from tests.oracle import SMALL, assert_same, connection


@given(st.lists(st.binary(max_size=30) | st.text("ab", max_size=40).map(str.encode) | st.sampled_from([b"a" * 30, b"\x00\x00", b"\xff"]), min_size=1, max_size=6), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_suffix_arrays(texts, length):
    t = Texts(texts)

    def suffix(p):
        return t.raw[p : t.end_of[p]]

    wanted = np.ones(len(t.symbols), bool)
    order = t.suffix_array(wanted)
    assert sorted(order.tolist()) == list(range(len(t.symbols)))
    assert all(suffix(a) <= suffix(b) for a, b in zip(order, order[1:], strict=False))
    common = t.common_prefixes(order, length)
    assert common.tolist() == [0] + [min(length, len(os.path.commonprefix([suffix(a), suffix(b)]))) for a, b in zip(order, order[1:], strict=False)]
    seen: dict[bytes, list[int]] = {}
    for p in range(len(t.symbols)):
        if t.end_of[p] - p >= length:
            seen.setdefault(t.raw[p : p + length], []).append(p)
    assert np.flatnonzero(t.repeated(wanted, length)).tolist() == sorted(p for v in seen.values() if len(v) > 1 for p in v)


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    where: dict[bytes, list] = {}
    for i, d in enumerate(data):
        for p in range(len(d) - length + 1):
            where.setdefault(d[p : p + length], []).append((i, p))
    spans: list[list] = [[] for _ in data]
    for found in where.values():
        if len(found) > 1:
            for i, p in found:
                spans[i].append((p, p + length))
    out = []
    for d, s in zip(data, spans, strict=True):
        merged = suffix_dedup.merged(np.array([(a << 32) + b for a, b in s], np.int64))
        kept = b"".join(suffix_dedup.cut(d, merged))
        out.append((len(d), len(d) - len(kept), len(merged), hashlib.sha256(kept).hexdigest()))
    return out


def result(df, **how):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, **how).collect())


def mixed_texts(seed, n=50):
    rng = random.Random(seed)
    common = ["".join(rng.choices("abcdefgh ", k=60)) for _ in range(4)]
    parts = [lambda: rng.choice(common)[rng.randint(0, 30) : rng.randint(30, 60)], lambda: "".join(rng.choices("abcdé", k=rng.randint(0, 20))), lambda: "zz" * rng.randint(0, 9)]
    return ["".join(rng.choice(parts)() for _ in range(rng.randint(0, 4))) for _ in range(n)]


@pytest.mark.parametrize("crowd", [1000, 2, 1])
def test_against_brute_force(spark, crowd):
    """crowd 2 and 1 split nearly every group by content, at both levels."""
    texts = mixed_texts(crowd)
    texts += [*texts[:5], None, ""]
    rows = [(i, t, *[None] * 11) for i, t in enumerate(texts)]
    got = result(frame(spark, rows), length=12, gram=5, crowd=crowd)
    assert got == [(i, *x) for i, x in enumerate(brute(texts, 12))]


def test_a_frequent_line_in_ever_new_company(spark):
    rng = random.Random(9)
    line = "this very line is everywhere"
    texts = ["".join(rng.choices("abcdefgh", k=20)) + line + "".join(rng.choices("abcdefgh", k=20)) for _ in range(60)]
    rows = [(i, t, *[None] * 11) for i, t in enumerate(texts)]
    for length in (20, 30):
        assert result(frame(spark, rows), length=length, gram=8, crowd=5) == [(i, *x) for i, x in enumerate(brute(texts, length))]


def test_a_piece_of_many_regions_comes_in_few_rows(spark, monkeypatch):
    rng = random.Random(12)
    line = "this very line is everywhere"
    texts = ["".join(rng.choices("abcdefgh", k=20)) + line + "".join(rng.choices("abcdefgh", k=20)) for _ in range(60)]
    most, real = [], suffix_dedup.repeats

    def counted(pieces, length):
        most.append(max([r["count"] for r in pieces.groupBy("k", "i").count().collect()], default=0))
        return real(pieces, length)

    monkeypatch.setattr(suffix_dedup, "repeats", counted)
    got = result(frame(spark, [(i, t, *[None] * 11) for i, t in enumerate(texts)]), length=20, gram=8, crowd=5)
    assert len(most) > 1 and max(most) <= suffix_dedup.COPIES
    assert got == [(i, *x) for i, x in enumerate(brute(texts, 20))]


def test_a_region_of_many_texts_has_one_row_of_stretches(spark):
    """However finely its group is split: its places are as many as the texts, and its windows need not multiply them."""
    rng = random.Random(11)
    line = "this very line is everywhere"
    company = ["".join(rng.choices("abcdefgh", k=20)) + line + "".join(rng.choices("abcdefgh", k=20)) for _ in range(40)]
    texts = company + [f"{company[0]} {i:03}" for i in range(60)]
    how = {"length": 20, "gram": 8}
    df = frame(spark, [(i, t, *[None] * 11) for i, t in enumerate(texts)])
    grams = suffix_dedup.frequent_grams(suffix_dedup._texts(df, "text"), **how)
    found = suffix_dedup.regions(suffix_dedup._texts(df, "text"), grams, **how)
    rows = suffix_dedup.repeated_stretches(found, 20, 5).select("k", "i").collect()
    assert rows and len(rows) == len(set(rows))
    assert result(df, crowd=5, **how) == [(i, *x) for i, x in enumerate(brute(texts, 20))]


def test_long_texts_are_cut_in_segments(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 3000, dtype=np.uint8).tobytes()
    whole = suffix_dedup.anchors(data, 50, 20)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 700)
    cut = suffix_dedup.anchors(data, 50, 20)
    for g, p, a, m in (whole, cut):
        assert a.tolist() == (np.cumsum(np.append(0, m))[:-1]).tolist() and m.sum() == 2951
        assert ((p >= a + m - 1) & (p <= a + 30)).all() and len(g) == len(p)
    places = [np.repeat(p, m) for _, p, _, m in (whole, cut)]
    assert (places[0] == places[1]).all()


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    part = rng.integers(97, 123, 90, dtype=np.uint8).tobytes()
    texts = [rng.integers(97, 123, k, dtype=np.uint8).tobytes() + part + rng.integers(97, 123, 40, dtype=np.uint8).tobytes() for k in (10, 77)]
    places = []
    for t, k in zip(texts, (10, 77), strict=True):
        _, p, _, m = suffix_dedup.anchors(t, 50, 20)
        places.append((np.repeat(p, m) - k)[k : k + 41])
    assert (places[0] == places[1]).all()


def test_awkward_rows(spark):
    rows = awkward(["passage " * 60, "x" + "passage " * 60])
    got = result(frame(spark, rows))
    assert got == sorted((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows], 400), strict=True))
    assert result(frame(spark, rows).limit(0)) == []


def repeats(texts, length, words):
    """Removed spans, and in what is left runs of windows of words that other texts have left, too, by brute force."""
    data = {(t or "").encode() for t in texts}
    where: dict[bytes, set] = {}
    times: dict[bytes, int] = {}
    for t in texts:
        d = (t or "").encode()
        for p in range(len(d) - length + 1):
            times[d[p : p + length]] = times.get(d[p : p + length], 0) + 1
    pieces = {}
    for d in data:
        spans = [(p << 32) + p + length for p in range(len(d) - length + 1) if times[d[p : p + length]] > 1]
        pieces[d] = [x.split() for x in suffix_dedup.cut(d, suffix_dedup.merged(np.array(spans, np.int64)))]
    for d, xs in pieces.items():
        for w in xs:
            for p in range(len(w) - words + 1):
                where.setdefault(tuple(w[p : p + words]), set()).add(d)
    out = {}
    for d, xs in pieces.items():
        flags = [[len(where[tuple(w[p : p + words])]) > 1 for p in range(len(w) - words + 1)] for w in xs]
        out[d] = len(xs) - 1 + sum(f and not (p and fs[p - 1]) for fs in flags for p, f in enumerate(fs))
    return [out[(t or "").encode()] for t in texts]


@pytest.mark.parametrize(("words", "length"), [(1, 400), (4, 400), (4, 21), (7, 30)])
def test_passages_against_brute_force(spark, words, length, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 5)  # so that some windows are hot
    rng = random.Random(words)
    common = [" ".join(rng.choices("a b c d e f g".split(), k=30)) for _ in range(5)]
    texts = [rng.choice(" \t\n").join(rng.choice(common).split()[rng.randint(0, 9) : rng.randint(10, 30)] + rng.choices("x y z é".split(), k=rng.randint(0, 9))) for _ in range(80)]
    texts += ["  ".join(texts[0].split()), texts[1], texts[1], "", None, " "]
    df = frame(spark, [(i, t, *[None] * 11) for i, t in enumerate(texts)])
    got = {r.doc_id: r.n_repeats for r in suffix_dedup.remove_repeats(df, length=length, gram=6, words=words).collect()}
    assert got == dict(enumerate(repeats(texts, length, words)))


def test_texts_are_scanned_in_segments(monkeypatch):
    """What is found in a text does not depend on its neighbours, nor on the segments that it is cut in."""
    rng = np.random.default_rng(3)
    texts = [b"", b"short", b" ".join(rng.choice([b"a", b"bb", b"", b"\t", b"word"], 300).tolist()), b"x" * 900 + b" y z " * 90, *[b" ".join(rng.choice([b"c", b"dd", b"e\n"], int(n)).tolist()) for n in rng.integers(0, 400, 30)]]

    def words():
        return sorted(zip(*(np.concatenate(x).tolist() for x in zip(*suffix_dedup.windows_of(pa.array(texts, pa.binary()), 9, 3), strict=True)), strict=True))

    def bytes_():
        return sorted(zip(*(np.concatenate(x).tolist() for x in zip(*(y[:5] for _, y in suffix_dedup.stretches(pa.array(texts, pa.binary()), 50, 20)), strict=True)), strict=True))

    alone = sorted((i, n, w, g) for i, t in enumerate(texts) for _, n_, w_, g_ in suffix_dedup.windows_of(pa.array([t], pa.binary()), 9, 3) for n, w, g in zip(n_.tolist(), w_.tolist(), g_.tolist(), strict=True))
    by_words = words()
    assert by_words == alone and len(by_words) == sum(max(0, len(t.split()) - 8) for t in texts)
    same = {}
    for i, n, w, _ in by_words:
        assert same.setdefault(w, texts[i].split()[n : n + 9]) == texts[i].split()[n : n + 9]
    one = sorted((i, *y) for i, t in enumerate(texts) for y in zip(*(x.tolist() for x in suffix_dedup.anchors(t, 50, 20)), strict=True))
    assert bytes_() == one
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 500)
    assert words() == [x if texts[x[0]].split()[x[1] : x[1] + 9].count(b"x" * 900) == 0 else y for x, y in zip(by_words, words(), strict=True)]
    places = [[(i, p, q) for i, _, p, a, m in found for q in range(a, a + m)] for found in (one, bytes_())]
    assert sorted(places[0], key=lambda x: (x[0], x[2])) == sorted(places[1], key=lambda x: (x[0], x[2]))


def test_a_text_on_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 20)
    monkeypatch.setattr(suffix_dedup, "COPIES", 2)
    texts = ["the same passage " * 3 if i % 3 == 0 else f"text {i} " * 4 for i in range(150)] + ["before it the same passage " * 2]
    got = result(frame(spark, [(i, t, *[None] * 11) for i, t in enumerate(texts)], 7), length=12, gram=5)
    assert got == [(i, *x) for i, x in enumerate(brute(texts, 12))]


def test_sql(spark):
    assert_same(suffix_dedup.remove_repeats(spark.read.parquet(f"{SMALL}/documents.parquet")), oracle.repeated_passages(), connection())
