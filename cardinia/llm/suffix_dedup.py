"""Repeated passages by suffix arrays: bytes covered by a string of ``length`` bytes that also starts elsewhere.

The sort is distributed by anchors. A window (a string of ``length`` bytes) has as its
anchor the ``gram`` bytes in it whose hash is smallest, the leftmost of equals: equal
windows have equal anchors, at the same place in the window. A document's windows fall
into stretches that share an anchor; a stretch with its bytes is a region.

1. Anchors are counted; only grams that occur twice can hold repeated windows.
2. Regions of such grams go to the group of their gram. A group needs equal regions only
   twice, however often they occur: what is repeated among two copies is repeated among
   all. So a passage with a third of all rows is as cheap as one with two.
3. A group with more than ``crowd`` different regions (a frequent line in ever new
   company) is split by content: into pieces of a few windows that share the bytes
   common to those windows, and where even these crowd, into single windows.
4. Each task sorts the suffixes of its groups in two stages (``suffix_array``) and
   compares neighbours: common prefixes of ``length`` bytes are repeated windows.
5. What its pieces have found becomes one row for each region, with its stretches. It
   goes to all places that the region occurs at; these are joined to spans per distinct
   text, and cut out.

Passages of ``WORDS`` words may be shorter than ``length`` bytes. In what is left they are
counted, in the same manner with words for bytes: their windows have anchors, too, and
only windows with an anchor that two texts share are compared.

Texts, regions and windows of words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinia.llm import skew
from cardinia.llm._util import discard, lean, scope, text_or_empty, written
from cardinia.llm.bit_filter import bit_filter, holds
from cardinia.llm.suffix_array import Texts

LENGTH = 400
GRAM = 128
#: Words of a window, and of its anchor, when passages are counted: over 50.
WORDS, WORD_GRAM = 51, 12
#: Different regions of a group from which it is split by content.
CROWD = 500
#: Rows of one region, each from another task, or of one piece, each from another region, from which they are added up before they meet their group.
COPIES = 16
#: Bytes that are searched for anchors at a time, of many short texts or of one of any length.
_SEGMENT = 1 << 17
_SALTS = 8
#: Bytes of regions that are sorted together, and that a task holds back to send equal ones once.
_SORTED, _HELD = 1 << 19, 4 << 20
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = _SEGMENT + (1 << 16)
    table = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    up = np.cumprod(np.full(n, _BASE, np.uint64))
    down = np.cumprod(np.full(n, pow(_BASE, -1, 2**64), np.uint64))
    return table, up, down


def _hash64(*parts: bytes) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p)
    return int.from_bytes(h.digest(), "little", signed=True)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    table, up, down = _powers()
    n = len(text)
    sums = np.cumsum(np.concatenate([[np.uint64(0)], table[text] * up[:n]]).astype(np.uint64))
    return _mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of each ``width`` neighbouring hashes (fewer than 2 ** 22 in all), the leftmost of equals."""
    # Hash above, place below: the smallest is the smallest hash, the leftmost of equals.
    keys = (h & ~np.uint64((1 << 22) - 1)) | np.arange(len(h), dtype=np.uint64)
    pad = -len(keys) % width
    grid = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).reshape(-1)
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(h) - width + 1
    return (np.minimum(backward[:n], forward[width - 1 : width - 1 + n]) & np.uint64((1 << 22) - 1)).astype(np.int64)


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of windows with one anchor: its hash, its place, first window start, number of starts."""
    out: list[tuple[np.ndarray, ...]] = []
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole) - length + 1, _SEGMENT):
        h = gram_hashes(whole[at : at + _SEGMENT + length - 1], gram)
        place = least_places(h, length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out.append((h[place[first]].view(np.int64), place[first] + at, first + at, np.diff(np.append(first, len(place)))))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))  # type: ignore[return-value]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first, bytes, bounds) of runs of neighbouring texts of a segment's bytes at most, or of one longer text."""
    wide = pa.types.is_large_binary(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _SEGMENT, "right")) - 1)
        yield i, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def stretches(texts: pa.Array, length: int, gram: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
    """For ``chunks``: their bytes, and the stretches: text (by its number in ``texts``), anchor's hash, its place, first window start (both in the text), number of starts, first start in the chunk."""
    for i, data, bounds in chunks(texts):
        if len(data) > _SEGMENT:
            g, p, a, m = anchors(data.tobytes(), length, gram)
            yield data, (np.full(len(g), i), g, p, a, m, a)
        elif len(data) >= length:
            h = gram_hashes(data, gram)
            place = least_places(h, length - gram + 1)
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            inside = text[: len(place)] == text[length - 1 :]  # windows of one text
            at = np.flatnonzero(inside)
            if len(at):
                first = np.flatnonzero(np.concatenate([[True], (place[at][1:] != place[at][:-1]) | (text[at][1:] != text[at][:-1])]))
                t, p = text[at[first]], place[at[first]]
                yield data, (t + i, h[p].view(np.int64), p - bounds[t], at[first] - bounds[t], np.diff(np.append(first, len(at))), at[first])


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.xxhash64(text).alias("c"), text.cast("binary").alias("text"))


def frequent_grams(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(g): hashes of anchor grams that occur twice or more; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[int, int] = {}
        for b in batches:
            some = []
            for q, c in enumerate(b.column(0).to_pylist()):
                seen = times.get(c, 0)
                if seen < 2:  # twice is all that counts
                    times[c] = seen + 1
                    some.append(q)
            found = [x[1] for _, x in stretches(b.column(1).take(pa.array(some, pa.int64())), length, gram)]
            if found:
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], names=["g", "n"])

    counted = texts.where(F.octet_length("text") >= length).mapInArrow(lean(run), "g bigint, n bigint")
    return written(counted.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"), "passage-grams")


def regions(texts: DataFrame, grams: DataFrame, length: int, gram: int) -> DataFrame:
    """Places (k, i, c, at) and regions (k, i, o, m, n, x) of the frequent grams; written.

    k: the gram, i: the region's hash, c: the text, at: its first window; o: the anchor's
    place in the region, m: its windows, n: 1, or 2 if a task saw more, x: its bytes.
    """
    bits, raw = bit_filter(grams)
    sent = texts.sparkSession.sparkContext.broadcast(raw)
    names = ["k", "i", "c", "at", "o", "m", "n", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[int, int] = {}
        held: dict[tuple[int, int], list] = {}
        size = 0
        long = pa.int64()

        def release() -> pa.RecordBatch:
            none = pa.nulls(len(held), long)
            columns = list(zip(*held.values(), strict=True))
            keys = list(zip(*held, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(keys[0], long), pa.array(keys[1], long), none, none, *(pa.array(columns[q], long) for q in range(3)), pa.array(columns[3], pa.binary())], names=names)
            held.clear()
            return out

        for b in batches:
            some, cs, new = [], [], []
            for q, c in enumerate(b.column(0).to_pylist()):
                seen = times.get(c, 0)
                if seen < 2:
                    times[c] = seen + 1
                    some.append(q)
                    cs.append(c)
                    new.append(not seen)
            for data, (t, g, p, a, m, first) in stretches(b.column(1).take(pa.array(some, pa.int64())), length, gram):
                places: list[tuple[int, int, int, int]] = []
                those = np.flatnonzero(holds(sent.value, bits, g))
                raws = data.tobytes() if len(those) else b""
                for q, k, o, at, w, start in zip(t[those].tolist(), g[those].tolist(), (p - a)[those].tolist(), a[those].tolist(), m[those].tolist(), first[those].tolist(), strict=True):
                    x = raws[start : start + w + length - 1]
                    i = _hash64(o.to_bytes(4, "little", signed=True), x)
                    if new[q]:
                        places.append((k, i, cs[q], at))
                    have = held.get((k, i))
                    if have is None:
                        held[k, i] = [o, w, 1, x]
                        size += len(x) + 200
                    else:
                        have[2] = 2
                if places:
                    none = pa.nulls(len(places), long)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, long) for x in zip(*places, strict=True)), none, none, none, pa.nulls(len(places), pa.binary())], names=names)
                if size > _HELD:
                    yield release()
                    size = 0
        if held:
            yield release()

    found = texts.where(F.octet_length("text") >= length).mapInArrow(lean(run), "k bigint, i bigint, c bigint, at bigint, o bigint, m bigint, n bigint, x binary")
    return written(found, "passage-regions")


def crowded(pieces: DataFrame, crowd: int) -> DataFrame:
    """(k): groups with more than ``crowd`` different pieces; written."""
    return written(pieces.select("k", "i").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > crowd).select("k"), "passage-crowds")


def fewer_copies(pieces: DataFrame, copies: int = COPIES) -> DataFrame:
    """``pieces`` with ``_SALTS`` rows at most of each that has more than ``copies``: of a region that many tasks have seen, or of a piece of many regions."""
    many = written(pieces.groupBy("k", "i").agg(F.count(F.lit(1)).alias("r")).where(F.col("r") > copies).select("i").distinct(), "passage-copies")
    if many.isEmpty():
        return pieces
    bits, raw = bit_filter(many)
    sent = pieces.sparkSession.sparkContext.broadcast(raw)

    def those(found: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(holds(sent.value, bits, b.column(1).to_numpy(zero_copy_only=False)) == found))

        return pieces.mapInArrow(run, pieces.schema)

    salted = those(True).withColumn("salt", F.spark_partition_id() % _SALTS)
    added = salted.groupBy("k", "i", "salt").agg(F.first("o").alias("o"), F.first("m").alias("m"), F.sum("n").alias("n"), F.first("x").alias("x"))
    return written(those(False).unionByName(added.drop("salt")), "passage-regions")


def split(pieces: DataFrame, raw: bytes, bits: int, length: int, width: int) -> DataFrame:
    """Pieces of ``width`` windows from those of crowded groups, in groups by the bytes common to all their windows; written.

    k0, i0, lo: where a piece comes from, and its first window there.
    """
    sent = pieces.sparkSession.sparkContext.broadcast(raw)
    names = ["k", "i", "o", "m", "n", "x", "k0", "i0", "lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = np.flatnonzero(holds(sent.value, bits, b.column(0).to_numpy(zero_copy_only=False)))
            out: list[tuple] = []
            k0, i0, o, m, n, x = (b.column(q).take(pa.array(some)).to_pylist() for q in range(6))
            for q in range(len(some)):
                for j in range(max(0, o[q] - m[q] + 1) // width if o[q] >= m[q] - 1 else -((m[q] - 1 - o[q] + width - 1) // width), o[q] // width + 1):
                    # Windows whose anchor is j * width .. j * width + width - 1 bytes after their start.
                    last, first = min(m[q] - 1, o[q] - j * width), max(0, o[q] - j * width - width + 1)
                    if first > last:
                        continue
                    core = x[q][o[q] - j * width : o[q] - j * width - width + 1 + length]
                    piece = x[q][first : last + length]
                    at = k0[q].to_bytes(8, "little", signed=True) + j.to_bytes(8, "little", signed=True)
                    k = _hash64(at, core)
                    out.append((k, _hash64((o[q] - first).to_bytes(8, "little", signed=True), piece), o[q] - first, last - first + 1, n[q], piece, k0[q], i0[q], first))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if name == "x" else pa.int64()) for name, v in zip(names, columns, strict=True)], names=names)

    schema = "k bigint, i bigint, o bigint, m bigint, n bigint, x binary, k0 bigint, i0 bigint, lo bigint"
    return written(pieces.select("k", "i", "o", "m", "n", "x").mapInArrow(lean(run), schema), "passage-pieces")


def repeats(pieces: DataFrame, length: int) -> DataFrame:
    """(k, i, runs): for each different piece, the stretches of its windows that another piece, or another copy, repeats, as first * 2^32 + end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size, current = 0, None

        def sort() -> pa.RecordBatch | None:
            keys = list(held)
            texts: list[bytes] = []
            owners: list[int] = []
            for q, (m, n, x) in enumerate(held.values()):
                texts += [x] * min(2, n)
                owners += [q] * min(2, n)
            every = Texts(texts)
            counts = np.array([held[keys[q]][0] for q in owners], np.int64)
            mark = np.zeros(len(every.symbols) + 1, np.int32)
            np.add.at(mark, every.starts, 1)
            np.add.at(mark, every.starts + counts, -1)
            again = every.repeated(np.cumsum(mark)[:-1] > 0, length)
            first = np.flatnonzero(again & ~np.concatenate([[False], again[:-1]]))
            last = np.flatnonzero(again & ~np.append(again[1:], False))
            text = np.searchsorted(every.starts, first, "right") - 1
            own = np.array(owners)[text]
            use = np.concatenate([[True], np.array(owners)[1:] != np.array(owners)[:-1]])[text]  # one of two copies speaks for both
            held.clear()
            if not use.any():
                return None
            own, first, last = own[use], (first - every.starts[text])[use], (last + 1 - every.starts[text])[use]
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            k, i = (np.array([keys[q][z] for q in own[new]], np.int64) for z in (0, 1))
            runs = pa.ListArray.from_arrays(pa.array(np.append(new, len(own)), pa.int32()), pa.array((first << 32) + last, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), runs], names=["k", "i", "runs"])

        for b in batches:
            for k, i, m, n, x in zip(*(b.column(q).to_pylist() for q in range(4)), b.column(4), strict=True):
                if k != current:
                    if size > _SORTED:
                        done = sort()
                        if done is not None:
                            yield done
                        size = 0
                    current = k
                have = held.get((k, i))
                if have is None:
                    data = x.as_py()
                    held[k, i] = [m, n, data]
                    size += len(data)
                else:
                    have[1] += n
        if held:
            done = sort()
            if done is not None:
                yield done

    grouped = pieces.select("k", "i", "m", "n", "x").repartition("k").sortWithinPartitions("k")
    return grouped.mapInArrow(lean(run), "k bigint, i bigint, runs array<bigint>")


def _not_in(pieces: DataFrame, filters: tuple[int, bytes] | None) -> DataFrame:
    """Without the groups that are split. (The same bits decide there, so nothing is lost or doubled.)"""
    if filters is None:
        return pieces
    bits, raw = filters
    sent = pieces.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~holds(sent.value, bits, b.column(0).to_numpy(zero_copy_only=False))))

    return pieces.mapInArrow(lean(run), pieces.schema)


def _shifted(runs: str, by: Column, longer: int = 0) -> Column:
    return F.transform(runs, lambda r: r + F.shiftleft(by, 32) + by + longer)


def of_origins(came: DataFrame, found: DataFrame) -> DataFrame:
    """(k, i, runs) of what was split, one row each, from those of its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [[(lo << 32) + hi for lo, hi in merged(r.values.to_numpy(zero_copy_only=False))] for r in b.column(2)]
            yield b.set_column(2, "runs", pa.array(runs, pa.list_(pa.int64())))

    each = came.join(found, ["k", "i"]).select(F.col("k0").alias("k"), F.col("i0").alias("i"), _shifted("runs", F.col("lo")).alias("runs"))
    return each.groupBy("k", "i").agg(F.flatten(F.collect_list("runs")).alias("runs")).mapInArrow(lean(run), "k bigint, i bigint, runs array<bigint>")


def repeated_stretches(found: DataFrame, length: int, crowd: int) -> DataFrame:
    """(k, i, runs) for the regions, one row each, through as many levels of splitting as their groups need."""
    pieces = fewer_copies(found.where("x IS NOT NULL").select("k", "i", "o", "m", "n", "x"))
    parts: list[DataFrame] = []
    origin: list[DataFrame] = []
    for width in (max(1, length // 12), 1, 0):
        many = crowded(pieces, crowd) if width else None
        filters = bit_filter(many) if many is not None and not many.isEmpty() else None
        parts.append(repeats(_not_in(pieces, filters), length))
        if filters is None:
            break
        smaller = split(pieces, filters[1], filters[0], length, width)
        origin.append(smaller.select("k", "i", "k0", "i0", "lo").distinct())
        pieces = fewer_copies(smaller.select("k", "i", "o", "m", "n", "x"))
    # A region in many texts is joined with one row, however many stretches its pieces gave.
    out = parts.pop()
    while origin:
        out = parts.pop().unionByName(of_origins(origin.pop(), out))
    return out


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Packed spans as (first, end), those that overlap or touch as one."""
    spans = np.sort(spans)
    lo, hi = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.concatenate([[True], lo[1:] > hi[:-1]]) if len(spans) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(spans)) - 1 if len(first) else first
    return list(zip(lo[first].tolist(), hi[last].tolist(), strict=True))


def cut(data: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    """The pieces of ``data`` between the (merged) spans."""
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(data[at:lo])
        at = hi
    return [*kept, data[at:]]


def spans_of_texts(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(c, spans): the repeated byte spans of each different text that has any, as first byte * 2^32 + end; written."""
    texts = _texts(docs, text_col)
    with scope() as kept:
        found = regions(texts, frequent_grams(texts, length, gram), length, gram)
        places = found.where("c IS NOT NULL").select("k", "i", "c", "at").distinct()
        spans = places.join(repeated_stretches(found, length, crowd), ["k", "i"])
        spans = spans.select("c", _shifted("runs", F.col("at"), length - 1).alias("s"))
        out = written(spans.groupBy("c").agg(F.flatten(F.collect_list("s")).alias("spans")), "passage-spans")
        kept.append(out)
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each word (what stands between ASCII white space, or a bound) of a segment, and where it begins."""
    table, up, down = _powers()
    inked = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    after, before = np.concatenate([[False], inked]), np.concatenate([inked, [False]])
    first = np.flatnonzero(before & (~after | edge))
    last = np.flatnonzero(after & (~before | edge))
    if not len(first):
        return np.zeros(0, np.uint64), first
    sums = np.cumsum(np.concatenate([[np.uint64(0)], table[data] * up[: len(data)]]).astype(np.uint64))
    return _mixed((sums[last] - sums[first]) * down[first]), first


def long_word_hashes(data: np.ndarray) -> np.ndarray:
    """The same of a text that is longer than a segment; words that are themselves longer are hashed alone."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = at + _SEGMENT
        if end < len(data):
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                while end < len(data) and not _BLANK[data[end : end + 4096]].any():
                    end += 4096
                end = end + int(np.argmax(_BLANK[data[end : end + 4096]])) if end < len(data) else len(data)
                if end - at > _SEGMENT:
                    out.append(np.array([_hash64(data[at:end].tobytes()) & (2**64 - 1)], np.uint64))
                    at = end
                    continue
        part = data[at:end]
        out.append(word_hashes(part, np.array([0, len(part)]))[0])
        at = end
    return np.concatenate(out)


def word_windows(h: np.ndarray, width: int) -> np.ndarray:
    """64 bits of each ``width`` neighbouring words, by their hashes; the sums run over a segment."""
    _, up, down = _powers()
    out = [np.zeros(0, np.uint64)]
    for at in range(0, len(h) - width + 1, _SEGMENT):
        part = h[at : at + _SEGMENT + width - 1]
        n = len(part)
        sums = np.cumsum(np.concatenate([[np.uint64(0)], part * up[:n]]).astype(np.uint64))
        out.append(_mixed((sums[width:] - sums[:-width]) * down[: n - width + 1]))
    return np.concatenate(out)


def word_anchors(h: np.ndarray, words: int, gram: int) -> np.ndarray:
    """The anchor (a hash of ``gram`` words) of each window of ``words`` words."""
    grams = word_windows(h, gram)
    out = [np.zeros(0, np.int64)]
    width = words - gram + 1
    for at in range(0, len(h) - words + 1, _SEGMENT):
        part = grams[at : at + _SEGMENT + width - 1]
        out.append(part[least_places(part, width)].view(np.int64))
    return np.concatenate(out)


def windows_of(pieces: pa.Array, words: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For ``chunks`` of pieces, their windows of words: piece (by its number), number of the first word in it, window's hash, anchor's hash."""
    for i, data, bounds in chunks(pieces):
        if len(data) > _SEGMENT:
            h = long_word_hashes(data)
            piece = np.zeros(len(h), np.int64)
        else:
            h, first = word_hashes(data, bounds)
            piece = np.searchsorted(bounds, first, "right") - 1
        if len(h) >= words:
            at = np.flatnonzero(piece[: len(h) - words + 1] == piece[words - 1 :])
            if len(at):
                number = at - np.searchsorted(piece, piece[at], "left")
                yield piece[at] + i, number, word_windows(h, words)[at].view(np.int64), word_anchors(h, words, gram)[at]


def shared_passages(left: DataFrame, words: int = WORDS) -> DataFrame:
    """(c, n_passages) from (c, pieces): of each text that has any, the runs of ``words`` words or more in its pieces whose windows other texts have in theirs; written.

    Words are what stands between ASCII white space, whatever white space that is.
    """
    gram = max(1, min(WORD_GRAM, words // 3))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """(c, place, window, anchor) of all windows; place: the piece's number in the text above, the word's in the piece below."""
        seen: set[int] = set()
        for b in batches:
            new = []
            for q, c in enumerate(b.column(0).to_pylist()):
                if c not in seen:
                    seen.add(c)
                    new.append(q)
            some = b.take(pa.array(new, pa.int64()))
            pieces, c = some.column(1), some.column(0).to_numpy(zero_copy_only=False)
            begin = pieces.offsets.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(new)), np.diff(begin))
            for piece, number, w, g in windows_of(pieces.flatten(), words, gram):
                own = owner[piece]
                yield c[own], ((piece - begin[own]) << 32) + number, w, g

    def batched(found: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for x in found:
            held.append(x)
            size += len(x[0])
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in zip(*held, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in zip(*held, strict=True)], names=names)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for c, _, _, g in each(batches):
                new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
                yield g[new], c[new]

        return batched(found(), ["g", "c"])

    shared = F.min("c") < F.max("c")
    grams = left.mapInArrow(lean(anchored), "g bigint, c bigint").groupBy("g").agg(shared.alias("shared")).where("shared").select("g")
    grams = written(grams, "shared-grams")
    bits, raw = bit_filter(grams)
    sent = left.sparkSession.sparkContext.broadcast(raw)

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for c, at, w, g in each(batches):
                some = holds(sent.value, bits, g)
                if some.any():
                    yield w[some], c[some], at[some]

        return batched(found(), ["w", "c", "at"])

    windows = written(left.mapInArrow(lean(windowed), "w bigint, c bigint, at bigint"), "shared-windows")
    counted = written(windows.groupBy("w").agg(shared.alias("shared"), F.count(F.lit(1)).alias("n")).where("shared").select("w", "n"), "shared-counts")
    w_bits, w_raw = bit_filter(counted.select("w"))
    w_sent = left.sparkSession.sparkContext.broadcast(w_raw)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(holds(w_sent.value, w_bits, b.column(0).to_numpy(zero_copy_only=False))))

    hot = skew.hot_keys(counted, "w", "n")
    places = skew.salted_join(windows.mapInArrow(likely, windows.schema), counted.select("w"), "w", hot, F.col("c"))
    runs = places.groupBy("c").agg(F.array_sort(F.collect_set("at")).alias("p"))
    begins = F.filter(F.col("p"), lambda x, i: (i == 0) | (F.get(F.col("p"), i - 1) < x - 1))
    out = written(runs.select("c", F.size(begins).cast("long").alias("n_passages")), "shared-passages")
    discard(grams, windows, counted)
    return out


def _of_spans(spans: DataFrame, docs: DataFrame) -> Callable[[bool], Callable]:
    """Batches of rows (c, ...) whose text may have spans, or of all others; a text once for each task."""
    bits, raw = bit_filter(spans.select("c"))
    sent = docs.sparkSession.sparkContext.broadcast(raw)

    def those(found: bool) -> Callable:
        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                keys = b.column(0).to_numpy(zero_copy_only=False)
                new = []
                for q in np.flatnonzero(holds(sent.value, bits, keys) == found).tolist():
                    if int(keys[q]) not in seen:
                        seen.add(int(keys[q]))
                        new.append(q)
                if new:
                    yield b.take(pa.array(new))

        return once

    return those


def cut_texts(docs: DataFrame, spans: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """What is left of each different text.

    (c, pieces, n_removed, n_spans, kept_sha256) of those with repeated spans (and a few
    more), written; and (c, pieces) of all others, with the whole text, once for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 512) for x in batches for at in range(0, x.num_rows, 512)):
            pieces, removed, runs, shas = [], [], [], []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                data, found = t.as_py(), merged(s.values.to_numpy(zero_copy_only=False)) if s.is_valid else []
                pieces.append(cut(data, found))
                removed.append(len(data) - sum(map(len, pieces[-1])))
                runs.append(len(found))
                shas.append(hashlib.sha256(b"".join(pieces[-1])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces, pa.list_(pa.binary())), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string())], names=["c", "pieces", "n_removed", "n_spans", "kept_sha256"])

    those = _of_spans(spans, docs)
    schema = "c bigint, text binary"
    # Each task has a text once; those of all tasks become few by salts, and then one.
    texts = _texts(docs, text_col).mapInArrow(lean(those(True)), schema).withColumn("salt", F.spark_partition_id() % _SALTS)
    single = texts.groupBy("c", "salt").agg(F.first("text").alias("text")).groupBy("c").agg(F.first("text").alias("text"))
    cuts = single.join(spans, "c", "left").select("c", "text", "spans").mapInArrow(lean(run), "c bigint, pieces array<binary>, n_removed bigint, n_spans bigint, kept_sha256 string")
    others = _texts(docs, text_col).mapInArrow(lean(those(False)), schema).select("c", F.array("text").alias("pieces"))
    return written(cuts, "passage-cuts"), others


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, words: int = WORDS) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, n_repeats for each row.

    A null text counts as empty; texts shorter than ``length`` bytes lose nothing, texts
    of any length are cut whole. Repeated rows repeat each other's bytes, so all of them
    lose these. An empty table gives an empty result; other columns are not looked at.
    Removal goes by bytes, so what is left need not be UTF-8. n_repeats counts the removed
    spans, and in what is left the passages, of ``words`` words or more, that other texts
    share but that are too short in bytes to be removed (``shared_passages``).
    """
    with scope() as kept:
        cuts, others = cut_texts(docs, spans_of_texts(docs, text_col, length, gram, crowd), text_col)
        long = others.where(F.octet_length(F.col("pieces")[0]) >= 2 * words - 1)
        passages = shared_passages(cuts.select("c", "pieces").unionByName(long), words)
        none = F.lit(0).cast("long")
        numbers = [F.coalesce(n, none).alias(n) for n in ("n_removed", "n_spans")]
        digest = cuts.drop("pieces").join(passages, "c", "full").select("c", *numbers, "kept_sha256", (F.coalesce("n_spans", none) + F.coalesce("n_passages", none)).alias("n_repeats"))
        digest = written(digest.where("n_repeats > 0"), "passage-digests")
        kept.append(digest)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("c"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    hot = skew.hot_keys(docs.select(F.xxhash64(text).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")), "c", "n", docs.count())
    joined = skew.salted_join(rows, digest, "c", hot, F.monotonically_increasing_id(), "left")
    numbers = [F.coalesce(n, none).alias(n) for n in ("n_removed", "n_spans", "n_repeats")]
    return joined.select(F.col("id").alias(id_col), "n_bytes", *numbers[:2], F.coalesce("kept_sha256", "sha").alias("kept_sha256"), numbers[2])
