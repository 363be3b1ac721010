"""Suffix arrays by two-stage sorting, for many short texts at once.

Stage one sorts only the suffixes that are smaller than their successors (type S),
directly. Stage two induces the others: buckets of one first byte are scanned in rising
order, and each suffix that is found, when its predecessor is larger than itself, sends
that predecessor to the end of its own bucket's larger part. A bucket's suffixes of
type L precede those of type S, so every bucket is complete when its scan begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Texts:
    """Texts one after the other, each followed by an end mark that is smaller than any byte."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        self.ends = self.starts + lengths
        self.raw = b"\0".join(texts) + b"\0"
        self.symbols = np.frombuffer(self.raw, np.uint8).astype(np.int16)
        self.symbols[self.ends] = -1
        self.end_of = np.repeat(self.ends.astype(np.int32), lengths + 1)

    def small(self) -> np.ndarray:
        """Whether the suffix at each place is smaller than the one after it; end marks are."""
        s = self.symbols
        after = np.append(s[1:], 0)
        kind = np.where(s < after, 1, np.where(s > after, 0, -1)).astype(np.int8)
        kind[self.ends] = 1
        # Equal symbols have the kind of the first place to the right that differs.
        places = np.arange(len(s), dtype=np.int32)
        decided = np.minimum.accumulate(np.where(kind >= 0, places, np.int32(len(s)))[::-1])[::-1]
        return kind[decided] == 1

    def directly_sorted(self, places: np.ndarray) -> np.ndarray:
        """Suffixes in order: by their first eight bytes, and where these agree, by all."""
        at = places[:, None] + np.arange(8)
        ends = self.end_of[places]
        at = np.minimum(at, ends[:, None])
        head = np.maximum(self.symbols[at], 0).astype(np.uint8)  # an end mark counts as 0 here: a tie, settled below
        words = head.reshape(-1).view(">u8").astype(np.uint64)
        order = np.argsort(words, kind="stable")
        sorted_words = words[order]
        out = places[order]
        edge = np.flatnonzero(np.concatenate([[True], sorted_words[1:] != sorted_words[:-1], [True]]))
        long = np.flatnonzero(np.diff(edge) > 1)
        raw, end_of = self.raw, self.end_of
        for a, b in zip(edge[long].tolist(), edge[long + 1].tolist(), strict=True):
            tied = out[a:b].tolist()
            tails = [raw[p:e] for p, e in zip(tied, end_of[out[a:b]].tolist(), strict=True)]
            out[a:b] = [tied[i] for i in sorted(range(len(tied)), key=tails.__getitem__)]
        return out

    def suffix_array(self, wanted: np.ndarray) -> np.ndarray:
        """The suffixes at the places ``wanted`` (a mask), and those that induce them, in order.

        The mask has to be whole stretches from a place on; each is carried on to the next
        suffix of type S, from which its larger ones are induced.
        """
        small = self.small()
        n = len(self.symbols)
        places = np.arange(n, dtype=np.int32)
        next_small = np.minimum.accumulate(np.where(small, places, np.int32(n))[::-1])[::-1]
        last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, last, 1)
        np.add.at(mark, next_small[last] + 1, -1)
        taken = wanted | (np.cumsum(mark)[:n] > 0)
        direct = self.directly_sorted(np.flatnonzero(taken & small))
        large = taken & ~small
        symbols = self.symbols
        first = symbols[direct]
        cut = np.searchsorted(first, np.arange(-1, 257))
        induced: list[list[np.ndarray]] = [[] for _ in range(256)]
        out: list[np.ndarray] = []
        for c in range(-1, 256):
            bucket: list[np.ndarray] = []
            if c >= 0:
                front = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
                induced[c] = []
                while len(front):
                    bucket.append(front)
                    before = front - 1
                    before = before[before >= 0]
                    front = before[large[before] & (symbols[before] == c)]
            bucket.append(direct[cut[c + 1] : cut[c + 2]])
            found = np.concatenate(bucket)
            if not len(found):
                continue
            out.append(found)
            before = found - 1
            before = before[before >= 0]
            before = before[large[before] & (symbols[before] > c)]
            if len(before):
                by = symbols[before]
                order = np.argsort(by, kind="stable")
                before, by = before[order], by[order]
                edge = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
                for part in np.split(before, edge[1:]):
                    induced[symbols[part[0]]].append(part)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def common_prefixes(self, order: np.ndarray, cap: int) -> np.ndarray:
        """Length, ``cap`` at most, of the common prefix of each suffix in ``order`` and the one before it (0 for the first)."""
        out = np.zeros(len(order), np.int64)
        if len(order) < 2:
            return out
        raw, ends = self.raw, self.end_of[order].tolist()
        places = order.tolist()
        tail = raw[places[0] : min(ends[0], places[0] + cap)]
        for i in range(1, len(places)):
            before, tail = tail, raw[places[i] : min(ends[i], places[i] + cap)]
            if tail == before:
                out[i] = len(tail)
            else:
                low, high = 0, min(len(tail), len(before))
                if before[:16] != tail[:16]:
                    high = min(high, 16)
                while low < high:
                    mid = (low + high + 1) // 2
                    if before[:mid] == tail[:mid]:
                        low = mid
                    else:
                        high = mid - 1
                out[i] = low
        return out

    def _equal(self, order: np.ndarray, length: int) -> Iterator[bool]:
        """Whether each suffix and the next agree in ``length`` bytes; two tails are held at a time."""
        raw, before = self.raw, None
        for at in range(0, len(order), 1 << 14):
            for p in order[at : at + (1 << 14)].tolist():
                tail = raw[p : p + length]
                if before is not None:
                    yield tail == before
                before = tail

    def repeated(self, wanted: np.ndarray, length: int) -> np.ndarray:
        """Mask of the wanted places whose next ``length`` bytes also start at another wanted place."""
        order = self.suffix_array(wanted)
        order = order[wanted[order]]
        out = np.zeros(len(self.symbols), bool)
        if len(order) > 1:
            enough = self.end_of[order] - order >= length
            same = np.fromiter(self._equal(order, length), bool, len(order) - 1)
            same &= enough[1:] & enough[:-1]
            out[order[1:][same]] = True
            out[order[:-1][same]] = True
        return out
