"""Token counts by prefix dynamic programming over a BPE with word ends.

For a word, ``last[i]`` is the last token of the encoding of its first i bytes and
``inner[i]`` the number of its tokens. Encodings of prefixes extend each other: the
token t that ends at i is the last one if and only if it may follow ``last[i - len t]``,
that is if the pair alone is what the merges make of their joined text. So each
position takes a few look-ups, no merging. A text that stops after byte i ends its word
there, so ``final[i]`` repeats the step with the tokens that carry the word end.

With the counts of all words before it, this is the exact token count of every prefix
of a text: budgets and truncation are look-ups, nothing is encoded again.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinia.llm._util import lean

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Words whose counts a worker remembers before it starts anew.
REMEMBERED = 400_000

_LETTERS = "a-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
#: Capitals whose lower-case letters are beyond _LETTERS, such as U+0186.
_FAR = {c for c in map(chr, range(0x100, 0x250)) if c.lower() > "\u024f"}
#: Texts of these characters alone are in normal form C and mean the same to every Unicode version.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-\xff" + "".join(c for c in map(chr, range(0x100, 0x250)) if c != "\u0130" and c not in _FAR) + "]*")
_PLAIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


class PrefixCounter:
    """Exact token counts at every prefix, for a tokenizers file of a BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.tokenizer = Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        base = [t for t in model["vocab"] if t not in made]
        # Ids in the order of the merges, whatever the vocabulary's own numbers.
        self.rank = {t: k for k, t in enumerate([*base, *(a + b for a, b in merges)])}
        self.split = [(k, k) for k in range(len(base))] + [(self.rank[a], self.rank[b]) for a, b in merges]
        self.pairs = {(self.rank[a], self.rank[b]): self.rank[a + b] for a, b in merges}
        self.inner = {t: k for t, k in self.rank.items() if not t.endswith(self.end) or t == self.end}
        self.last_of = {t[: -len(self.end)]: k for t, k in self.rank.items() if t.endswith(self.end) and t != self.end}
        self.longest = max(map(len, [*self.inner, *self.last_of]))
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.follows: dict[tuple[int, int], bool] = {}
        self.whole: dict[str, int] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printable]
        self.byte = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(other)}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave the texts of a and b, joined, as a and b."""
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > 2 * REMEMBERED:
                self.follows.clear()
            known = self.follows[a, b] = self._may_follow(a, b)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        # Undo the latest merges beside the seam; a merge across it that comes earlier
        # than the one undone last would have been made instead.
        limit = len(self.rank) + 1
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < limit:
                return False
            left, right = self.split[a], self.split[b]
            if a > b and left != (a, a) or right == (b, b):
                if left == (a, a):
                    return True
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]

    def steps(self, symbols: str) -> tuple[list[int], list[int]]:
        """last and inner of a word in byte symbols."""
        last, inner, known, longest = [-1], [0], self.inner, self.longest
        for i in range(1, len(symbols) + 1):
            for j in range(max(0, i - longest), i):
                t = known.get(symbols[j:i])
                if t is not None and (j == 0 or self.may_follow(last[j], t)):
                    last.append(t)
                    inner.append(inner[j] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last, inner

    def final(self, symbols: str, last: list[int], inner: list[int], i: int) -> int:
        """Tokens of the word that ends after byte i."""
        for j in range(max(0, i - self.longest), i):
            t = self.last_of.get(symbols[j:i])
            if t is not None and (j == 0 or self.may_follow(last[j], t)):
                return inner[j] + 1
        raise ValueError("the vocabulary lacks a byte at a word's end")

    def symbols(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() and " " not in word else "".join(map(self.byte.__getitem__, word.encode()))

    def word_prefixes(self, word: str) -> list[int]:
        """Token counts of the word's prefixes of 0, 1, ... characters, each as a word of its own."""
        s = self.symbols(word)
        last, inner = self.steps(s)
        ends = accumulate((len(c.encode()) for c in word), initial=0)
        return [self.final(s, last, inner, i) if i else 0 for i in ends]

    def word(self, word: str) -> int:
        n = self.whole.get(word)
        if n is None:
            if len(self.whole) > REMEMBERED:
                self.whole.clear()
            s = self.symbols(word)
            last, inner = self.steps(s)
            n = self.final(s, last, inner, len(s))
            self.whole[word] = n
        return n

    def words(self, text: str) -> list[str]:
        """The library's words of a text without special strings, in normal form, lower case."""
        if _PLAIN.fullmatch(text):
            return _PLAIN_WORD.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        back = self._bytes
        return [bytes(map(back.__getitem__, piece)).decode("utf-8", "surrogateescape") for piece, _ in pieces]

    @property
    def _bytes(self) -> dict[str, int]:
        if not hasattr(self, "_back"):
            self._back = {c: b for b, c in self.byte.items()}
        return self._back

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings: (part, whether it is one)."""
        if self.special is None or "<|" not in text:
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def count(self, text: str | None) -> int:
        """The last entry of the text's prefix table."""
        n = 0
        for part, special in self.segments(text or ""):
            if special:
                n += 1
            elif part:
                for w, times in Counter(self.words(part)).items():
                    n += times * self.word(w)
        return n

    def table(self, text: str | None) -> tuple[list[str], list[int]]:
        """The text's words in order, and the token count up to each (from 0)."""
        words, costs = [], []
        for part, special in self.segments(text or ""):
            more = [part] if special else self.words(part)
            words += more
            costs += [1] if special else map(self.word, more)
        return words, list(accumulate(costs, initial=0))

    def within(self, text: str | None, budget: int) -> tuple[int, str, int]:
        """How far a budget of tokens goes: whole words, the start of the next word that still fits, and the tokens used."""
        words, upto = self.table(text)
        k = min(bisect_right(upto, budget) - 1, len(words))
        if k >= len(words) or (self.special is not None and self.special.fullmatch(words[k])):
            return k, "", upto[k]
        left, inside = budget - upto[k], self.word_prefixes(words[k])
        c = max(i for i, n in enumerate(inside) if n <= left)
        return k, words[k][:c], upto[k] + inside[c]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def counter(path: str | None = None) -> PrefixCounter:
    return PrefixCounter(path or default_path())


def count_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row, from the last prefix of its whole text.

    Null counts as the empty text, which has no tokens; texts of any length are counted
    whole. Repeated rows are counted each on its own. An empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            n = [c.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"]).append_column("n_bytes", pa.array([len((t.as_py() or "").encode()) for t in b.column(1)], pa.int64()))

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, n_tokens bigint, n_bytes bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
