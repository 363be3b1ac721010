import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardinia.llm import token_counts
from tests.llm.common import LONG, awkward, frame


def library(text):
    return len(token_counts.counter().tokenizer.encode(text or "", add_special_tokens=False).ids)


ALPHABET = st.sampled_from([*"abcdeGHI019 '.!?<|>²½éßİñΩж中あ́\U0001f600\t\n\x1c\x85 ​", "<|endoftext|>", "'ll", "th", "ing"])


@given(st.lists(ALPHABET, max_size=60).map("".join))
@settings(max_examples=300, deadline=None)
def test_counts_are_the_librarys(text):
    assert token_counts.counter().count(text) == library(text)


@pytest.mark.parametrize("text", [None, "", " ", LONG, "a" * 3000, "<|startoftext|>x<|endoftext|>", "I'll don't", "日本語テキスト"])
def test_edge_cases(text):
    assert token_counts.counter().count(text) == library(text)


def test_every_character_of_plain_texts():
    c = token_counts.counter()
    plain = [ch for ch in map(chr, range(0x250)) if token_counts._PLAIN.fullmatch(ch)]
    assert len(plain) > 500 and "\u0186" not in plain and "\u0259" not in plain
    back = c._bytes
    for ch in plain:
        for text in (ch, f"KONSTITUSIYA{ch}", f"KONSTITU{ch}IYA", f"9{ch}.", f"it's {ch}{ch}1"):
            pieces = c.tokenizer.pre_tokenizer.pre_tokenize_str(c.tokenizer.normalizer.normalize_str(text))
            assert c.words(text) == [bytes(map(back.__getitem__, p)).decode() for p, _ in pieces], hex(ord(ch))


@pytest.mark.parametrize("ch", ["\u0186", "\u018f", "\u0190", "\u0181", "\u018a", "\u0244", "\u023a", "\u0245"])
def test_capitals_with_far_lower_case(ch):
    for text in (f"KONSTITUSIYA{ch}", f"KONSTITU{ch}IYA", f"An {ch}{ch.lower()} b"):
        assert token_counts.counter().count(text) == library(text)


def test_every_prefix_of_a_word(spark):
    c = token_counts.counter()
    random.seed(1)
    for word in ["tokenization", "antidisestablishmentarianism", "straße", "zzzzqqqq", *["".join(random.choices("abehinorst", k=12)) for _ in range(40)]]:
        assert c.word_prefixes(word) == [library(word[:i]) for i in range(len(word) + 1)]


def test_tables_and_budgets():
    c = token_counts.counter()
    text = "The quick brown antidisestablishmentarianism, jumps 12 times"
    words, upto = c.table(text)
    assert upto[-1] == library(text) and [library(" ".join(words[:k])) for k in range(len(words) + 1)] == upto
    for budget in range(upto[-1] + 2):
        k, start, used = c.within(text, budget)
        assert used <= budget and used == library(" ".join([*words[:k], start]))
        if k < len(words):
            assert library(" ".join(words[: k + 1])) > budget


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    c = token_counts.PrefixCounter(token_counts.default_path())
    for i in range(50):
        assert c.count(f"word{i} abc{i}") == library(f"word{i} abc{i}")
    assert len(c.whole) <= 7


def test_rows(spark):
    rows = awkward()
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_rows(frame(spark, rows)).collect())
    assert got == sorted((r[0], len((r[1] or "").encode()), library(r[1]), library(r[1]) > 2048) for r in rows)
    assert any(r[3] for r in got)
    assert token_counts.count_rows(frame(spark, rows).limit(0)).count() == 0
