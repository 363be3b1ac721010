import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardinia.llm import bpe
from tests.llm.common import LONG, awkward, frame


@given(st.text(alphabet=st.sampled_from(list("ab Z1!'sé\n\t  中\U0001f600")), max_size=200), st.integers(1, 20))
@settings(max_examples=300, deadline=None)
def test_parts_do_not_change_the_ids(text, part):
    enc, _ = bpe.encoder()
    assert "".join(bpe.parts(text, part)) == text
    assert [i for p in bpe.parts(text, part) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["", LONG, "a" * 200_000, " " * 200_000, "\n x" * 50_000, "<|endoftext|>"])
def test_long_and_special_texts(text):
    enc, _ = bpe.encoder()
    ids = bpe.encode(text)
    assert ids == enc.encode_ordinary(text) and bpe.decode(ids) == text.encode()
    n, a, b = bpe.digests(text)
    assert (n, a, b) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_rows(spark):
    rows = awkward()
    df = frame(spark, rows)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(df).collect())
    assert got == sorted((r[0], *bpe.digests(r[1])) for r in rows)
    ids = {(r.doc_id, tuple(r.ids), r.n_tokens) for r in bpe.encode_rows(df).collect()}
    assert ids == {(r[0], tuple(bpe.encode(r[1] or "")), len(bpe.encode(r[1] or ""))) for r in rows}
    assert bpe.encode_digests(df.limit(0)).count() == 0 and bpe.encode_rows(df.limit(0)).count() == 0
