"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before the library sees them, at safe boundaries only: before a
blank that follows a character that is not white space. Every alternative of the
pattern that takes a character other than white space ends at or before such a blank,
and none looks behind, so the matches of the parts are those of the whole text.
Decoding joins the raw bytes of the ids. Texts are hashed part by part, so memory is
bounded by the longest match and not by the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinia.llm._util import lean

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a part: the cut is the first safe boundary from there on.
PART = 1 << 15
_SAFE = re.compile(r"(?<=\S)[ \n\t\r]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


@lru_cache(maxsize=4)
def encoder(path: str | None = None, pattern: str | None = None):
    """The tiktoken encoding of a rank file, and the decimal text of each id."""
    import public_tokenizers
    import tiktoken

    with open(path or default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    enc = tiktoken.Encoding("local", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return enc, [str(i) for i in range(max(ranks.values()) + 1)]


def parts(text: str, part: int = PART) -> Iterator[str]:
    """``text`` cut at safe boundaries; a stretch without any stays whole."""
    at = 0
    while len(text) - at > part:
        cut = _SAFE.search(text, at + part)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode(text: str, path: str | None = None) -> list[int]:
    enc, _ = encoder(path)
    return [i for p in parts(text) for i in enc.encode_ordinary(p)]


def decode(ids: Iterable[int], path: str | None = None) -> bytes:
    return encoder(path)[0].decode_bytes(list(ids))


def digests(text: str | None, path: str | None = None) -> tuple[int, str, str]:
    """Number of tokens, sha256 of the decimal ids joined by commas, sha256 of the decoded bytes."""
    enc, decimal = encoder(path)
    n, ids_sha, bytes_sha = 0, hashlib.sha256(), hashlib.sha256()
    for p in parts(text or ""):
        ids = enc.encode_ordinary(p)
        if ids:
            ids_sha.update((("," if n else "") + ",".join(map(decimal.__getitem__, ids))).encode())
            bytes_sha.update(enc.decode_bytes(ids))
            n += len(ids)
    return n, ids_sha.hexdigest(), bytes_sha.hexdigest()


def encode_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ids (array of int) and n_tokens for each row; null counts as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode(t or "", path) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())], names=["id", "ids", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, ids array<int>, n_tokens bigint")
    return out.withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 for each row, whatever its text.

    Null counts as the empty text, which has no ids. Repeated rows are encoded each on
    its own. An empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [digests(t.as_py(), path) for t in b.column(1)]
            n, ids, raw = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
