"""Filters of a bounded size that let all of a set of hashed keys through, and few others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bit_filter(keys: DataFrame, at_most: int = 27) -> tuple[int, bytes]:
    """Bits of the keys (uniform 64-bit integers), 2 ** ``at_most`` of them at most: what it lets through too much is joined away later."""
    bits = min(at_most, max(15, (16 * keys.count()).bit_length()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False)
            for seg in np.unique(at >> 15):
                own.setdefault(int(seg), np.zeros(1 << 15, np.uint8))[at[at >> 15 == seg] & 32767] = 1
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([np.packbits(x).tobytes() for x in own.values()], pa.binary())], names=["seg", "bits"])

    at = keys.select(F.col(keys.columns[0]).bitwiseAND(F.lit((1 << bits) - 1)).alias("at")).distinct()
    packed = at.repartition(F.shiftright("at", 15)).mapInArrow(pack, "seg int, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in packed.collect():  # 2 ** at_most bits at most
        out[r.seg * 4096 : (r.seg + 1) * 4096] |= np.frombuffer(bytes(r.bits), np.uint8)
    return bits, out.tobytes()


def holds(raw: bytes, bits: int, keys: np.ndarray) -> np.ndarray:
    """Mask of the keys (int64) that the filter lets through."""
    at = keys & ((1 << bits) - 1)
    return (np.frombuffer(raw, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
