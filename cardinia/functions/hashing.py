"""Portable k-wise independent hashing, as SQL text that Spark and DuckDB read alike.

A value becomes an integer (``encoded``), the integer a residue modulo a prime, and a
polynomial over the residue, by Horner's rule, a hash. With the prime 2^31 - 1 every
step fits in a BIGINT, so no overflow is possible under ANSI rules, and both engines
give the same integers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

#: Mersenne primes; the larger one needs 128-bit integers.
P31 = 2**31 - 1
P61 = 2**61 - 1

SPARK, DUCKDB = "spark", "duckdb"


def encoded(column: str, kind: str, dialect: str = SPARK) -> str:
    """SQL for a column as BIGINT: integers as they are, timestamps in microseconds, strings by md5.

    kind: 'int', 'timestamp', 'double' or 'string'. NULL stays NULL.
    """
    if kind == "int":
        return f"CAST({column} AS BIGINT)"
    if kind == "double":
        return f"CAST(floor({column}) AS BIGINT)"
    if kind == "timestamp":
        return f"unix_micros(CAST({column} AS TIMESTAMP))" if dialect == SPARK else f"epoch_us(CAST({column} AS TIMESTAMP))"
    if kind == "string":
        digits = f"substr(md5(CAST({column} AS STRING)), 1, 15)" if dialect == SPARK else f"substr(md5(CAST({column} AS VARCHAR)), 1, 15)"
        return f"CAST(conv({digits}, 16, 10) AS BIGINT)" if dialect == SPARK else f"CAST('0x' || {digits} AS BIGINT)"
    raise ValueError(f"no encoding for {kind!r}")


def residue(integer: str, prime: int = P31) -> str:
    """SQL for (integer + 1) modulo the prime, never negative."""
    return f"((({integer}) % {prime} + 1 + {prime}) % {prime})"


def polynomial(residue_column: str, coefficients: tuple[int, ...], prime: int = P31) -> str:
    """SQL for the polynomial with these coefficients (highest first) at the residue."""
    out = str(coefficients[0])
    for c in coefficients[1:]:
        out = f"(({out} * {residue_column} + {c}) % {prime})"
    return out


@dataclass(frozen=True)
class HashFamily:
    """Seeds of all hash functions: a bin hash for each component, a sign hash for each join."""

    seed: int = 1
    sign_k: int = 4
    bin_k: int = 2
    prime: int = P31

    def coefficients(self, kind: str, index: int, row: int) -> tuple[int, ...]:
        k = self.sign_k if kind == "sign" else self.bin_k

        def draw(place: int, low: int) -> int:
            word = hashlib.md5(f"{self.seed}/{kind}/{index}/{row}/{place}".encode()).hexdigest()
            return low + int(word, 16) % (self.prime - low)

        return tuple(draw(p, 1) for p in range(k - 1)) + (draw(k - 1, 0),)

    def sign(self, residue_column: str, join: int, row: int) -> str:
        return f"({polynomial(residue_column, self.coefficients('sign', join, row), self.prime)} % 2 * 2 - 1)"

    def bin(self, residue_column: str, component: int, row: int, width: int) -> str:
        return f"({polynomial(residue_column, self.coefficients('bin', component, row), self.prime)} % {width})"


@dataclass(frozen=True)
class KeyUse:
    """A join key of a relation: its column, its component and the joins that touch it."""

    column: str
    kind: str
    component: int
    joins: tuple[int, ...]

    @property
    def residue_name(self) -> str:
        return f"x_{self.column}"


def tuple_bin(keys: tuple[KeyUse, ...], family: HashFamily, row: int, width: int) -> str:
    """SQL for a key tuple's bin: the sum of its keys' bins modulo the width."""
    if width == 1:
        return "0"
    total = " + ".join(family.bin(k.residue_name, k.component, row, width) for k in keys)
    return f"(({total}) % {width})"


def tuple_sign(keys: tuple[KeyUse, ...], family: HashFamily, row: int, shared: bool = False) -> str:
    """SQL for a key tuple's sign: the product over keys and their joins, or with ``shared`` one sign for each key."""
    factors = [family.sign(k.residue_name, j, row) for k in keys for j in ((0,) if shared else k.joins)]
    return f"({' * '.join(factors)})" if factors else "1"


def tuple_negative(keys: tuple[KeyUse, ...], family: HashFamily, row: int) -> str:
    """SQL for the product of the shared signs where all are negative, else 0."""
    signs = [family.sign(k.residue_name, 0, row) for k in keys]
    return f"({' * '.join(f'least({s}, 0)' for s in signs)})"
