"""Reproducible sharding: a Feistel permutation of the global row numbers.

Rows are numbered 0 .. n-1 in the order (bucket, id, size, crc), where a row's bucket
is the first hex digits of md5 of these three: the offsets of the buckets come from one
small count, so no task ever sorts all rows. Rows that agree in the three are counted
before, so that they are one row while they are numbered. A keyed Feistel network permutes the numbers;
it works on the square [0, m)^2 with m = ceil(sqrt(n)), and numbers beyond n are
walked on along their cycle until they fall below n. Row p of the shuffle goes to
shard p mod shards, slot p div shards, so both can be computed from the number alone,
and the counts of the shards differ by one at most (law ``rows``).

DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardinia.llm import skew
from cardinia.llm._util import id_text, scope, text_or_empty, written

SHARDS = 24
ROUNDS = 6
#: Hex digits of a bucket, at least, and rows of a bucket from which there are more; the buckets' offsets are the only thing broadcast.
DIGITS, BUCKET_ROWS = 3, 1 << 20
#: A prime below 2 ** 31, so that products fit in a long.
PRIME = 2147483647
#: Steps of a walk before it is looked at again; the chance that one is longer is below (2 / m) ** WALK.
WALK = 64


def round_keys(seed: str, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    def number(what: str) -> int:
        return 1 + int(hashlib.md5(f"{seed}/{what}".encode()).hexdigest()[:12], 16) % (PRIME - 1)

    return [(number(f"a{k}"), number(f"c{k}")) for k in range(rounds)]


def _mix(x: Column, a: Column | int, c: Column | int, m: int) -> Column:
    t = (x * a + c) % F.lit(PRIME)
    # (t + a) * (t + c) mod PRIME, the round function's nonlinear part
    return (((t + a) % F.lit(PRIME)) * ((t + c) % F.lit(PRIME))) % F.lit(PRIME) % F.lit(m)


def _lit(x: int) -> Column:
    return F.lit(x).cast("long")


def _walked(start: Column, n: int, m: int, keys: list[tuple[int, int]]) -> Column:
    """The first number below n on the cycle of ``start`` (only evaluated for the few rows beyond n)."""
    net = F.array(*[F.struct(_lit(a).alias("a"), _lit(c).alias("c")) for a, c in keys])

    def once(p: Column) -> Column:
        zero = F.struct((p / F.lit(m)).cast("long").alias("l"), (p % F.lit(m)).alias("r"))
        return F.aggregate(
            net,
            zero,
            lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + _mix(s["r"], k["a"], k["c"], m)) % F.lit(m)).alias("r")),
            lambda s: s["l"] * m + s["r"],
        )

    def walk(p: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), p, lambda q, _: F.when(q >= n, once(q)).otherwise(q))

    longest = m * m - n + 1  # a cycle has no more numbers beyond n
    end = walk(start, min(longest, WALK))
    return end if longest <= WALK else F.when(end < n, end).otherwise(walk(end, longest))


def permuted(df: DataFrame, number: str, n: int, out: str, seed: str = "shuffle", rounds: int = ROUNDS) -> DataFrame:
    """Adds ``out``: the place of row ``number`` in a keyed permutation of 0 .. n-1."""
    m = max(1, math.isqrt(max(0, n - 1)) + 1)
    keys = round_keys(seed, rounds)
    df = df.withColumns({"__l": F.expr(f"`{number}` div {m}"), "__r": F.col(number) % F.lit(m)})
    for a, c in keys:
        df = df.withColumn("__n", (F.col("__l") + _mix(F.col("__r"), _lit(a), _lit(c), m)) % F.lit(m))
        df = df.withColumn("__l", F.col("__r")).withColumn("__r", F.col("__n"))
    df = df.withColumn("__p", F.col("__l") * F.lit(m) + F.col("__r")).drop("__l", "__r", "__n")
    return df.withColumn(out, F.when(F.col("__p") < n, F.col("__p")).otherwise(_walked(F.col("__p"), n, m, keys))).drop("__p")


def bucket_digits(rows: int) -> int:
    """Hex digits with which ``rows`` rows give buckets of ``BUCKET_ROWS`` at most."""
    digits = DIGITS
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def numbered(rows: DataFrame, columns: list[str], out: str) -> tuple[DataFrame, int]:
    """``columns`` (the first an id) and ``out``, a gapless global number from 0, of each row; and the number of rows.

    The order is (first md5 digits of the columns' texts, columns). Only the counts of
    the buckets are gathered: they are the sums that the offsets come from.
    """
    with scope() as kept:
        different = written(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__times")), "shard-rows")
        kept.append(different)
    total = different.agg(F.sum("__times").alias("n"), F.max("__times").alias("most")).first()
    n = total.n or 0
    key = F.md5(F.concat_ws("/", *[id_text(c) for c in columns]))
    different = different.withColumn("__bucket", F.conv(F.substring(key, 1, bucket_digits(n)), 16, 10).cast("long"))
    counts = different.groupBy("__bucket").agg(F.sum("__times").alias("__count"))
    offsets, at = [], 0
    for bucket, count in sorted(map(tuple, counts.collect())):  # 16 ** bucket_digits(n) rows at most
        offsets.append((bucket, at))
        at += count
    starts = rows.sparkSession.createDataFrame(offsets, "__bucket long, __offset long")
    before = F.coalesce(F.sum("__times").over(Window.partitionBy("__bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = different.withColumn("__first", before).join(F.broadcast(starts), "__bucket").withColumn("__first", F.col("__first") + F.col("__offset"))
    each = skew.each_copy(placed.select(*columns, "__times", "__first"), "__times", "__copy", (total.most or 0) > skew.CHUNK)
    return each.select(*columns, (F.col("__first") + F.col("__copy")).alias(out)), n


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: str = "shuffle") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row.

    size is the text's UTF-8 bytes plus 8 (null: 8), text_crc32 that of the bytes
    (null: of none, 0), however long it is. A null id is numbered like an empty one. Rows
    that agree in id, size and crc are interchangeable: each gets a slot of its own. An
    empty table gives an empty result. Other columns are not looked at.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(text).cast("long") + 8).alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"),
    )
    rows, n = numbered(rows, ["__id", "__size", "__crc"], "__row")
    placed = permuted(rows, "__row", n, "__place", seed)
    return placed.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        (F.col("__place") % shards).cast("int").alias("shard"),
        F.expr(f"__place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def where_is(row: int, n: int, shards: int = SHARDS, seed: str = "shuffle", rounds: int = ROUNDS) -> tuple[int, int]:
    """(shard, slot) of one row number, without any data: the computable half of the shuffle."""
    m = max(1, math.isqrt(max(0, n - 1)) + 1)
    p = row
    while True:
        left, right = divmod(p, m)
        for a, c in round_keys(seed, rounds):
            t = (right * a + c) % PRIME
            left, right = right, (left + (t + a) % PRIME * ((t + c) % PRIME) % PRIME % m) % m
        p = left * m + right
        if p < n:
            return p % shards, p // shards
