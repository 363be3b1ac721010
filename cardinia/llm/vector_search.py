"""Exact top-k search by inner product over vector-approximation files.

Vectors become integer vectors floor(256 x). Equal vectors are one candidate, with its
k + 1 smallest ids: no other of its rows can be among a query's k best. The candidates
are written in blocks, as they are read: a block has the cells of its vectors, each
component the number of one of at most 2 ** ``bits`` equal cells between the smallest and
the largest value of the block, and in another column the exact vectors.

Queries are a stated set (ids divisible by ``every``). Groups of them, of ``group_bytes``
at most, go to every task; the files stay where they are and are scanned twice:

1. Cells only. They bound each inner product from below and above; the k-th largest
   lower bound over all blocks is what a candidate's upper bound must reach.
2. Cells again, and exact vectors of the candidates that reach it, in the order of their
   upper bounds, a few at a time, until the k-th best exact score of the block's task
   beats the next upper bound. The tasks' k best are joined to the k best of all.

So only ids and scores are shuffled after the candidates are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardinia.llm._util import lean, scope, written

SCALE, EVERY, K = 256, 50, 5
BITS = 6
#: Vectors of a block.
BLOCK = 4096
#: Bytes of query vectors that are sent to every task at once.
GROUP_BYTES = 16 << 20
#: Queries whose bounds over a block are held at once, and exact vectors read at a time.
_AT_ONCE, STEP = 128, 32
_EXACT = 2.0**52


class ApproximationFile:
    """The cells of a block of integer vectors."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, width: np.ndarray, largest: float):
        self.cells, self.low, self.width, self.largest = cells, low, width, largest

    @staticmethod
    def of(vectors: np.ndarray, bits: int = BITS) -> ApproximationFile:
        low = vectors.min(0)
        width = np.maximum(1.0, np.ceil((vectors.max(0) - low + 1) / 2**bits))
        cells = np.floor((vectors - low) / width).astype(np.uint8 if bits <= 8 else np.uint16)
        return ApproximationFile(cells, low, width, float(np.abs(vectors).max(initial=0)))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds [queries, rows], and what each query adds to reach the upper ones."""
        least = np.minimum(queries, 0) @ (self.width - 1)
        base = (queries * self.width) @ self.cells.T.astype(np.float64) + (queries @ self.low + least)[:, None]
        slack = np.abs(queries) @ (self.width - 1)
        most = float(np.abs(queries).max(initial=0)) * (self.largest + float(self.width.max(initial=1))) * self.cells.shape[1]
        if most >= _EXACT:  # floats round there: widen the bounds by more than they can be off
            slack = slack + most * 1e-12
            base = base - most * 1e-12
        return base, slack


def inner_products(vectors: np.ndarray, query: np.ndarray, largest: float) -> np.ndarray:
    """As 64-bit integers, cut off at their ends. ``largest``: the largest component of the vectors' block."""
    if largest * float(np.abs(query).max(initial=0)) * len(query) < _EXACT:
        return (vectors @ query).astype(np.int64)
    q = [int(v) for v in query]
    ends = np.iinfo(np.int64)
    return np.array([min(ends.max, max(ends.min, sum(int(a) * b for a, b in zip(r, q, strict=True)))) for r in vectors], np.int64)


def best_ids(scored: list[tuple[int, np.ndarray, np.ndarray]], own: int, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best of (score, ids, times), as many as an id's ``times``, but not ``own``; ties to the smaller id."""
    out: list[tuple[int, int]] = []
    for score, ids, times in scored:
        for i, t in zip(ids.tolist(), times.tolist(), strict=True):
            if i != own:
                out += [(score, i)] * min(t, k)
    return sorted(out, key=lambda x: (-x[0], x[1]))[:k]


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids, times): each different vector with its k + 1 smallest ids, and how often each stands there."""
    counted = rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))
    # The limit holds in each task before rows are sent, so a very common vector is no burden.
    few = counted.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("rows")).select("v", F.col("rows.id").alias("ids"), F.col("rows.n").alias("times"))


_FILE = "d int, n int, ids binary, times binary, held binary, low binary, width binary, largest double, cells binary, x binary"


def approximated(found: DataFrame, scale: int = SCALE, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """The blocks, a row each: d components, n vectors, their ids (``held`` of each vector), cells and exact vectors."""
    names = [x.split()[0] for x in _FILE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.diff(b.column(0).offsets.to_numpy())
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(np.append(0, lengths))[:-1]
            held = np.diff(b.column(1).offsets.to_numpy())
            ids, times = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            first = np.cumsum(np.append(0, held))[:-1]
            out: list[tuple] = []
            for d in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == d)
                for at in range(0, len(of), block):
                    some = of[at : at + block]
                    x = np.floor(scale * flat[(starts[some][:, None] + np.arange(d)).reshape(-1)].reshape(len(some), d))
                    rows = np.concatenate([np.arange(first[i], first[i] + held[i]) for i in some])
                    f = ApproximationFile.of(x, bits)
                    out.append((d, len(some), ids[rows].tobytes(), times[rows].tobytes(), held[some].astype(np.int32).tobytes(), f.low.tobytes(), f.width.tobytes(), f.largest, f.cells.tobytes(), x.tobytes()))
            if out:
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.float64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return written(found.mapInArrow(lean(run), _FILE), "vector-files")


class _Queries:
    """A group of queries by their number of components: their places, ids and integer vectors."""

    def __init__(self, rows: list, scale: int):
        self.ids = [r.id for r in rows]
        by: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by.setdefault(len(r.v), []).append(i)
        self.of = {d: (np.array(at), np.floor(scale * np.array([rows[i].v for i in at], np.float64)).reshape(len(at), d)) for d, at in by.items()}


def _block(b: pa.RecordBatch, i: int) -> tuple[ApproximationFile, np.ndarray, np.ndarray, np.ndarray]:
    """A block's file; the ids of its vectors and how often each stands there, and where each vector's begin."""
    r = {name: b.column(name)[i].as_py() for name in ("d", "n", "ids", "times", "held", "low", "width", "largest", "cells")}
    kind = np.uint8 if len(r["cells"]) == r["n"] * r["d"] else np.uint16
    file = ApproximationFile(np.frombuffer(r["cells"], kind).reshape(r["n"], r["d"]), np.frombuffer(r["low"]), np.frombuffer(r["width"]), r["largest"])
    return file, np.frombuffer(r["ids"], np.int64), np.frombuffer(r["times"], np.int64), np.append(0, np.cumsum(np.frombuffer(r["held"], np.int32)))


def least_scores(files: DataFrame, sent, k: int) -> DataFrame:
    """(q, low): for each query of a group, the k-th largest lower bound of all candidates that have another row than its own; none with fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Queries = sent.value
        best: dict[int, np.ndarray] = {}  # by the number of components: k bounds for each query
        for b in batches:
            for i in range(b.num_rows):
                d = b.column("d")[i].as_py()
                if d not in asked.of:
                    continue
                at, vectors = asked.of[d]
                file, ids, _, begin = _block(b, i)
                # A candidate counts where it has a row besides the query's own.
                alone = {int(ids[begin[j]]): j for j in np.flatnonzero(np.diff(begin) == 1)}
                have = best.setdefault(d, np.full((len(at), k), -np.inf))
                for a in range(0, len(at), _AT_ONCE):
                    low, _ = file.bounds(vectors[a : a + _AT_ONCE])
                    for q in range(len(low)):
                        j = alone.get(asked.ids[at[a + q]])
                        if j is not None:
                            low[q, j] = -np.inf
                    both = np.concatenate([have[a : a + len(low)], low], axis=1)
                    have[a : a + len(low)] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        for d, have in best.items():
            q, low = np.repeat(asked.of[d][0], k), have.reshape(-1)
            there = low > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(q[there].astype(np.int32)), pa.array(low[there])], names=["q", "low"])

    found = files.select(*[c for c in files.columns if c != "x"]).mapInArrow(lean(run), "q int, low double")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))).where(F.col("r") <= k)
    return ranked.groupBy("q").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("q", "low")


def searched(files: DataFrame, sent, least, k: int) -> DataFrame:
    """(q, query_id, vec_id, score, reads): the k best of each task for each query of a group, and on one of its rows the exact vectors that it read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, must = sent.value, least.value
        best: dict[int, list[tuple[int, int]]] = {}
        reads: dict[int, int] = {}
        for b in batches:
            for i in range(b.num_rows):
                d = b.column("d")[i].as_py()
                if d not in asked.of:
                    continue
                at, vectors = asked.of[d]
                file, ids, times, begin = _block(b, i)
                exact = np.frombuffer(b.column("x")[i].as_buffer(), np.float64).reshape(file.cells.shape)
                for a in range(0, len(at), _AT_ONCE):
                    low, slack = file.bounds(vectors[a : a + _AT_ONCE])
                    for j in range(len(low)):
                        q = int(at[a + j])
                        upper = low[j] + slack[j]
                        there = np.flatnonzero(upper >= must[q])
                        there = there[np.argsort(-upper[there], kind="stable")]
                        mine = best.get(q, [])
                        for p in range(0, len(there), STEP):
                            if len(mine) == k and upper[there[p]] < mine[-1][0]:
                                break
                            some = there[p : p + STEP]
                            scores = inner_products(exact[some], vectors[a + j], file.largest).tolist()
                            mine = sorted([*mine, *best_ids([(s, ids[begin[v] : begin[v + 1]], times[begin[v] : begin[v + 1]]) for s, v in zip(scores, some.tolist(), strict=True)], asked.ids[q], k)], key=lambda x: (-x[0], x[1]))[:k]
                            reads[q] = reads.get(q, 0) + len(some)
                        if mine:
                            best[q] = mine
        out = [(q, asked.ids[q], vec, score, reads.pop(q, 0)) for q, found in best.items() for score, vec in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["q", "query_id", "vec_id", "score", "reads"])

    return files.mapInArrow(lean(run), "q long, query_id long, vec_id long, score long, reads long")


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = EVERY,
    k: int = K,
    scale: int = SCALE,
    bits: int = BITS,
    block: int = BLOCK,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest of each query, all if fewer.

    Rows whose vector is null or has a null or non-finite component, and rows without id,
    take no part. Only vectors of one length are compared. Candidates of a query are all
    rows but those of its own id; repeated rows count each on their own as candidates, and
    rows that repeat both id and vector are one query. An empty vector scores 0. Scores
    beyond 64 bits stop at their ends. An empty table gives an empty result; other columns
    are not looked at.
    """
    return ranked(found_by_tasks(vectors, id_col, vector_col, every, k, scale, bits, block, group_bytes), k)


def ranked(found: DataFrame, k: int = K) -> DataFrame:
    w = Window.partitionBy("g", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def found_by_tasks(vectors: DataFrame, id_col: str, vector_col: str, every: int = EVERY, k: int = K, scale: int = SCALE, bits: int = BITS, block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(g, q, query_id, vec_id, score, reads): ``searched`` for all groups of queries; written."""
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(fine)
    context = vectors.sparkSession.sparkContext
    with scope() as kept:
        files = approximated(candidates(rows, k), scale, bits, block)
        asked = written(rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]), "vector-queries")
        out: list[DataFrame] = []
        for g, group in enumerate(_groups(asked, group_bytes)):
            sent = context.broadcast(_Queries(group, scale))
            low = np.full(len(group), -np.inf)
            for r in least_scores(files, sent, k).collect():  # one row for each query of the group
                low[r.q] = r.low
            out.append(written(searched(files, sent, context.broadcast(low), k).select(F.lit(g).alias("g"), "*"), "vector-found"))
            sent.unpersist()
        kept.extend(out)
    found = out[0] if out else vectors.sparkSession.createDataFrame([], "g int, q long, query_id long, vec_id long, score long, reads long")
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def _groups(asked: DataFrame, group_bytes: int) -> Iterator[list]:
    """The queries, in groups of ``group_bytes`` at most (one at least); the driver holds one group and one partition of the written queries."""
    group: list = []
    size = 0
    for r in asked.toLocalIterator():
        own = 8 * len(r.v) + 64
        if group and size + own > group_bytes:
            yield group
            group, size = [], 0
        group.append(r)
        size += own
    if group:
        yield group


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
WHERE r <= 5
"""
