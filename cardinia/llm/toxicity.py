"""Toxicity: a factorization machine over hashed terms.

A document's terms are its distinct lower-case words and their first letters (stems of
4 and 5 letters). Hashed to 2 ** BITS buckets, they give

    score = sigmoid(bias + sum w_i x_i + 1/n sum_{i<j} <v_i, v_j> x_i x_j),   n the number of terms:

the linear part learns words that are toxic alone, the factors pairs that are toxic
only together (an insult and the group it is aimed at).

The model is fitted on a bounded sample of the labelled rows (``sample_rows``, in the
order of a hash of the id, as far as their terms have ``SAMPLE_BYTES``), by full-batch gradient steps on the buckets that ``least_docs``
documents of the sample or more hold and that tell its classes apart, alone or in pairs with
others; all rows are scored on their whole texts.
The model has a fixed size (``terms`` buckets), so it can be sent to every task.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinia.llm._util import lean, scope, written

BITS = 20
FACTORS = 4
#: The bound on the labelled rows that the model is fitted on.
SAMPLE_ROWS = 16_000
#: And on the bytes of their packed terms, which the driver holds.
SAMPLE_BYTES = 96 << 20
#: The bound on the buckets that it keeps.
TERMS = 30_000
LEAST_DOCS = 3
#: Standard deviations by which a bucket's toxic documents must differ from chance.
LEAST_Z = 4.5
#: Documents' worth of unexplained labels, and its standard deviations, from which two buckets count as a pair.
LEAST_PAIR, LEAST_PAIR_Z = 5, 8.0
#: Buckets whose pairs are counted at once.
_BLOCK = 512
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose buckets a worker remembers before it starts anew.
_REMEMBERED = 100_000


def buckets(word: str, bits: int = BITS) -> tuple[int, ...]:
    """The hashed terms of a word: itself and its stems."""
    mask = (1 << bits) - 1
    terms = {f"w {word}"} | {f"p {word[:k]}" for k in (4, 5) if len(word) >= k}
    return tuple(zlib.crc32(t.encode()) & mask for t in terms)


class Terms:
    """Distinct hashed terms of texts, or of those among them that a model knows."""

    def __init__(self, bits: int, known: dict[int, int] | None = None):
        self.bits, self.known, self.seen = bits, known, {}

    def of(self, text: str | None) -> list[int]:
        out: set[int] = set()
        seen, known = self.seen, self.known
        for w in set(_WORD.findall((text or "").lower())):
            ids = seen.get(w)
            if ids is None:
                if len(seen) > _REMEMBERED:
                    seen.clear()
                ids = buckets(w, self.bits)
                if known is not None:
                    ids = tuple(known[i] for i in ids if i in known)
                seen[w] = ids
            if ids:
                out.update(ids)
        return sorted(out)


class FactorizationMachine:
    """bias, linear weights w[terms] and factors v[terms, k] over the kept buckets."""

    def __init__(self, kept: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray, bits: int):
        self.kept, self.bias, self.w, self.v, self.bits = kept, bias, w, v, bits

    def raw(self, ids: list[int]) -> float:
        if not ids:
            return self.bias
        v = self.v[ids]
        s = v.sum(0)
        return float(self.bias + self.w[ids].sum() + 0.5 * (s @ s - (v * v).sum()) / len(ids))

    def terms(self) -> Terms:
        return Terms(self.bits, {int(b): i for i, b in enumerate(self.kept)})

    @staticmethod
    def probability(raw: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def fit(docs: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, terms: int = TERMS, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z, steps: int = 400, l1: float = 1e-6, l2: float = 1e-5) -> FactorizationMachine:
    """The machine on the buckets that tell the classes apart alone, and on those that do in pairs. ``docs``: the distinct buckets of each document.

    Without labelled rows, or with one class alone, the model is its (smoothed) rate.
    """
    y = np.asarray(labels, float)
    n = len(y)
    rate = (y.sum() + 0.1) / (n + 1.0)
    bias = float(np.log(rate / (1 - rate)))
    none = FactorizationMachine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, factors)), bits)
    if n == 0 or y.min() == y.max():
        return none
    total, toxic = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
    for d, label in zip(docs, y, strict=True):  # buckets of a document are distinct
        total[d] += 1
        if label > 0:
            toxic[d] += 1
    # Of the buckets with enough documents, those whose share of toxic ones is least like the whole's.
    odd = np.abs(toxic - total * rate) / np.sqrt(total * rate * (1 - rate) + 1e-9)
    usual = total >= least_docs
    kept = np.flatnonzero(usual & (odd >= least_z))
    kept = np.sort(kept[np.argsort(-odd[kept], kind="stable")[:terms]])
    if least_z > 0 and len(kept) < terms:
        # What these cannot explain alone shows which others matter in pairs.
        alone = _descend(none, kept, docs, y, steps // 2, l1, l2, False)[1] if len(kept) else np.full(n, rate)
        kept = np.union1d(kept, paired(docs, y, alone, np.flatnonzero(usual), kept, bits, terms))
    return _descend(none, kept, docs, y, steps, l1, l2, True)[0] if len(kept) else none


def _places(docs: list[np.ndarray], kept: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place among ``kept`` of each kept bucket of each document, by rows."""
    at = np.full(1 << bits, -1, np.int32)
    at[kept] = np.arange(len(kept))
    found = [at[d] for d in docs]
    found = [c[c >= 0] for c in found]
    return np.repeat(np.arange(len(docs), dtype=np.int32), [len(c) for c in found]), np.concatenate(found)


def paired(docs: list[np.ndarray], y: np.ndarray, p: np.ndarray, usual: np.ndarray, kept: np.ndarray, bits: int, terms: int = TERMS) -> np.ndarray:
    """Buckets, not yet ``kept``, of the pairs that the probabilities ``p`` leave most unexplained.

    A pair's weight has the gradient sum (y - p) over the documents with both, of variance
    sum p (1 - p): the score test of the interaction. A bucket whose documents' errors add
    up to less than LEAST_PAIR has no pair that reaches it, so it need not be looked at.
    """
    error, spread = (y - p).astype(np.float32), (p * (1 - p)).astype(np.float32)
    mass = np.zeros(1 << bits)
    for d, e in zip(docs, np.abs(error), strict=True):
        mass[d] += e
    some = usual[mass[usual] >= LEAST_PAIR]
    if not len(some):
        return some
    row, col = _places(docs, some, bits)
    by_col = np.argsort(col, kind="stable")
    row, col = row[by_col], col[by_col]
    cuts = np.searchsorted(col, np.arange(0, len(some) + _BLOCK, _BLOCK))

    def dense(k: int) -> np.ndarray:
        out = np.zeros((len(docs), min(_BLOCK, len(some) - k * _BLOCK)), np.float32)
        out[row[cuts[k] : cuts[k + 1]], col[cuts[k] : cuts[k + 1]] - k * _BLOCK] = 1
        return out

    best = np.zeros(len(some))
    for i in range(len(cuts) - 1):
        a = dense(i)
        with_error, with_spread = (a * error[:, None]).T.copy(), (a * spread[:, None]).T.copy()
        for j in range(i, len(cuts) - 1):
            b = a if i == j else dense(j)
            g = np.abs(with_error @ b)
            if g.max() < LEAST_PAIR:
                continue
            z = np.where(g >= LEAST_PAIR, g / np.sqrt(with_spread @ b + 1e-9), 0)
            for at, top in ((i, z.max(1)), (j, z.max(0))):
                here = slice(at * _BLOCK, at * _BLOCK + len(top))
                best[here] = np.maximum(best[here], top)
    strong = best >= LEAST_PAIR_Z
    strong &= ~np.isin(some, kept)
    found = np.flatnonzero(strong)
    return some[found[np.argsort(-best[found], kind="stable")[: terms - len(kept)]]]


def _descend(none: FactorizationMachine, kept: np.ndarray, docs: list[np.ndarray], y: np.ndarray, steps: int, l1: float, l2: float, pairs: bool) -> tuple[FactorizationMachine, np.ndarray]:
    """The machine on ``kept`` buckets and its probabilities: Adam on the whole sample, with an l1 penalty on the linear weights and an l2 one on the factors, which stay as they start without ``pairs``."""
    n, bias, factors, bits = len(y), none.bias, none.v.shape[1], none.bits
    row, col = _places(docs, kept, bits)
    by_col = np.argsort(col, kind="stable")
    row_c, m = row[by_col], len(kept)
    starts_c = np.searchsorted(col[by_col], np.arange(m))
    starts_r = np.searchsorted(row, np.arange(n))
    per = 1 / np.maximum(1, np.bincount(row, minlength=n))
    full_r, full_c = np.bincount(row, minlength=n) > 0, np.bincount(col, minlength=m) > 0

    def by_rows(x: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(np.concatenate([x, np.zeros((1, *x.shape[1:]))]), starts_r)
        out[~full_r] = 0
        return out

    def by_cols(x: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(np.concatenate([x, np.zeros((1, *x.shape[1:]))]), starts_c)
        out[~full_c] = 0
        return out

    rng = np.random.default_rng(7)
    w, v = np.zeros(m), rng.normal(0, 0.01, (m, factors)) if pairs else np.zeros((m, factors))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v)]
    b, b_state = bias, [0.0, 0.0]
    # Both classes weigh the same up to a factor of three.
    weight = np.where(y > 0, min(3.0, (n - y.sum()) / y.sum()), 1.0)
    for t in range(1, steps + 1):
        vx = v[col]
        s = by_rows(vx)
        raw = b + by_rows(w[col][:, None])[:, 0] + 0.5 * per * ((s * s).sum(1) - by_rows((vx * vx).sum(1)[:, None])[:, 0])
        g = weight * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y)
        gw = by_cols(g[row_c][:, None])[:, 0] / n + l1 * np.sign(w)
        gs = by_cols((g * per)[row_c][:, None] * s[row_c])
        gv = (gs - by_cols((g * per)[row_c][:, None])[:, :1] * v) / n + l2 * v
        # The first half of the steps fits the linear part; the factors then learn what is left.
        for x, gx, st in ((w, gw, state[0]), (v, gv, state[1]))[: 1 + (pairs and 2 * t > steps)]:
            st[0] = 0.9 * st[0] + 0.1 * gx
            st[1] = 0.99 * st[1] + 0.01 * gx * gx
            x -= 0.1 * (st[0] / (1 - 0.9**t)) / (np.sqrt(st[1] / (1 - 0.99**t)) + 1e-8)
        gb = g.mean()
        b_state = [0.9 * b_state[0] + 0.1 * gb, 0.99 * b_state[1] + 0.01 * gb * gb]
        b -= 0.1 * (b_state[0] / (1 - 0.9**t)) / (np.sqrt(b_state[1] / (1 - 0.99**t)) + 1e-8)
    return FactorizationMachine(kept, float(b), w, v, bits), 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def packed(ids: list[int]) -> bytes:
    """Rising bucket numbers, by their differences."""
    return zlib.compress(np.diff(np.array(ids, np.int32), prepend=0).astype(np.int32).tobytes(), 6)


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), np.int32), dtype=np.int32)


def held_out(id_col: Column) -> Column:
    """crc32(id as text) mod 3 is 1: rows that never take part in fitting."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, bits: int = BITS, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed terms and labels of the fitting sample: ``rows`` labelled rows that are not held out, as far as their terms have ``sample_bytes``.

    Only this bounded sample reaches the driver. Rows without id or label are passed over;
    of an id that is labelled more than once, toxic counts.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    picked = usable.orderBy(F.xxhash64("__id"), "__id").limit(rows).toPandas()
    few = spark.createDataFrame(picked, f"__id {dict(labels.dtypes)[id_col]}, __y int") if len(picked) else usable.limit(0)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(bits)
        for b in batches:
            found = [packed(terms.of(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["y", "ids"])

    joined = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(few), "__id")
    with scope():
        found = written(joined.select("__y", "__text").mapInArrow(lean(hashed), "y int, ids binary"), "toxicity-sample")
        # Repeated ids in the documents could bring more rows than asked for: the bounds hold for them, too.
        order = [F.xxhash64("ids"), "y"]
        sizes = found.select("y", "ids", F.length("ids").alias("n")).orderBy(*order).select("n").limit(rows).toPandas()["n"].to_numpy()
        least = int(np.searchsorted(np.cumsum(sizes), sample_bytes, "right"))
        got = found.orderBy(*order).limit(least).toPandas()
    return [unpacked(x) for x in got["ids"]], got["y"].to_numpy(float)


def cross_validated(docs: list[np.ndarray], labels: np.ndarray, folds: int = 3, threshold: float = THRESHOLD, **settings) -> dict[str, float]:
    """precision, recall and f1 at the threshold, and auc, of documents that models fitted on the other folds score; ``settings`` as for ``fit``.

    This is how settings are compared: on the rows that a model may be fitted on, and no others.
    """
    y = np.asarray(labels, float)
    fold = np.random.default_rng(0).integers(0, folds, len(y))
    scores = np.zeros(len(y))
    for f in range(folds):
        model = fit([docs[i] for i in np.flatnonzero(fold != f)], y[fold != f], **settings)
        known = model.terms().known or {}
        for i in np.flatnonzero(fold == f):
            scores[i] = model.probability(model.raw(sorted(known[b] for b in docs[i].tolist() if b in known)))
    hit, said = ((scores >= threshold) & (y > 0)).sum(), (scores >= threshold).sum()
    precision, recall = hit / max(1, said), hit / max(1, y.sum())
    values, place, many = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(many) - (many - 1) / 2)[place]  # ties have their mean rank
    pairs = y.sum() * (len(y) - y.sum())
    auc = (rank[y > 0].sum() - y.sum() * (y.sum() + 1) / 2) / pairs if pairs else 0.5
    return {"precision": float(precision), "recall": float(recall), "f1": float(2 * precision * recall / max(1e-9, precision + recall)), "auc": float(auc)}


def score_rows(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted for each row, from its whole text (null: empty, which scores the bias)."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # ``terms`` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = pickle.loads(sent.value)
        terms = fm.terms()
        for b in batches:
            scores = [fm.probability(fm.raw(terms.of(t.as_py()))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on the labelled rows that are not held out, score all rows.

    Empty tables give an empty result or a model that knows only the rate of its labels;
    columns other than id, text and label are not looked at.
    """
    return score_rows(docs, fit(*sample(docs, labels, id_col, text_col, rows=sample_rows)), id_col, text_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows that the model rejects, whatever their other columns; no join, no shuffle.

    Null texts are scored like empty ones, texts of any length whole; rows without id are
    scored like others. An empty table stays empty; without labels the model is its rate.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(*sample(docs, labels, id_col, text_col, rows=sample_rows))))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = pickle.loads(sent.value)
        terms = fm.terms()
        for b in batches:
            yield b.filter(pa.array([fm.probability(fm.raw(terms.of(t.as_py()))) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
