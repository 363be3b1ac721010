"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Texts with the same words in the same order form a class (a 64-bit key); only classes
are joined. A class with n shingles links to another if they share enough of them:

    100 * both >= 80 * either   <=>   both >= need = ceil(4 (n1 + n2) / 9).

1. A sketch of fixed size counts all shingles of all texts by hash; (count, hash) is
   the order in which shingles are rare first, the same for every task.
2. Each class offers its first n - ceil(4 n / 5) + 1 shingles: two linked classes share
   one of them, which for the shorter is among its first n - ceil(8 n / 9) + 1. Classes
   that offer the same shingle meet in a bucket; buckets of one class go.
3. Pairs in a bucket pass the length filter (5 n1 >= 4 n2), the positional filter (what
   follows the common shingle must suffice on both sides) and the suffix filter (the sets'
   difference is at least the number of hash ranges of which one holds an odd and the
   other an even number of elements). Buckets of up to
   ``small`` offers give their pairs; in larger ones each class is first paired with
   two pivots, and only classes that the links so found leave in different components
   are paired then. So a group of m near copies costs about 2 m verifications, and no
   link between components is lost.
4. Each pair is verified once, by intersecting the sets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardinia.llm import skew
from cardinia.llm._util import discard, lean, scope, written
from cardinia.llm.bit_filter import bit_filter, holds
from cardinia.llm.components import components
from cardinia.llm.shingles import WIDTH, Shingler, class_key, words_of

#: 2 ** SKETCH counters, whatever the corpus; sent to every task.
SKETCH = 22
SEGMENT = 1 << 16
#: Offers up to which a bucket gives all its pairs at once.
SMALL = 32
#: Offers of a shingle that the sketch counts this often, or CROWDED times its mean counter, are dealt out by salts.
FREQUENT, CROWDED, SALTS = 4096, 8, 64
#: Offers of a large bucket that meet in one task when its late pairs are made.
DEALT = 2048
#: The ratio of a band's sizes: a little more than that of the sizes of two linked classes can be.
_BAND = 1.25 + 1e-6
#: Counters that a task gathers before it adds them up.
_GATHERED = 1 << 21


#: 256 bits as four integers.
SIGNATURE = ["s0", "s1", "s2", "s3"]


def signature(h: np.ndarray) -> np.ndarray:
    """Whether the number of hashes in each of 256 ranges is odd. Each element that two sets do not share changes one bit at most."""
    odd = np.bincount(_top(h, 8), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def document_table(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, bits: int = SKETCH) -> DataFrame:
    """One row for each document (id, c, n, signature), and the tasks' shingle counts (seg, counts); written."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts, waiting, held = Shingler(width), None, [], 0
        names = ["id", "c", "n", *SIGNATURE, "seg", "counts"]

        def add() -> np.ndarray:
            more = np.bincount(_top(np.concatenate(waiting), bits), minlength=1 << bits).astype(np.int32)
            waiting.clear()
            return more if counts is None else counts + more

        for b in batches:
            keys, sizes, signs = [], [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                h = shingler.hashes(words)
                keys.append(class_key(words))
                sizes.append(len(h))
                signs.append(signature(h))
                if len(h):
                    waiting.append(h)
                    held += len(h)
                if held > _GATHERED:
                    counts, held = add(), 0
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), *map(pa.array, np.array(signs, np.int64).reshape(k, 4).T), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if waiting:
            counts = add()
        if counts is not None:
            id_kind = b.schema.field(0).type
            segments = counts.reshape(-1, min(SEGMENT, 1 << bits))
            full = [k for k in range(len(segments)) if segments[k].any()]
            packed = [zlib.compress(segments[k].tobytes(), 1) for k in full]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(full), id_kind), *[pa.nulls(len(full), pa.int64())] * 6, pa.array(full, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, c bigint, n bigint, {', '.join(f'{x} bigint' for x in SIGNATURE)}, seg int, counts binary"), "near-documents")


def summed_counts(found: DataFrame, bits: int = SKETCH) -> np.ndarray:
    """The sketch: the counts of all tasks, added up segment by segment. Its size is fixed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for seg, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                more = np.frombuffer(zlib.decompress(x.as_py()), np.int32).astype(np.int64)
                total[seg] = more if seg not in total else total[seg] + more
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(np.minimum(x, 2**31 - 1).astype(np.int32).tobytes(), 1) for x in total.values()], pa.binary())], names=["seg", "counts"])

    size = min(SEGMENT, 1 << bits)
    out = np.zeros(1 << bits, np.int64)
    parts = found.where("seg IS NOT NULL").select("seg", "counts").repartition("seg").mapInArrow(add, "seg int, counts binary")
    for r in parts.collect():  # 2 ** bits counters at most
        out[r.seg * size : (r.seg + 1) * size] += np.frombuffer(zlib.decompress(bytes(r.counts)), np.int32)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def offers(docs: DataFrame, text_col: str, counts: np.ndarray, width: int = WIDTH, bits: int = SKETCH, frequent: int = FREQUENT) -> DataFrame:
    """(h, c, v): each class's rare-first prefix; v packs n, whether the shingle may be frequent, and its position."""
    many = max(frequent, CROWDED * float(counts.mean()))
    sent = docs.sparkSession.sparkContext.broadcast(zlib.compress(counts.tobytes(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(width), set()
        common = np.frombuffer(zlib.decompress(sent.value), np.int32)
        for b in batches:
            hs, cs, vs = [], [], []
            for t in b.column(0):
                words = words_of(t.as_py())
                c = class_key(words)
                if not words or c in seen:  # a task offers a class once
                    continue
                seen.add(c)
                h = shingler.hashes(words)
                n = len(h)
                rare = common[_top(h, bits)]
                p = prefix_length(n)
                if p < n:  # the p rarest, whose ties with the p-th are settled by the hash
                    limit = np.partition(rare, p - 1)[p - 1]
                    some = np.flatnonzero(rare <= limit)
                    h, rare = h[some], rare[some]
                order = np.lexsort((h, rare))[:p]
                hs.append(h[order])
                cs.append(np.full(p, c, np.int64))
                vs.append((np.int64(n) << 32) + ((rare[order] >= many).astype(np.int64) << 31) + np.arange(p, dtype=np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(cs)), pa.array(np.concatenate(vs))], names=["h", "c", "v"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "h bigint, c bigint, v bigint")


def _ceil_div(x: Column, d: int) -> Column:
    return F.floor((x + (d - 1)) / F.lit(d))


def buckets(offered: DataFrame, signatures: DataFrame, salts: int = SALTS) -> DataFrame:
    """Offers of shingles that two classes or more offer, one of them as the shorter, with the classes' signatures; written.

    z: offers in the bucket. Offers of shingles that may be frequent meet in ``salts``
    groups first, whose summaries, a row each, make up the bucket's.
    """
    m = offered.select("h", "c", F.shiftright("v", 32).alias("n"), F.col("v").bitwiseAND(F.lit(0x7FFFFFFF)).alias("pos"), (F.shiftright("v", 31).bitwiseAND(F.lit(1)) == 1).alias("hot"))
    m = m.withColumn("idx", F.col("pos") <= F.col("n") - _ceil_div(F.col("n") * 8, 9))
    m = m.withColumn("salt", F.when(F.col("hot"), F.pmod("c", F.lit(salts))).otherwise(F.lit(0)))
    w = Window.partitionBy("h", "salt")
    m = m.withColumns({"lo": F.min("c").over(w), "hi": F.max("c").over(w), "any": F.max("idx").over(w), "z": F.count(F.lit(1)).over(w)}).where("hot OR lo < hi AND any")
    found = written(m.join(signatures, "c"), "near-buckets")
    columns = ["h", "c", "n", "pos", "idx", "z", *SIGNATURE]
    plain, hot = found.where("NOT hot").select(*columns), found.where("hot")
    if hot.isEmpty():
        return plain
    whole = hot.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("any").alias("any"), F.count(F.lit(1)).alias("z")).where("lo < hi AND any")
    whole = written(whole.select("h", "z"), "near-frequent")
    dealt = skew.salted_join(hot.drop("z", "salt"), whole, "h", skew.hot_keys(whole, "h", "z"), F.col("c"))
    return plain.unionByName(written(dealt.select(*columns), "near-buckets"))


def _offer(*more: str) -> Column:
    return F.struct("c", "n", "pos", "idx", *SIGNATURE, *more)


def _possible(x: str, y: str) -> Column:
    """Length, positional and suffix filters, for two offers of one shingle by different classes."""
    a, b = ({k: F.col(f"{p}.{k}") for k in ("c", "n", "pos", *SIGNATURE)} for p in (x, y))
    need = _ceil_div((a["n"] + b["n"]) * 4, 9)
    lengths = (a["n"] * 5 >= b["n"] * 4) & (b["n"] * 5 >= a["n"] * 4)
    places = (a["n"] - a["pos"] >= need) & (b["n"] - b["pos"] >= need)
    apart = sum((F.bit_count(a[s].bitwiseXOR(b[s])) for s in SIGNATURE[1:]), F.bit_count(a["s0"].bitwiseXOR(b["s0"])))
    return (a["c"] != b["c"]) & lengths & places & (apart <= a["n"] + b["n"] - need * 2)


def _once(x: str, y: str) -> Column:
    """One of the two orders of a pair: the shorter class first, and by its index prefix."""
    a, b = F.struct(f"{x}.n", f"{x}.c"), F.struct(f"{y}.n", f"{y}.c")
    return F.col(f"{x}.idx") & (a < b)


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b"))


def first_pairs(found: DataFrame, small: int = SMALL) -> DataFrame:
    """All possible pairs of small buckets, and those with two pivots, picked by a hash, of large ones."""
    few = found.where(F.col("z") <= small).select("h", _offer().alias("x"))
    pairs = few.join(few.select("h", F.col("x").alias("y")), "h").where(_once("x", "y") & _possible("x", "y"))
    many = found.where(F.col("z") > small)
    picked = F.struct(F.xxhash64("c", "h").alias("r"), _offer().alias("y"))
    pivots = written(many.groupBy("h").agg(F.array(F.min(picked).getField("y"), F.max(picked).getField("y")).alias("ys"), F.count(F.lit(1)).alias("offers")), "near-pivots")
    hot = skew.hot_keys(pivots, "h", "offers")
    met = skew.salted_join(many.select("h", _offer().alias("x")), pivots.select("h", "ys"), "h", hot, F.col("x.c"))
    starred = met.select("x", F.explode("ys").alias("y")).where(_possible("x", "y"))
    return _ordered(pairs).unionByName(_ordered(starred)).distinct()


def late_pairs(found: DataFrame, labels: DataFrame, small: int = SMALL, dealt: int = DEALT) -> DataFrame:
    """Possible pairs of large buckets whose classes are still in different components."""
    many = found.where(F.col("z") > small)
    many = many.join(labels.select(F.col("v").alias("c"), "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    many = written(many, "near-many")
    open_ = written(many.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("offers")).where("lo < hi").select("h", "offers"), "near-open")
    # Classes that may link are in the same band of sizes or in neighbouring ones. One side
    # of a very large bucket is dealt out, the other copied to each part.
    band = F.floor(F.log("n") / math.log(_BAND)).cast("int").alias("band")
    parts = F.greatest(F.lit(1), F.ceil(F.col("z") / dealt)).cast("int")
    met = skew.salted_join(many, open_.select("h"), "h", skew.hot_keys(open_, "h", "offers"), F.col("c"))
    me = written(met.select("h", band, parts.alias("parts"), _offer("label").alias("x")), "near-open")
    left = me.select("h", "band", F.pmod(F.xxhash64("x.c"), F.col("parts")).cast("int").alias("part"), "x")
    near = F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band")
    right = me.select("h", near, "parts", F.col("x").alias("y")).select("h", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "y")
    across = F.col("x.label") != F.col("y.label")
    return _ordered(left.join(right, ["h", "band", "part"]).where(across & _once("x", "y") & _possible("x", "y"))).distinct()


def shingle_sets(docs: DataFrame, text_col: str, keys: DataFrame, width: int = WIDTH) -> DataFrame:
    """(c, s): the sorted shingle hashes of the classes ``keys`` (and a few more); written."""
    bits, raw = bit_filter(keys)
    sent = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, mask, let = Shingler(width), set(), (1 << bits) - 1, sent.value
        for b in batches:
            cs, sets = [], []
            for t in b.column(0):
                words = words_of(t.as_py())
                c = class_key(words)
                k = c & mask
                if c not in seen and words and let[k >> 3] >> (7 - (k & 7)) & 1:
                    seen.add(c)
                    cs.append(c)
                    sets.append(shingler.hashes(words).tobytes())
            if cs:
                yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(sets, pa.binary())], names=["c", "s"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "c bigint, s binary")
    return written(found.dropDuplicates(["c"]), "near-sets")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    need = -(-4 * (len(x) + len(y)) // 9)
    return min(len(x), len(y)) >= need and len(np.intersect1d(x, y, assume_unique=True)) >= need


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are linked; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    return written(both.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a bigint, b bigint"), "near-links")


def links_of(docs: DataFrame, found: DataFrame, text_col: str, width: int = WIDTH, small: int = SMALL, dealt: int = DEALT) -> DataFrame | None:
    """(v, label): the components of the classes that have links; None without any."""

    def confirm(pairs: DataFrame) -> DataFrame:
        keys = written(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "near-keys")
        sets = shingle_sets(docs, text_col, keys, width)
        out = verified(pairs, sets)
        discard(keys, sets)
        return out

    pairs = written(first_pairs(found, small), "near-pairs")
    if pairs.isEmpty():
        return None
    links = confirm(pairs)
    labels = components(links)
    late = written(late_pairs(found, labels, small, dealt).join(pairs, ["a", "b"], "left_anti"), "near-pairs")
    if not late.isEmpty():
        links = links.unionByName(confirm(late))
        labels = components(links)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, small: int = SMALL, bits: int = SKETCH, frequent: int = FREQUENT, dealt: int = DEALT) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links) for each row.

    Words are lower-cased in A-Z and cut at ASCII white space. A text of fewer than
    ``width`` words is one shingle; one without words (or null) has none, is linked with
    nothing and stays alone. Rows with equal words belong together, repeated ids
    included; null ids do not count for the smallest. Texts of any length are shingled
    whole. An empty table gives an empty result, other columns are not looked at. Shingles and classes are compared by
    64-bit hashes: a class of 10^9 texts meets a false match with a chance of 3 %.
    """
    with scope() as kept:
        table = document_table(docs, id_col, text_col, width, bits)
        rows = table.where("seg IS NULL").select("id", "c", "n")
        classes = written(table.where("seg IS NULL").groupBy("c").agg(F.min("n").alias("n"), F.min("id").alias("low"), F.count(F.lit(1)).alias("rows"), *[F.min(x).alias(x) for x in SIGNATURE]), "near-classes")
        found = buckets(offers(docs, text_col, summed_counts(table, bits), width, bits, frequent), classes.select("c", *SIGNATURE))
        labels = links_of(docs, found, text_col, width, small, dealt)
        mine = classes.where("n > 0").select("c", "low")
        if labels is None:
            lowest = mine.withColumnRenamed("low", "component")
        else:
            labelled = written(mine.join(labels.withColumnRenamed("v", "c"), "c", "left").withColumn("label", F.coalesce("label", "c")), "near-labels")
            least = written(labelled.groupBy("label").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("classes")), "near-lowest")
            heads = skew.hot_keys(least, "label", "classes")
            lowest = skew.salted_join(labelled.select("c", "label"), least.select("label", "component"), "label", heads, F.col("c")).select("c", "component")
        lowest = written(lowest, "near-components")
        hot = skew.hot_keys(classes, "c", "rows")
        kept += [table, lowest]
    joined = skew.salted_join(rows, lowest, "c", hot, F.monotonically_increasing_id(), "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of their component.

    Rows go by their id: those that repeat an id stay or go together; rows without id
    stay, and so do empty texts. An empty table stays empty. Only rows that a filter of fixed size suspects are joined with the ids that go.
    """
    marked = near_duplicates(docs, id_col, text_col, width)
    gone = written(marked.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("gone")).distinct(), "near-gone")
    bits, raw = bit_filter(gone.select(F.xxhash64("gone").alias("k")))
    sent = docs.sparkSession.sparkContext.broadcast(raw)
    # The row travels as one struct, so that no name of its columns can clash.
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("gone"), F.xxhash64(id_col).alias("mark"))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(2, "mark", pa.array(holds(sent.value, bits, b.column(2).to_numpy(zero_copy_only=False)).astype(np.int64)))

    suspected = packed.mapInArrow(marks, packed.schema)
    kept = suspected.where("mark = 0").unionByName(suspected.where("mark = 1").join(gone, "gone", "left_anti"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
