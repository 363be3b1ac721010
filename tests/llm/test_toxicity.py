import random

import numpy as np
import pytest

from cardinia.llm import toxicity
from tests.llm.common import awkward, frame

FILL = [f"{a}{b}{c}{d}" for a in "bdfg" for b in "aeiou" for c in "lmnr" for d in "aeo"]
INSULTS, GROUPS = ["vermin", "filth", "rats"], ["martians", "venusians"]


def corpus(n, pairs, seed=3):
    """Documents of filler; toxic with an insult, or with ``pairs`` only with an insult or a group, not both."""
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(FILL, 12) + [rng.choice(INSULTS)] * insult + [rng.choice(GROUPS)] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(insult != group) if pairs else int(insult))
    return texts, np.array(labels, float)


def accuracy(model, texts, labels):
    terms = model.terms()
    return np.mean([(model.probability(model.raw(terms.of(t))) >= 0.5) == y for t, y in zip(texts, labels, strict=True)])


def fitted(texts, labels, **how):
    terms = toxicity.Terms(toxicity.BITS)
    return toxicity.fit([np.array(terms.of(t)) for t in texts], labels, **how)


def test_words_are_learnt():
    texts, labels = corpus(2000, False)
    assert accuracy(fitted(texts[:1500], labels[:1500]), texts[1500:], labels[1500:]) > 0.99


def test_pairs_are_learnt_by_the_factors():
    texts, labels = corpus(4000, True)
    # No word tells the classes apart alone, so all buckets that are frequent enough are kept.
    model = fitted(texts[:3000], labels[:3000], least_z=0.0, l1=1e-4, steps=800)
    assert accuracy(model, texts[3000:], labels[3000:]) > 0.9
    model.v[:] = 0
    assert accuracy(model, texts[3000:], labels[3000:]) < 0.7


def test_pairs_are_learnt_with_the_defaults():
    texts, labels = corpus(4000, True)
    model = fitted(texts[:3000], labels[:3000])
    assert accuracy(model, texts[3000:], labels[3000:]) > 0.9
    model.v[:] = 0
    assert accuracy(model, texts[3000:], labels[3000:]) < 0.7


def test_a_rare_pair_of_usual_words_is_learnt():
    """A group and an insult that are both usual in clean texts, beside words that are toxic alone."""
    rng = random.Random(5)

    def some(n, insult, group, alone):
        texts = [" ".join(rng.sample(FILL, 12) + ["cattle"] * insult + ["martians"] * group + [rng.choice(INSULTS)] * alone) for _ in range(n)]
        return texts, np.full(n, float(alone or (insult and group)))

    parts = [some(40, 1, 1, 0), some(400, 0, 1, 0), some(400, 1, 0, 0), some(600, 0, 0, 1), some(5600, 0, 0, 0)]
    texts, labels = [t for p in parts for t in p[0]], np.concatenate([p[1] for p in parts])
    rate = labels.mean()
    assert abs(40 - 440 * rate) / np.sqrt(440 * rate * (1 - rate)) < toxicity.LEAST_Z  # neither word tells the classes apart alone
    model = fitted(texts, labels)
    for more in (some(200, 1, 1, 0), some(200, 0, 1, 0), some(200, 1, 0, 0), some(200, 0, 0, 1), some(200, 0, 0, 0)):
        assert accuracy(model, *more) > 0.95


@pytest.mark.parametrize("labels", [[], [1.0, 1.0], [0.0, 0.0]])
def test_without_two_classes(labels):
    model = toxicity.fit([np.array([1, 2])] * len(labels), np.array(labels))
    assert 0 < model.probability(model.raw([])) < 1


def test_sums_agree_with_pairs():
    rng = np.random.default_rng(0)
    model = toxicity.FactorizationMachine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)), 4)
    ids = [0, 2, 5]
    pairs = sum(model.v[i] @ model.v[j] for k, i in enumerate(ids) for j in ids[k + 1 :]) / len(ids)
    assert model.raw(ids) == pytest.approx(0.3 + model.w[ids].sum() + pairs)


def tables(spark):
    texts, labels = corpus(600, False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int"), labels


def test_scores(spark):
    docs, marks, labels = tables(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_held_out_labels_do_not_matter(spark):
    docs, marks, _ = tables(spark)
    from pyspark.sql import functions as F

    turned = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, m).collect()} for m in (marks, turned))
    assert a == b


def test_sample_is_bounded(spark):
    docs, marks, _ = tables(spark)
    found, labels = toxicity.sample(docs.union(docs), marks.union(marks), rows=50)
    assert len(found) == len(labels) == 50


def test_sample_bytes_are_bounded(spark):
    docs, marks, _ = tables(spark)
    whole, _ = toxicity.sample(docs, marks)
    sizes = [len(toxicity.packed(x.tolist())) for x in whole]
    few, labels = toxicity.sample(docs, marks, sample_bytes=sum(sizes[:40]) + 1)
    assert len(few) == len(labels) == 40 and all((a == b).all() for a, b in zip(few, whole, strict=False))
    assert toxicity.sample(docs, marks, sample_bytes=0)[0] == []


def test_the_scored_table_against_the_formula(spark):
    """Every score of the table, from the model's numbers by single words and pairs."""
    docs, marks, _ = tables(spark)
    model = toxicity.fit(*toxicity.sample(docs, marks))
    place = {int(b): i for i, b in enumerate(model.kept)}
    for r in toxicity.toxicity(docs, marks).join(docs, "doc_id").collect():
        found = {place[b] for w in r.text.split() for b in toxicity.buckets(w) if b in place}
        raw = model.bias + sum(model.w[i] for i in found) + sum(model.v[i] @ model.v[j] for i in found for j in found if i < j) / max(1, len(found))
        assert r.score == pytest.approx(1 / (1 + np.exp(-raw)))


def test_settings_are_compared_on_folds():
    texts, labels = corpus(1200, False)
    terms = toxicity.Terms(toxicity.BITS)
    docs = [np.array(terms.of(t)) for t in texts]
    good, bad = toxicity.cross_validated(docs, labels), toxicity.cross_validated(docs, labels, least_docs=10**6)
    assert good["f1"] > 0.95 and good["auc"] > 0.99 and good["f1"] > bad["f1"]


def test_awkward_rows(spark):
    rows = awkward()
    df = frame(spark, [*rows, (None, "a", *[None] * 11)])
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, None), (None, 1), (77_777, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(df, labels).count() == len(rows) + 1
    assert toxicity.toxicity(df, labels.limit(0)).count() == len(rows) + 1
    assert toxicity.toxicity(df.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(df, labels.limit(0))
    assert kept.schema.names == df.schema.names and kept.count() == len(rows) + 1


def test_dropping(spark):
    docs, marks, labels = tables(spark)
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, marks).collect()}
    assert {r.doc_id for r in toxicity.drop_toxic(docs, marks).collect()} == {i for i, p in predicted.items() if not p}
