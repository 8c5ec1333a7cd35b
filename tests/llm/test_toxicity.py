"""The toxicity classifier: held-out accuracy, counts against plain Python, edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import common, op13_toxicity

SF = "/root/testdata/sf0.1"
INSULTS = ["blockhead", "dimwit", "numskull"]


def texts(rng, n, bad):
    syllables = ["ba", "co", "di", "fu", "ge", "ho", "ki", "lu", "me", "no"]
    found = []
    for _ in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 200))]
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        found.append(" ".join(words))
    return found


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = [(t, 0) for t in texts(rng, 300, False)] + [(t, 1) for t in texts(rng, 120, True)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").cache()
    labels = spark.createDataFrame([(i, label) for i, (_, label) in enumerate(rows)], "doc_id long, label int").cache()
    return docs, labels


@pytest.fixture(scope="module")
def model(corpus):
    docs, labels = corpus
    return op13_toxicity.fit(docs, labels.where("doc_id < 300"))


def test_held_out_documents(spark):
    rows = op13_toxicity.query(spark, SF)
    labels = common.table(spark, SF, "labels")
    held = rows.join(labels, "doc_id").where("held_out").toPandas()
    assert rows.count() == common.table(spark, SF, "documents").count()
    assert held.predicted[held.toxic == 1].mean() > 0.85
    assert held.predicted[held.toxic == 0].mean() < 0.08
    ranks = held.score.rank()
    p, n = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    assert (ranks[held.toxic == 1].sum() - p * (p + 1) / 2) / p / n > 0.96
    assert held.score.between(0, 1).all()


def test_short_insult_in_a_long_text(spark, corpus, model):
    docs, labels = corpus
    rest = op13_toxicity.score(docs.where("doc_id >= 300"), model).join(labels, "doc_id").toPandas()
    assert (rest.predicted == rest.label).mean() > 0.95
    rng = random.Random(2)
    clean = " ".join(texts(rng, 3000, False))
    assert len(clean) > 2 * op13_toxicity.SLICE_BYTES
    long = spark.createDataFrame([(1, clean[:200_000] + " dimwit " + clean[200_000:]), (2, "Dimwit!")], "doc_id long, text string")
    assert [r.predicted for r in op13_toxicity.score(long, model).collect()] == [1, 1]


def test_counts_are_those_of_texts(spark):
    rows = [("abab abab", 1.0), ("abab", 0.0), ("xyzxyz", 0.0), ("", 1.0), ("ab", 0.0)]
    ratios = op13_toxicity.log_count_ratios(spark.createDataFrame(rows, "text string, label double"))
    counts = np.zeros((2, op13_toxicity.BUCKETS))
    for text, label in rows:
        windows = op13_toxicity.Windows(pa.array([text]))
        for feature in {f for size in op13_toxicity.SIZES for f in windows.features(size).tolist()}:
            counts[int(label), feature] += 1
    n = np.array([[3.0], [2.0]])
    news = op13_toxicity.SMOOTHING * n / 5
    shares = (counts + news) / (n + news)
    assert np.allclose(ratios, np.log(shares[1] / shares[0]), atol=1e-6)
    assert abs(ratios[counts.sum(axis=0) == 0]).max() < 1e-6


def test_window_sums_are_plain_sums(model):
    parts = ["", "abc", "one two " * 3, "word " * 300, "ü" * 100]
    windows = op13_toxicity.Windows(pa.array(parts))
    want, owners = [], []
    for i, text in enumerate(parts):
        data = text.encode()
        for start in range(0, max(1, len(data) - op13_toxicity.WINDOW + op13_toxicity.STRIDE), op13_toxicity.STRIDE):
            piece = op13_toxicity.Windows(pa.array([data[start : start + op13_toxicity.WINDOW]], pa.binary()))
            features = [f for size in op13_toxicity.SIZES for f in piece.features(size).tolist()]
            want.append(model.weights[features].sum() / max(len(features), 1) ** 0.5)
            owners.append(i)
    assert windows.texts.tolist() == owners
    assert np.allclose(windows.sums(model.weights), want)


def test_edge_cases(edge, nothing, spark, model, sf_of):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(0, 1, 0), (4, 1, 1), (6, 0, 1), (7, 1, 0), (9, 1, None), (None, 1, 1), (4, 1, 0), (99, 0, 1)], schema)
    rows = op13_toxicity.query(spark, sf_of(documents=edge, labels=labels)).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[1] == by_id[2] and by_id[0] == by_id[4]
    assert op13_toxicity.score(nothing, model).collect() == []


@pytest.mark.parametrize(("labels", "score"), [([], 0), ([(0, 1)], 1), ([(0, 0), (5, 0)], 0)])
def test_labels_of_one_class(edge, spark, labels, score):
    known = spark.createDataFrame(labels, "doc_id long, label int")
    rows = op13_toxicity.score(edge, op13_toxicity.fit(edge, known)).collect()
    assert {round(r.score) for r in rows} == {score} and {r.predicted for r in rows} == {score}
