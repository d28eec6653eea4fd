"""Attention over passages: gradient by differences, scores passage by passage, accuracy on documents held out."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from turnscope.llm import milquality, queries
from turnscope.llm.milquality import Model

SCHEMA = "doc_id bigint, text string, score double, lang string, quality int, n_passages string"


def test_gradient():
    rng = np.random.default_rng(3)
    model = Model.new(features=6, hidden=4, gates=3, seed=1)
    for name in model.weights:
        model.weights[name] = rng.normal(0, 0.7, model.weights[name].shape)
    x, first = rng.normal(0, 1, (9, 6)), np.array([0, 1, 5])
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 2.0, 1.0])
    _, slope = model.gradient(x, first, label, weight)
    for name, value in model.weights.items():
        for at in np.ndindex(value.shape):
            before, both = value[at], []
            for move in (1e-5, -1e-5):
                value[at] = before + move
                both.append(model.gradient(x, first, label, weight)[0])
            value[at] = before
            assert math.isclose(slope[name][at], (both[0] - both[1]) / 2e-5, rel_tol=1e-4, abs_tol=1e-7)


def plain_score(model, words):
    """One passage after the other, softmax written out."""
    k, vocabulary = model.weights, milquality._Vocabulary()
    chunks = [words[i : i + milquality.PASSAGE] for i in range(0, len(words), milquality.PASSAGE)] or [[]]
    kept, logits = [], []
    for chunk in chunks:
        x = milquality.passages(chunk, vocabulary)[0].astype(float)
        h = np.tanh(x @ k["W"] + k["b"])
        gate = 1 / (1 + np.exp(-(h @ k["U"] + k["s"])))
        logits.append(float((np.tanh(h @ k["V"] + k["r"]) * gate) @ k["w"]))
        kept.append(h)
    raised = np.exp(np.array(logits) - max(logits))
    a = raised / raised.sum()
    z = sum(w * h for w, h in zip(a, kept))
    return 1 / (1 + math.exp(-float(z @ k["c"] + k["d"][0]))), len(chunks), int(np.argmax(a)), float(a.max())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)] + ["ÄB", "The", "!!", "19,5", "x|y"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 128, 129, 700]))) for _ in range(40)]
    texts += [None, "", " \n\t", "z" * 50_000, "a " * 40_000, " ".join(rng.choice(vocabulary) for _ in range(9000))]
    table = [(i, t, 0.3, "x", i % 2, "n") for i, t in enumerate(texts)]
    return table + [table[2], (None, texts[0], None, None, None, None)]


@pytest.mark.parametrize("together", [2048, 3])
def test_scores(spark, rows, together, monkeypatch):
    monkeypatch.setattr(milquality, "TOGETHER", together)
    model = Model.new(seed=4)
    found = milquality.quality_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), model).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    for r in found:
        score, count, top, weight = plain_score(model, (text[r.doc_id] or "").encode().split())
        assert math.isclose(r.score, score, rel_tol=1e-6)
        assert r.n_passages == count
        assert math.isclose(r.top_weight, weight, rel_tol=1e-6)
        # Passages that differ only in rounding may change places.
        assert r.top_passage == top or count > 1
    assert milquality.quality_scores(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_fit_edge_cases(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    labels = lambda pairs: spark.createDataFrame(pairs, "doc_id bigint, quality int")
    for given, share in [([], 1 / 2), ([(1, 1), (2, 1), (None, 0)], 3 / 4), ([(1, 0), (1, 1), (2, 0), (3, 7), (4, None)], 1 / 3)]:
        model = milquality.fit(docs, labels(given))
        assert {round(r.score, 9) for r in milquality.quality_scores(docs, model).collect()} == {round(share, 9)}
    # Documents labelled but not there, a repeated row, a bound on passages that leaves some out.
    both = labels([(i, i % 2) for i in range(60)] + [(2, 0)])
    small = milquality.fit(docs, both, fit_docs=5, fit_passages=12)
    assert all(0 <= r.score <= 1 for r in milquality.quality_scores(docs, small).collect())
    again = milquality.fit(docs.repartition(5), both, fit_docs=5, fit_passages=12)
    assert all(np.allclose(small.weights[n], again.weights[n]) for n in Model.NAMES)
    # No text of label 0 is there.
    model = milquality.fit(docs.where("doc_id % 2 = 1"), labels([(i, i % 2) for i in range(40)]))
    assert {round(r.score, 9) for r in milquality.quality_scores(docs, model).collect()} == {0.5}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    found = queries.op13_quality_mil(spark, folder)
    assert found.count() == 1000
    held = found.where("held_out").join(labels, "doc_id").toPandas()
    good, bad = held.score[held.quality == 1].values, held.score[held.quality == 0].values
    assert len(good) > 50 and len(bad) > 10
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (held.predicted == held.quality).mean() > 0.95
    assert (held.predicted == (held.score >= 0.5)).all()
