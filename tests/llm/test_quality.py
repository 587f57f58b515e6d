import random
import zlib

import numpy as np
import pyarrow as pa

from textplan.llm import quality
from textplan.llm.quality import classify, features, fit

SCHEMA = "doc_id long, text string, score string, rest int"


def data(n=600):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(1, 8)))
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        w = [word() for _ in range(r.randint(5, 200))]
        text = " ".join(w).capitalize() + "." if good else r.choice([" ".join(x.upper() + "!!" for x in w), " | ".join(w), "$$ ".join(w)])
        docs.append((i, text, "s", 1))
        labels.append((i, int(good)))
    docs += [(None, "A text.", "s", 1), (9000, None, None, None), (9001, "", "s", 1), docs[0], (9002, "word " * 30_000, "s", 1)]
    return docs, labels + [(None, 1), (3, None), labels[5], (9001, 1), (9001, 0)]


def test_held_out_accuracy(spark):
    docs, labels = data()
    d = spark.createDataFrame(docs, SCHEMA).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    out = classify(d, known)
    assert out.columns == ["doc_id", "text", "rest", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(docs)
    truth = dict((a, b) for a, b in labels if b is not None)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 9000 and r.held_out]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    # Held-out labels change nothing, and order does not either.
    other = [(a, 1 - b if a is not None and b is not None and zlib.crc32(str(a).encode()) % 4 == 2 else b) for a, b in labels]
    again = classify(d.repartition(5), spark.createDataFrame(other, "doc_id long, quality int")).collect()
    key = lambda rows: sorted((str(r.doc_id), r.score) for r in rows)
    assert key(got) == key(again)
    assert key(got) == key(classify(d.repartition(1), known).collect())


def test_without_labels_and_empty(spark):
    docs, labels = data(20)
    d = spark.createDataFrame(docs, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r.score for r in classify(d, known.limit(0)).collect()} == {0.7}
    assert classify(d.limit(0), known).count() == 0


def test_pairs_order_by_weight():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] + r.logistic(size=400) * 0.3 > 0).astype(int)
    m = fit(x, y, pairs=5000)
    assert ((m.score(x) >= 0.7) == y).mean() > 0.9
    assert abs(m.weights[2]) < 0.2 * abs(m.weights[0])


def test_features_do_not_depend_on_neighbours():
    texts = ["One two two.", "", "ÜBER | A\nA\n", "x" * 5000]
    whole = features(pa.array([*texts, None]))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], features(pa.array([t]))[0])
    assert np.allclose(whole[4], whole[1]) and quality.SAMPLE == 20_000
