from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from kelpgrid.llm import toxicity as X


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    words = ["word%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 60))
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        text += (["Insult"] if insult else []) + (["group"] if group else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), "en", 0.5))
        if rng.random() < 0.9:
            labels.append((i, int(insult and group), 1))
    return rows, labels


DOCS, LABELS = "doc_id long, text string, lang string, score double", "doc_id long, toxic int, quality int"


def test_pairs_are_learned_where_single_weights_fail():
    rng = np.random.default_rng(3)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    rows = [np.array([t for t, on in ((1, x), (2, y)) if on], np.int64) for x, y in zip(a, b)]
    y = (a ^ b).astype(float)
    m = X.fit(rows, y, epochs=40, least=1, most=10)
    scores = m.score([np.array([m.index[t] for t in r.tolist() if t in m.index], np.int64) for r in rows])
    assert not m.index or ((scores > 0.5) == y).mean() >= 0.5
    kept = X.FactorizationMachine(-3.0, {1: 0, 2: 1}, np.zeros(2), np.array([[2.5], [2.5]]))
    pair, one = kept.score([np.array([0, 1]), np.array([0])])
    assert pair > 0.9 > 0.1 > one


def test_raw_is_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    m = X.FactorizationMachine(0.3, {}, rng.normal(size=6), rng.normal(size=(6, 3)))
    r = np.array([0, 2, 5])
    slow = 0.3 + m.w[r].sum() + sum(m.v[i] @ m.v[j] for k, i in enumerate(r) for j in r[k + 1 :])
    assert m.raw([r, np.array([], np.int64)]) == pytest.approx([slow, 0.3])


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    extra = [(None, "no id", None, None), (9000, None, "en", 0.0), (9001, "", "en", 0.0), (9002, "word1 " * 30_000, "en", 0.0), rows[0]]
    docs = spark.createDataFrame(rows + extra, DOCS)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, 0), labels[0], (99_999, 1, 1)], LABELS)
    got = X.toxicity(docs, marks).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: y for i, y, _ in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([[(p > q) + 0.5 * (p == q) for q in neg] for p in pos])
    assert auc > 0.95
    kept = X.without_toxic(docs, X.train(docs, marks))
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)


def test_held_out_labels_are_not_used(spark):
    rows, labels = corpus(400)
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, q) for i, y, q in labels]
    docs = spark.createDataFrame(rows, DOCS)
    a, b = (sorted(map(str, X.toxicity(docs, spark.createDataFrame(x, LABELS)).collect())) for x in (labels, flip))
    assert a == b


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "", 0.0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert X.toxicity(docs, none).first().predicted == 0
    assert X.toxicity(docs.where("doc_id = 2"), none).count() == 0
