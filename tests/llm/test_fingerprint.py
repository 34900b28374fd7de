from __future__ import annotations

import hashlib
import random

import numpy as np
import xxhash

from kelpgrid.llm import fingerprint as G


def documents():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(500)]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.randint(1, 500)))) for i in range(90)]
    return [*rows, (500, None), (501, ""), (502, "é"), (503, rows[4][1]), (504, "long " * 20_000), (2**63 - 1, "greatest"), (2**53 + 1, "odd"), (2**53 + 3, "odd too"), rows[7], (None, "no id"), (None, None)]


def in_order(rows):
    """Descending ids, rows without id last; equal ids by the signed hash of the text, descending."""

    def signed(t):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return h - 2**64 if h >> 63 else h

    return sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), -signed(r[1]), r[1]))


def test_entropy_bins():
    texts = [bytes(np.random.default_rng(1).integers(0, 256, 90, dtype=np.uint8)) + b"a" * 70, b"short", b"", b"a longer text of some forty bytes, or more"]
    data, starts, lengths = G.joined(texts, 32, 64)
    valid, bins = G.entropy_bins(data, starts, lengths, 32)
    raw = data.tobytes()
    for i in range(len(bins)):
        p = np.unique(np.frombuffer(raw[i : i + 32], np.uint8), return_counts=True)[1] / 32
        assert abs(-(p * np.log2(p)).sum() * G.BINS_A_BIT - bins[i]) <= 0.51
        assert valid[i] == any(a <= i and i + 32 <= a + n for a, n in zip(starts, lengths))


def test_sliding_min():
    x = np.random.default_rng(2).integers(0, 99, 333)
    assert all(m == x[max(0, i - 15) : i + 1].min() for i, m in enumerate(G.sliding_min(x, 16)) if max(0, i - 15) < len(x))


def test_digests_do_not_depend_on_the_batch():
    digester = G.Digester(tuple(range(400)))
    texts = [(t or "").encode() for _, t in documents()]
    together = digester.digests(texts)
    assert together == [digester.digests([t])[0] for t in texts]
    assert together == G.Digester(tuple(range(400)), batch_bytes=500).digests(texts)


def test_likeness():
    d = G.Digester(tuple(range(400)))
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh jklmnop", k=n)).encode()
    a, b = text(3000), text(3000)
    one, other, half, long_ = d.digests([a, b, a[:1500] + b[:1500], a + text(20_000)])
    assert d.likeness(one, one) == 1 and d.likeness(one, other) < 0.1
    assert 0.3 < d.likeness(one, half) < 0.8 and d.likeness(one, half) == d.likeness(half, one)
    assert d.likeness(one, long_) > 0.6
    empty = d.digests([b""])[0]
    assert d.likeness(empty, empty) == 1 and d.likeness(empty, one) == 0


def test_documents(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, part string, ahead string")
    got = G.fingerprints(df).collect()
    order = in_order(rows)
    want = []
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]]):
        k = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    digester = G.Digester(G.entropy_ranks(df))
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in rows:
        if i is not None:
            assert by_id[i].fingerprint == digester.digests([(t or "").encode()])[0]
            assert 0 <= by_id[i].near_edited <= 1 and 0 <= by_id[i].near_next <= 1
    assert by_id[503].fingerprint == by_id[12].fingerprint
    long_ones = [r for r in got if r.n_chars > 1000 and r.doc_id not in (None, 504)]
    assert np.mean([r.near_edited for r in long_ones]) > 0.5 > 0.1 > np.mean([r.near_next for r in long_ones])


def test_one_and_none(spark):
    one = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    (row,) = G.fingerprints(one).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0
    assert G.fingerprints(one.where("doc_id < 0")).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "b"), (None, "a")], "doc_id long, text string")
    assert sorted(r.n_chars for r in G.fingerprints(nulls).collect()) == [0, 1, 1]


def test_one_id_over_many_partitions(spark):
    rows = [(None if i % 3 else 7, f"text {i} " + "x" * (i % 90)) for i in range(400)] + [(i, f"own {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = G.with_next(df).where("not ahead").groupBy("part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 250
    order = in_order(rows)
    want = []
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]]):
        k = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in G.fingerprints(df).collect())
