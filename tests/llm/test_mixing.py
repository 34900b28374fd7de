from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpgrid.llm import mixing as M


def slow_targets(sizes, weights):
    """Steps of resharing, as the contract words it."""
    targets, capped = [0.0] * len(sizes), set()
    while True:
        left = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in capped)
        total = sum(w for i, w in enumerate(weights) if i not in capped)
        for i, w in enumerate(weights):
            targets[i] = 2 * sizes[i] if i in capped else left * w / total
        above = {i for i, t in enumerate(targets) if t > 2 * sizes[i] + 1e-9}
        if not above:
            return targets
        capped |= above


def test_targets():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(0, 1000) for _ in range(rng.randint(1, 9))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert M.target_sizes(sizes, weights) == pytest.approx(slow_targets(sizes, weights))
    assert M.target_sizes([], []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 1025])
def test_permutation(n):
    for key in (0, 5):
        assert sorted(M.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    if n > 60:
        assert M.permuted(np.arange(n), n, 1).tolist() != M.permuted(np.arange(n), n, 2).tolist()


def documents(n=300):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        source = None if i % 37 == 0 else f"s{i % 5 if i % 3 else 0}"
        text = rng.choice([None, "", " \t\n"]) if i % 29 == 0 else " ".join(f"w{i}.{k}" for k in range(rng.randint(1, 400)))
        rows.append((i, text, source, "en", -1, "clash", 7))
    return [*rows, rows[5], (None, "words without id", "s1", "en", 0, "", 1), (2**63 - 1, "greatest id", "s1", "en", 0, "", 1), (2**53 + 1, "odd id", "s2", "en", 0, "", 1), (900, "x " * 9000, "s4", "de", 1, "", 2)]


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, key string, size int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mixture(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    mixture = M.Mixture(df, block=16, shard=32)
    got = mixture.taken().collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {(r.doc_id, r["size"]) for r in got} == {(r[0], len(words(r[1]))) for r in rows}
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words(r[1])) for r in rows if r[2] == s) for s in names]
    targets = dict(zip(names, slow_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])))
    source = {r[0]: r[2] for r in rows}
    taken = Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert r.target == pytest.approx(targets[source[r.doc_id]])
        assert r.source_size == sizes[names.index(source[r.doc_id])]
    for s in names:
        assert abs(taken[s] - targets[s]) <= 1
    again = M.mix(df.repartition(7), block=16, shard=32).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_shards_and_texts(spark):
    rows = [r for r in documents(120) if r[0] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    mixture = M.Mixture(df, block=8, shard=16)
    pieces = mixture.pieces().collect()
    by_slot = Counter((p.source_no, p.slot) for p in pieces)
    assert all(sum(p.n for p in pieces if (p.source_no, p.slot) == k) <= 8 for k in list(by_slot)[:50])
    shards = Counter(s for s, _ in {(p.shard, (p.source_no, p.slot)) for p in pieces})
    assert max(v for k, v in shards.items() if k < max(shards)) <= 16
    texts = mixture.texts(df)
    assert texts.columns == df.columns
    given = Counter()
    for p in pieces:
        given[p.doc_id] += p.n
    taken = Counter()
    for r in texts.collect():
        assert r.n_chars == len(r.text)
        taken[r.doc_id] += len(words(r.text))
        own = next(x[1] for x in rows if x[0] == r.doc_id)
        assert all(part in own for part in (r.text,)) or "\n" in r.text
    assert taken == +given


def test_texts_keep_order_and_line_ends(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        n = rng.randint(1, 900)
        rows.append((i, "".join(f"w{i}.{k}" + rng.choice([" ", "\n", "\n\n", "\t"]) for k in range(n)), f"s{i % 3}", "en", 0, "", 1))
    rows.append(rows[0])
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.Mixture(df, weights=(5, 2, 0.5), block=16, shard=8).texts(df).collect()
    text_of = {r[0]: r[1] for r in rows}
    whole = 0
    for r in got:
        own = text_of[r.doc_id]
        if r.text in (own, own + "\n" + own):
            whole += 1
            continue
        at = [int(w.split(".")[1]) for w in words(r.text)]
        falls = sum(b <= a for a, b in zip(at, at[1:]))
        assert falls <= 1  # at most two passes, each in order
        for a, b in zip(at, at[1:]):
            if b == a + 1:  # what lies between neighbours is as in the document
                assert re.search(rf"w{r.doc_id}\.{a}\s+w{r.doc_id}\.{b}\b", own).group() in r.text
    assert whole > 20
    assert sum(r.doc_id == 0 for r in got) == 2


def test_cut_out():
    text = " a b\nc  d e\n"
    assert M.cut_out(text, [(0, 0, 5)]) == text
    assert M.cut_out(text, [(0, 0, 2), (0, 2, 3), (1, 0, 5)]) == text + "\n" + text
    assert M.cut_out(text, [(0, 1, 2), (0, 4, 1), (1, 2, 2)]) == "b\nc\ne\nc  d"


def test_passes_take_every_block():
    plan = M.SourcePlan(3, 1000, 2600.0, 64)
    turn, block, words_ = plan.take(np.arange(plan.slots), 64, 17)
    assert words_.sum() == 2600 and turn.max() == 2
    for t in (0, 1):
        assert sorted(block[turn == t].tolist()) == list(range(16)) and words_[turn == t].sum() == 1000
    assert block[turn == 0].tolist() != block[turn == 1].tolist() and block[turn == 0][-1] + block[turn == 1][-1] != 30
    assert len(set(block[turn == 2].tolist())) == (turn == 2).sum()


def test_shards_are_of_the_set_size(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    sizes = Counter(r.shard for r in M.Mixture(df, block=4, shard=64)._slots().collect())
    assert max(sizes.values()) <= 64 and sum(sizes.values()) > 64 * 50


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.mix(df).count() == 0 and M.Mixture(df).texts(df).count() == 0
    none = spark.createDataFrame([(1, None, None, None, None, None, None), (2, " ", "a", None, None, None, None)], SCHEMA)
    assert {(r.doc_id, r.target, r.taken) for r in M.mix(none).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_clashing_columns(spark):
    plain = spark.createDataFrame([(i, f"some words {i} here", f"s{i % 2}") for i in range(40)], "doc_id long, text string, source string")
    extra = ["mix_key", "mix_cuts", "key", "size", "at", "c0", "c1", "n", "turn"]
    docs = plain.select(*[F.lit("x").alias(c) for c in extra], "*")
    same = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
    assert same(M.mix(docs), "doc_id", "taken") == same(M.mix(plain), "doc_id", "taken")
    texts = M.Mixture(docs).texts(docs)
    assert texts.columns == docs.columns
    assert same(texts, "doc_id", "text", "source") == same(M.Mixture(plain).texts(plain), "doc_id", "text", "source")
