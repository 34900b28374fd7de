from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpgrid.llm import simhash_dedup as S
from kelpgrid.llm.components import components


def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(fps))]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abAB É\t\n\x0b\x1c\xa0x", max_size=60))
def test_fingerprint(text):
    assert S.simhash(text) == slow_simhash(text)


def test_hash_is_spark_s(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0]
    assert row % (1 << 64) == S.simhash("a b c d")


def texts():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    out = list(base)
    for t in base[:6]:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randint(1, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return [*out, base[0], base[0].upper(), None, "", " \n ", "one", "One", "x " * 5000]


def test_components_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[0], (None, "alone text of nobody here"), (None, rows[1][1]), (2**63 - 1, rows[2][1]), (2**53 + 1, "some other text of an id that no double holds"), (2**53 + 3, "yet another such text"), (-5, rows[3][1])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, fingerprint string, key int")
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect())
    fps = [slow_simhash(t) for _, t in rows]
    want = sorted((i is None, i, format(f, "016x"), c) for (i, _), f, c in zip(rows, fps, slow_components([i for i, _ in rows], fps)))
    assert got == want


def test_one_of_each(spark):
    rows = [(i, t, "fr", "key") for i, t in enumerate(texts())]
    rows += [rows[2], (None, "a text without an id", None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, row_key_ string")
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    ids = [i for i, *_ in rows]
    classes = slow_components(ids, [slow_simhash(t) for _, t, *_ in rows])
    got = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    assert got == sorted((c is None, c) for c in set(classes))


def test_links_lose_none(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 20, dtype=np.int64)
    fps = set()
    for c in centres.tolist():
        for _ in range(15):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            fps.add(x if x < 2**63 else x - 2**64)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = {tuple(r) for r in components(S.links(df, 4)).collect()}
    root = {n: r for n, r in found}
    unsigned = [x % 2**64 for x in fps]
    classes = slow_components(fps, unsigned)
    by = {}
    for x, c in zip(fps, classes):
        by.setdefault(c, set()).add(root.get(x, x))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0 and S.one_of_each(df).count() == 0


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}
