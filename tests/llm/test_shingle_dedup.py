from __future__ import annotations

import random

import corpus_pipeline
from kelpgrid.llm import shingle_dedup as S
from kelpgrid.llm import simhash_dedup


def slow_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows):
    """The ids of the rows to be kept, by all pairs."""
    sets, parent = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min((i is None, i or 0), least.get(find(k), (True, 0)))
    return sorted(least.values())


def changed(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def rows():
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 120, 400]))) for _ in range(40)]
    texts = list(base)
    for t in base:
        size = len(t.split())
        texts += [changed(rng, t, k) for k in {1, max(1, size // 50), size // 40, size // 30}]
    chain = base[0]
    for _ in range(6):
        chain = changed(rng, chain, max(1, len(chain.split()) // 60))
        texts.append(chain)
    texts += [base[0], base[1].upper(), None, "", " \n", "one", "One", "x " * 5000, "a b c d e f", "a b c d e"]
    found = list(enumerate(texts)) + [(None, "a text without an id"), (None, None), (3, base[3])]
    rng.shuffle(found)
    return found


def test_all_pairs(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "fr") for i, t in data], "doc_id long, text string, lang string")
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == slow_kept(data)


def test_stage_drops_copies_more_than_four_bits_apart(spark):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(3000)}" for _ in range(300))
    copies = [(k, changed(rng, text, 6)) for k in range(1, 12)]
    far = [(k, t) for k, t in copies if (simhash_dedup.simhash(t) ^ simhash_dedup.simhash(text)).bit_count() > 4]
    assert len(far) > 3 and all(5 * len(slow_set(t) & slow_set(text)) >= 4 * len(slow_set(t) | slow_set(text)) for _, t in far)
    df = spark.createDataFrame([(0, text), *far], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()] == [0]


def test_bands_miss_no_pair():
    rng = random.Random(6)
    for _ in range(300):
        text = [f"w{rng.random()}" for _ in range(104)]
        a, b = S.shingle_set(" ".join(text)), S.shingle_set(" ".join(text[:50] + ["x"] + text[51:80] + ["y"] + text[81:]))
        assert 0.79 < len(np_and(a, b)) / len(set(a.tolist()) | set(b.tolist())) < 0.83
        assert set(S.band_keys(a)) & set(S.band_keys(b))


def np_and(a, b):
    return set(a.tolist()) & set(b.tolist())


def test_empty(spark):
    assert S.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_of_one_text_on_both_sides_of_the_bound(spark):
    rng = random.Random(12)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(150))
    data = [(k, changed(rng, base, rng.choice([1, 2, 3, 4, 5, 6, 9]))) for k in range(40)]
    words = base.split()
    for k in range(40, 60):  # parts left out: no words of their own
        at = rng.randrange(100)
        data.append((k, " ".join(words[:at] + words[at + rng.choice([8, 20, 35]) :])))
    kept = S.one_of_each(spark.createDataFrame(data, "doc_id long, text string"))
    assert 1 < len(slow_kept(data)) < 50
    assert sorted((False, r.doc_id) for r in kept.collect()) == slow_kept(data)
