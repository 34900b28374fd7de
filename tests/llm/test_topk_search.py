from __future__ import annotations

import numpy as np
import pytest

from kelpgrid.llm import topk_search as S


def brute(rows, k, is_query):
    clean = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = tuple(int(np.floor(256 * float(x))) for x in v)
        clean[i] = min(clean.get(i, q), q)
    out = set()
    for i, q in clean.items():
        if is_query(i):
            scored = sorted((-sum(a * b for a, b in zip(q, p)), j) for j, p in clean.items() if j != i and len(p) == len(q))
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)}
    return out


def run(spark, rows, k=5, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank string")
    return {tuple(r) for r in S.top_k(df, lambda i: i % 5 == 0, k, **options).collect()}


def with_more(rows):
    return [(i, v, "x", "y") for i, v in rows]


@pytest.mark.parametrize("chunk,held,queries,sample", [(8, 2, 4, 16), (2048, 16, 8192, 1024), (100, 1, 7, 3)])
def test_against_brute_force(spark, chunk, held, queries, sample):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(30)]  # ties
    rows += [rows[3], rows[3], (None, [1.0] * 6), (300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2**63 - 1, [0.4] * 6), (2**53 + 1, [0.45] * 6), (302, [float("nan")] * 6), (303, [float("inf")] * 6)]
    got = run(spark, with_more(rows), chunk_rows=chunk, held_chunks=held, lane_queries=queries, sample_rows=sample, n_pivots=5)
    assert got == brute(rows, 5, lambda i: i % 5 == 0)


def test_few_rows_lengths_and_large_values(spark):
    rows = [(0, [1.0, 2.0]), (5, [1.0]), (10, [3.0]), (1, [-1.0, 0.5]), (2, [1e4, 1e4])]
    got = run(spark, with_more(rows))
    assert got == brute(rows, 5, lambda i: i % 5 == 0)
    assert not any(i == 0 and j == 5 for i, _, j, _ in got)


def test_empty(spark):
    assert run(spark, []) == set()


def test_scores_saturate():
    big = np.full((1, 2), 2**40, np.int64)
    assert S._exact_scores(big, big)[0, 0] == 2**63 - 1


@pytest.mark.parametrize("chunk", [64, 500])
def test_share_of_pairs_that_are_evaluated(chunk):
    """On clustered rows most pairs are excluded by the table of distances; what is left out is never among the best."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 400
    x = np.rint(centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 20).astype(np.int64)
    ids, pivots = np.arange(3000), S.choose_pivots(x[:300], 16)
    d = S._distances(x, pivots)
    order = np.lexsort((d.min(1), d.argmin(1)))
    asked = np.arange(0, 3000, 50)
    searcher = S.Searcher(5, asked, x[asked], d[asked], ids[:200], x[:200])
    chunks = [(ids[at], x[at], d[at].astype(np.float32)) for at in np.array_split(order, 3000 // chunk)]
    for a in range(0, len(chunks), 4):
        searcher.show(chunks[a : a + 4])
    got = {}
    for r in searcher.frame().sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).itertuples():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in asked.tolist():
        scores = x @ x[q]
        want = sorted(((-int(s), i) for i, s in enumerate(scores.tolist()) if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in want]
    assert searcher.pairs == 60 * 3000 and searcher.evaluated / searcher.pairs < 0.25, searcher.evaluated / searcher.pairs


def test_many_lengths_raise(spark):
    df = spark.createDataFrame([(i, [1.0] * (i + 1), "", "") for i in range(8)], "vec_id long, embedding array<float>, score string, rank string")
    with pytest.raises(ValueError):
        S.top_k(df, lambda i: i % 5 == 0, max_lengths=5)


@pytest.mark.parametrize("spread", [1e4, 1e12])
def test_far_rows_do_not_spoil_the_bounds(spark, spread):
    """A pivot far from everything makes large distances, whose rounding must not exclude near rows."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4) / 50)]) for i in range(200)] + [(1000 + i, [float(np.float32(spread * (1 + i))), 0.0, 0.0, 1.0]) for i in range(6)]
    got = run(spark, with_more(rows), chunk_rows=32, sample_rows=300, n_pivots=8)
    want = brute(rows, 5, lambda i: i % 5 == 0)
    assert {(q, r, j, min(s, 2**63 - 1)) for q, r, j, s in want if s < 2**63} == {x for x in got if x[3] < 2**63 - 1}


def test_vectors_without_components(spark):
    rows = [(0, []), (5, []), (7, []), (10, [1.0, 2.0]), (11, [0.5, 0.5])]
    assert run(spark, with_more(rows)) == brute(rows, 5, lambda i: i % 5 == 0)
