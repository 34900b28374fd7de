from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

from kelpgrid.llm import token_counts as K

PATH = public_tokenizers.path("word_bpe_49k.json")


def documents():
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta", "it's", "é"], k=rng.choice([0, 1, 5, 40, 900]))), i, "x") for i in range(200)]
    return [*rows, rows[3], (None, "no id", 0, ""), (500, None, 0, ""), (501, "word " * 3000, 0, "")]


SCHEMA = "doc_id long, text string, length int, docs string"


def test_against_brute_force(spark):
    public = Tokenizer.from_file(PATH)
    lengths = [len(public.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in documents()]
    sums = K.token_counts(spark.createDataFrame(documents(), SCHEMA), PATH)
    got = {r.length: r for r in sums.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        longer = [x for x in lengths if x > n]
        assert (r.docs, r.docs_longer, r.tokens_longer) == (lengths.count(n), len(longer), sum(longer))
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
        assert r.truncated_total == sum(min(x, n) for x in lengths)
        assert r.fits == round(1 - len(longer) / len(lengths), 9)
    limits = [0, 1, 3, 500, 1024, 10**6]
    assert {tuple(r) for r in K.at_limits(sums, limits).collect()} == {(c, sum(x > c for x in lengths), sum(min(x, c) for x in lengths)) for c in limits}
    shares = [0.1, 0.5, 0.95, 1.0]
    ordered = sorted(lengths)
    want = {(p, next(x for x in ordered if sum(y <= x for y in lengths) >= -(-p * len(lengths) // 1))) for p in shares}
    assert {tuple(r) for r in K.quantiles(sums, shares).collect()} == want


def test_empty(spark):
    assert K.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0
