from __future__ import annotations

import random
import zlib
from collections import Counter, deque

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kelpgrid.llm import packing as P
from kelpgrid.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
OWN, PUBLIC = WordTokenizer(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aB'sté.Σσ1½ \u0085\u001c İ́<|>endoftx", max_size=40))
def test_ids(text):
    assert OWN.ids(text).tolist() == PUBLIC.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|startoftext|> I'm <|endoftext|>", "don't WE'LL", "x" * 5000, "é́ é", "日本語 text"])
def test_ids_of_odd_texts(text):
    assert OWN.ids(text).tolist() == PUBLIC.encode(text, add_special_tokens=False).ids
    assert OWN.ids(None).tolist() == []


def test_capacities():
    for n in (0, 1, 2047, 2048, 2049, 9999):
        sizes = P.capacities(n, 2048)
        assert sum(sizes) == n and all(s == 2048 or s & (s - 1) == 0 for s in sizes)


def test_round_robin_follows_the_targets():
    queues = {s: deque((k, 0, 500) for k in range(n * 40, (n + 1) * 40)) for n, s in enumerate("abc")}
    share = {"a": 0.6, "b": 0.3, "c": 0.1}
    pieces = list(P.deficit_round_robin(queues, dict.fromkeys("abc", 0.0), share, [1000] * 60, 64, 3.0))
    for w in range(0, 30):  # while no queue is empty
        held = Counter()
        for number, source, *_, n, _ in pieces:
            if number == w:
                held[source] += n
        assert sum(held.values()) == 1000 and all(abs(held[s] - 1000 * share[s]) <= 128 for s in "abc")
    early = Counter()
    for number, source, *_, n, _ in pieces:
        if number < 30:
            early[source] += n
    assert all(abs(early[s] - 30_000 * share[s]) <= 128 for s in "abc")  # what a window lacks, later ones make up


def test_carried_credit_is_served_first():
    queues = {s: deque([(i, 0, 5000)]) for i, s in enumerate("ab")}
    pieces = list(P.deficit_round_robin(queues, {"a": -600.0, "b": 600.0}, {"a": 0.5, "b": 0.5}, [1000] * 4, 64, 3.0))
    first = sum(n for number, s, *_, n, _ in pieces if s == "b" and number == 0)
    assert first > 900


def documents():
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta", "gamma.", "δ", "it's"], k=rng.randint(0, 300))), rng.choice(["s0", "s0", "s1", None]), "en", 0) for i in range(150)]
    return [*rows, rows[3], (400, None, "s1", "en", 1), (401, "", "s2", "en", 1), (None, "no id", "s1", "en", 1), (402, "word " * 12_000, "s1", "en", 1), (2**63 - 1, "the greatest id", "s1", "en", 1), (2**53 + 1, "an odd id", "s0", "en", 1), (2**53 + 3, "an odd id", None, "en", 1)]


SCHEMA = "doc_id long, text string, source string, lane string, n int"


@pytest.mark.parametrize("lanes", [None, 1, 9])
def test_every_id_in_one_piece(spark, lanes):
    rows = documents()
    got = P.pack(spark.createDataFrame(rows, SCHEMA), PATH, lanes=lanes).collect()
    pieces = Counter()
    by_doc = {}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, ids.tolist(), r.doc_tokens))
        pieces[r.sequence_id] += r.length
    copies = Counter(i for i, *_ in rows)
    for i, text, *_ in rows:
        want = PUBLIC.encode(text or "", add_special_tokens=False).ids + [1]
        have = Counter()
        for start, ids, total in by_doc[i]:
            assert total == len(want) and ids == want[start : start + len(ids)]
            have.update(range(start, start + len(ids)))
        assert have == {k: copies[i] for k in range(len(want))}
    for s in pieces:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    assert sorted(pieces) == list(range(len(pieces)))


def test_targets_and_empty(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    packed = P.pack(df, PATH, window=256, targets={"s0": 3, "s1": 1, None: 1}, lanes=1).collect()
    early = Counter()
    for r in packed:
        if r.sequence_id < 20:
            early[r.source] += r.length
    assert early["s0"] / sum(early.values()) == pytest.approx(0.6, abs=0.05)
    assert P.pack(df.where("doc_id = -1"), PATH).count() == 0


def test_lanes_follow_the_tokens(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    got = P.pack(df, PATH, window=256, lane_tokens=2000, with_ids=False)
    plan = Counter(r.doc_id for r in got.select("doc_id", "start", "doc_tokens").collect())
    assert set(plan) == {i for i, *_ in documents()}
    many = spark.createDataFrame([(5, "the same row", "s0", "", 0)] * 400, SCHEMA)
    deals = P.tokenized(many, PATH).select("deal").distinct().count()
    assert deals > 90  # one row that is repeated is dealt to many lanes
    assert sum(r.length for r in P.pack(many, PATH).collect()) == 400 * 4
    with pytest.raises(ValueError):
        P.pack(df, PATH, max_sources=2)
