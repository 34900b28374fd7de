"""Cases of the findings of round 4."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from kelpgrid.operators import drafts, joins
from kelpgrid.sources import files


def test_csv_lines_are_parsed_as_they_were(spark):
    """Empty and null texts, null characters, U+FFFF (which ended a parser's input, for the next lines too), quotes, line ends, white space."""
    texts = [None, "", " ", "a", '"', '""', '"\0,"', "\0", "\uffff", "'", ",", ",,", 'a"b,c', "\r\n", " x ", "\\", '\\"', "null", "\ufeffx", '"' * 20_001, "é, 😀", '","' * 5_000]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    r = files.csv_values(F.col("line"))
    out = files.csv_lines(df, ["id", "a", "b"], mark_empty=True).select(r.alias("r")).collect()
    assert sorted((int(x.r[0]), *x.r[1:]) for x in out) == rows


def test_twins_make_pairs_last(spark, monkeypatch):
    """Copies, near copies, unknown years and kinds, and blocks of few pairs, against all pairs compared; no pair goes through a join or is looked at twice."""
    rng = random.Random(11)
    words = ["labour", "market", "credit", "growth", "school", "health", "prices", "wages", "trade", "banks"]
    titles = [" ".join(rng.sample(words, rng.choice([1, 2, 3, 5, 7, 9]))) for _ in range(25)] + [None, "", "the of"]
    rows = [(i, rng.choice([None, *range(2000, 2008)]), rng.choice([None, "working_paper", "journal_article"]), rng.choice(titles)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, year int, publication_type string, title string")
    sets = {i: {w for w in (t or "").split() if len(w) >= 4} for i, _, _, t in rows}
    often = Counter(w for s in sets.values() for w in s)
    rare = {i: set(sorted(s, key=lambda w: (often[w], w))[:3]) for i, s in sets.items()}
    for few in (drafts.TWIN_PAIRS, 10):
        monkeypatch.setattr(drafts, "TWIN_PAIRS", few)
        monkeypatch.setattr(drafts, "TWIN_BLOCK", min(few, drafts.TWIN_BLOCK))
        for rarest in (3, None):
            want = []
            for a, ay, ak, _ in rows:
                for b, by, bk, _ in rows:
                    if ak == "working_paper" and bk == "journal_article" and None not in (ay, by) and abs(ay - by) <= 2 and sets[a] & sets[b] and (rarest is None or rare[a] & rare[b]):
                        j = round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)
                        want += [(a, b, j)] * (j >= 0.6)
            out = drafts.twins(df, rarest=rarest)
            assert len(want) > 300 and sorted(tuple(r) for r in out.collect()) == sorted(want)
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Aggregate" not in plan


def test_the_gate_compares_each_pair_of_classes_once(spark, monkeypatch):
    """Stripes of few rows, against all pairs compared; what is dear to compare is looked at last."""
    rng = random.Random(13)
    words = ["labour", "market", "credit", "growth", "school", "health"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 7]))) for _ in range(30)] + ["", None]
    rows = [(i, rng.choice(titles), rng.choice([None, 2000, 2003, 2009]), rng.choice([None, "Li", "Lima", "Ford"])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, title string, year int, surname string")

    def pairs(t):
        w = (t or "").split()
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or set(w)

    def alike(a, b):
        x, y = pairs(a[1]), pairs(b[1])
        near = None in (a[2], b[2]) or abs(a[2] - b[2]) <= 5
        named = None in (a[3], b[3]) or a[3].lower() in b[3].lower() or b[3].lower() in a[3].lower()
        return bool(x and y and near and named and round(2 * len(x & y) / (len(x) + len(y)), 6) >= 0.5)

    want = {a[0]: sum(alike(a, b) for b in rows if b is not a) for a in rows}
    for stripe in (joins.STRIPE_ROWS, 3):
        monkeypatch.setattr(joins, "STRIPE_ROWS", stripe)
        assert {r.id: r.links for r in joins.match_links(df, 0.5, 5).collect()} == want
        assert {(r.left_id, r.right_id) for r in joins.match_gate(df, df, 0.5, 5).collect()} == {(a[0], b[0]) for a in rows for b in rows if a is not b and alike(a, b)}
    classes = joins._wording_classes(joins._wordings(df))
    met = joins._near_wordings(classes, None, 0.5, 5)
    found = [(r.left_id, r.right_id) for r in met.collect()]
    assert found and len(found) == len({frozenset(x) for x in found}) and all(a != b for a, b in found)
    gate = next(x for x in met._jdf.queryExecution().optimizedPlan().toString().split("\n") if "array_intersect" in x and "Join" in x)
    assert gate.index("abs(") < gate.index("array_intersect")
