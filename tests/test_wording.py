"""Repairs of prose and the choice with same findings, on small hand-computed cases."""

from __future__ import annotations

import random

from kelpgrid.operators import wording


def test_citations_are_linked_removed_or_left(spark):
    papers = spark.createDataFrame(
        [
            (1, "p1", ["Ana García"], 2020),
            (1, "p2", ["Smith, John", "Jones, Kim"], 2019),
            (1, "p3", ["Smith, Jane"], 2018),
            (1, "p4", ["Mary Smith"], 2018),
            (1, "p5", None, 2015),
            (2, "q1", ["Nobody Else"], 2020),
        ],
        "id int, paper string, authors array<string>, year int",
    )
    bodies = spark.createDataFrame(
        [
            (1, "García (2020) and García (2020) [p1] agree with Smith and Jones (2019). Smith (2018) is open; so it is (Doe 2015). But (Roe 2011) goes ."),
            (2, None),
            (3, "García (2020)  stays."),
        ],
        "id int, text string",
    )
    got = {r.id: r for r in wording.link_citations(bodies, papers).collect()}
    assert got[1].text == "García (2020) [p1] and García (2020) [p1] agree with Smith and Jones (2019) [p2]. Smith (2018) is open; so it is (Doe 2015). But goes."
    assert (got[1].linked, got[1].removed, got[1].unresolved) == (2, 1, 2)
    assert got[2].text is None and got[2].linked == 0
    assert got[3].text == "García (2020)  stays."


def test_same_findings_cost_later_picks(spark):
    rng = random.Random(5)
    words = ["cash", "transfer", "school", "wage", "tax", "health"]
    rows = [("q" if i % 3 else None, i, round(rng.random() / 5, 3), " ".join(rng.sample(words, 2)), " ".join(rng.sample(words, 2))) for i in range(40)]
    rows += [("q", 100, 0.5, None, "")]
    df = spark.createDataFrame(rows, "query string, id long, score double, intervention string, outcome string")
    got = {}
    for r in wording.select_with_findings(df, 12).orderBy("pick").collect():
        got.setdefault(r.query, []).append((r.id, r.adjusted))

    def same(a, b):
        parts = [(set((a[k] or "").split()), set((b[k] or "").split())) for k in (3, 4)]
        return all(x and y and len(x & y) / len(x | y) >= 0.5 for x, y in parts)

    for q in ("q", None):
        left, chosen, want = [r for r in rows if r[0] == q], [], []
        while left and len(chosen) < 12:
            def value(r):
                m = sum(same(r, c) for c in chosen)
                return round(r[2] - (min(0.04 + 0.02 * (m - 1), 0.10) if m else 0), 6)

            best = min(left, key=lambda r: (-value(r), -r[2], r[1]))
            want.append((best[1], value(best)))
            chosen.append(best)
            left.remove(best)
        assert got[q] == want
