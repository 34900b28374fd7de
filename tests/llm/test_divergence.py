"""Source divergence against sums over every kept term, zero counts included."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from kelpgrid.llm import divergence

LEAST = 3


def by_definition(rows, least=LEAST, top=10):
    docs = []
    for text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        docs.append((lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        held[lang].update(set(words))
        counts[lang, source].update(words)
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in held.items()}
    own = {g: {t: c[t] for t in kept[g[0]]} for g, c in counts.items()} | {(lang, source): {t: 0 for t in kept[lang]} for lang, source, w in docs if (lang, source) not in counts}
    whole = {lang: {t: sum(c[t] for (x, _), c in own.items() if x == lang) for t in terms} for lang, terms in kept.items()}

    def shares(c):
        total, v = sum(c.values()), len(c)
        return {t: 1 + 10**9 * (n + 2) // (total + 2 * v) for t, n in c.items()}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for (lang, source), c in own.items():
        p, q = shares(c), shares(whole[lang])
        pairs = [(s, sum(f(p[t], shares(d)[t]) for t in p)) for (x, s), d in own.items() if x == lang and s != source]
        terms = [(t, f(p[t], q[t])) for t in p if c[t] > 0 and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return sorted(out)


ROWS = [(f"The {w} of Über {w} and a{k % 3} the{k % 5} ÉTÉ", lang, source) for k, w in enumerate("alpha beta Alpha gamma delta beta beta omega alpha zeta".split()) for lang in ("de", None) for source in ("s1", "s2", None) if (k + len(source or "")) % 3]
ROWS += [("only once", "xx", "s1"), (None, "xx", "s2"), ("", "de", "empty"), ("12 34 !!", "de", "signs"), ("tie tie", "de", "s1"), ("\U0001f600\U0001f600 tie", "de", "s2"), ("tie tie tie", "de", "s9")]
ROWS += ROWS[:4]


def result(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, term int, n string").repartition(3)
    return sorted(tuple(r) for r in divergence.audit(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_the_definition(spark):
    assert result(spark, ROWS, least=LEAST) == by_definition(ROWS)


def test_no_kept_terms(spark):
    found = result(spark, ROWS, least=10_000)
    assert found == by_definition(ROWS, 10_000) and {r[4] for r in found} == {0}


def test_counts_beyond_long_products(spark):
    row = spark.range(1).select(divergence.share(divergence.F.lit(8 * 10**12), divergence.F.lit(10**13), divergence.F.lit(5)).alias("p")).first()
    assert row.p == 1 + 10**9 * (8 * 10**12 + 2) // (10**13 + 10)


def test_empty_table(spark):
    assert result(spark, []) == []
