"""Cases of the findings of round 3."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kelpgrid.operators import classify, dedup, drafts, inverted, joins
from kelpgrid.plans.works import works
from kelpgrid.sources import files


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_digest_lanes_without_a_pair_for_each_subscription(spark):
    """Against a plain choice, with null levels and dates, subscriptions of several topics, and ties; works never meet single subscriptions."""
    rng = random.Random(5)
    works = [(i, rng.choice("ab"), rng.choice([None, 1, 2]), rng.choice([None, *range(2000, 2012)])) for i in range(150)]
    subs = [(i // 2, rng.choice("abc"), rng.choice([None, *range(1999, 2012)])) for i in range(60)]
    w = spark.createDataFrame(works, "id long, topic string, sms_level int, published int")
    s = spark.createDataFrame(subs, "sub_id long, topic string, last_sent int")
    out = drafts.digest_since(s, w, "topic")
    want = set()
    for sub in {x[0] for x in subs}:
        new = [x for k, topic, sent in subs if k == sub and sent is not None for x in works if x[1] == topic and x[3] is not None and x[3] > sent]
        new.sort(key=lambda x: (x[2] is None, -(x[2] or 0), -x[3], x[0]))
        want |= {(sub, x[0], n + 1) for n, x in enumerate(new[:5])}
    distinct = [x for x in subs if sum(y[0] == x[0] and y[1] == x[1] for y in subs) > 1]
    got = {tuple(r) for r in out.collect()}
    repeated = {x[0] for x in distinct}  # a topic asked for twice repeats its works, in either order
    assert {x for x in got if x[0] not in repeated} == {x for x in want if x[0] not in repeated}
    assert "Aggregate [topic" in plan(out)  # (topic, last_sent) and the works' lists, each once


def test_equal_labels_go_to_the_first_named(spark):
    label, p = classify.softmax_label([F.lit(0.0)], [0.0], [1.0], {"direct": [1.0], "indirect": [2.0], "excluded": [3.0]}, {"direct": 0.5, "indirect": 0.5, "excluded": 0.1})
    assert spark.range(1).select(label).first()[0] == "direct"
    label, p = classify.softmax_label([F.lit(0.0)], [0.0], [1.0], {"direct": [1.0], "indirect": [2.0], "excluded": [3.0]}, {"direct": 0.1, "indirect": 0.5, "excluded": 0.5})
    assert spark.range(1).select(label).first()[0] == "indirect"


def test_twins_by_a_fixed_number_of_rarest_words(spark):
    """The titles share their common words only: a pair by as many words as are needed, none by the three rarest of each."""
    common = "regional banking credit market growth policy"
    paper, article = f"alphaone betatwo gammathree {common}", common + " deltafour"
    others = [(10 + i, 1990, None, "regional banking credit") for i in range(3)] + [(20, 1990, None, "growth policy market alphaone betatwo gammathree"), (21, 1990, None, "regional banking")]
    rows = [(1, 2000, "working_paper", paper), (2, 2001, "journal_article", article), *others]
    df = spark.createDataFrame(rows, "id long, year int, publication_type string, title string")
    assert [tuple(r) for r in drafts.twins(df).collect()] == [(1, 2, 0.6)]
    assert drafts.twins(df, rarest=3).collect() == []


def test_match_links_count_what_the_gate_pairs(spark):
    """Copies, near copies, missing years and surnames, titles of one word and of none, against all pairs compared; copies meet as one class."""
    rng = random.Random(7)
    words = ["labour", "market", "credit", "growth", "school", "health"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5]))) for _ in range(12)] + ["", None, "Été: labour market credit!"]
    rows = [(i, rng.choice(titles), rng.choice([None, 1990, 2000, 2001]), rng.choice([None, "Su", "Sun", "Lee"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, title string, year int, surname string")

    def pairs(title):
        w = "".join(c if c.isascii() and c.isalnum() else " " if c == " " else "" for c in (title or "").lower()).split()
        return {f"{a} {b}" for a, b in zip(w, w[1:])} if len(w) > 1 else set(w)

    def near(a, b):
        x, y = pairs(a[1]), pairs(b[1])
        years = a[2] is None or b[2] is None or abs(a[2] - b[2]) <= 5
        names = a[3] is None or b[3] is None or a[3].lower() in b[3].lower() or b[3].lower() in a[3].lower()
        return a[0] != b[0] and bool(x) and bool(y) and years and names and round(2 * len(x & y) / (len(x) + len(y)), 6) >= 0.5

    want = {(a[0], b[0]) for a in rows for b in rows if near(a, b)}
    assert {(r.left_id, r.right_id) for r in joins.match_gate(df, df, 0.5, 5).collect()} == want
    links = joins.match_links(df, 0.5, 5)
    assert {r.id: r.links for r in links.collect()} == {a[0]: sum(1 for l, _ in want if l == a[0]) for a in rows}
    same = {}
    for a in rows:
        same.setdefault((frozenset(pairs(a[1])) if a[1] is not None else None, a[2], a[3] and a[3].lower()), []).append(a[0])
    assert {r.id: r.class_id for r in links.collect()} == {i: min(ids) for ids in same.values() for i in ids}


def test_pieces_of_a_title_are_few(spark):
    """Substrings that a title shows, and near titles that meet by them in their own year or without one."""
    title = "".join(random.Random(3).choices("abcdefghij", k=60))
    own, met = dedup.edit_pieces()
    assert sum(1 for _ in met(title)) < 150  # 304 when only the sum of all edits bounded the places
    rng = random.Random(4)
    rows = []
    for i in range(80):
        t = list(rng.choice(["labour market credit growth in rural schools", "health of the poor and what it costs them"]))
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice("abxyz")
        rows.append((i, "".join(t), rng.choice([None, 1990, 1991])))
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    words = {i: " ".join(sorted(t.split())) for i, t, _ in rows}
    near = lambda a, b: 100 * (1 - distance(words[a[0]], words[b[0]]) / max(len(words[a[0]]), len(words[b[0]]))) >= 90 and (a[2] == b[2] or not a[2] or not b[2])
    first = {}
    for i, _, y in rows:
        first.setdefault((words[i], y), i)
    kept = {}
    for r in rows:
        f = first[(words[r[0]], r[2])]
        kept[r[0]] = min([f, *[b[0] for b in rows if b[0] < f and near(r, b)]])
    df = spark.createDataFrame(rows, "id long, title string, year int")
    assert {r.id: r.kept_id for r in dedup.fuzzy_first(df).collect()} == kept


def test_signature_matches_leave_no_pairs_to_sort(spark):
    """Many rows of one signature, in several blocks, with and without vectors, against all pairs; what reaches the choice is one row a block."""
    rng = random.Random(9)
    titles = ["labour market credit growth", "rural school health policy", "short"]
    vectors = [None, [1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [0.0, 0.0], [1.0], [None, 1.0]]
    rows = [(i, titles[0] if i < 60 else rng.choice(titles), rng.choice([None, 1990, 1995, 2010]), ["a"] if i % 5 else ["b"], rng.choice(vectors)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, title string, year int, authors array<string>, embedding array<double>")

    def cos(a, b):
        if a is None or b is None:
            return None
        if len(a) != len(b):
            return 0.0
        if None in a or None in b:
            return None
        size = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / size, 6) if size else 0.0

    want = {}
    for a in rows:
        found = [(cos(a[4], b[4]), b[0]) for b in rows if a[1] == b[1] != "short" and a[0] != b[0] and a[2] and b[2] and abs(a[2] - b[2]) <= 8 and a[3] == b[3]]
        if found:
            c, i = min(found, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
            want[a[0]] = (i, c)
    old, joins.SIGNATURE_BLOCK = joins.SIGNATURE_BLOCK, 7
    try:
        out = joins.signature_matches(df, df)
    finally:
        joins.SIGNATURE_BLOCK = old
    assert {r.left_id: (r.right_id, r.cosine) for r in out.collect()} == want
    assert "Window" not in plan(out)


def test_postings_are_made_within_rows(spark):
    """Places of each word of a text, a word twice and texts without words among them, and no shuffle."""
    df = spark.createDataFrame([(1, "taxes of the state, tax and taxes"), (2, ""), (3, None), (4, "the of"), (5, "growth")], "id long, t string")
    out = inverted.postings(df, F.col("t"))
    assert sorted((r.id, r.term, list(r.positions)) for r in out.collect()) == [(1, "state", [4]), (1, "tax", [1, 7]), (1, "tax", [5]), (5, "growth", [1])]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_payloads_are_parsed_once(spark):
    """One parse of the object and one of the objects within, whatever is made of them."""
    out = spark.createDataFrame([('{"a": "1", "b": {"c": "2"}, "l": [1, 2]}',)], "p string").select(files.scrubbed_json(F.col("p")).alias("m"))
    assert out.first().m == {"a": "1", "b.c": "2", "l_count": "2"}
    assert out._jdf.queryExecution().analyzed().toString().count("from_json(") == 2


def test_crawl_counts_repeated_edges_once_and_spreads_them_first(spark, monkeypatch):
    """Against a plain crawl, with repeated edges and nulls; what a task reads is sent on before distinct rows are looked for."""
    monkeypatch.setattr(joins, "DISTINCT_ROWS", 100)
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(40)])) for _ in range(900)]
    edges, seeds = spark.createDataFrame(rows, "citing int, cited int"), set(range(0, 30, 4))
    known = spark.createDataFrame([(i,) for i in seeds], "id int")
    distinct = set(rows)
    cites = {i: sum(c == i for _, c in distinct) for i in range(40)}
    want: dict = {}
    for seed in seeds:
        for near in ({c for s, c in distinct if s == seed}, {s for s, c in distinct if c == seed}):
            ranked = sorted(near, key=lambda i: (-cites.get(i, 0), i is not None, i or 0))[:5]
            for i in ranked:
                if cites.get(i, 0) >= 3 and i not in seeds:
                    want.setdefault(i, set()).add(seed)
    out = joins.crawl(edges, known, known, each=5)
    assert {tuple(r) for r in out.collect()} == {(i, len(s), cites[i]) for i, s in want.items()}
    assert joins.distinct_rows(edges).rdd.getNumPartitions() == 10
    assert plan(out).count("RepartitionByExpression") == 3


def test_titles_are_made_before_the_joins(spark, small):
    """No text goes through the joins of the works for a title; titles meet once each, not once a year within reach."""
    titles = plan(works(spark, small).select("id", "title"))
    assert titles.index("Join LeftOuter") < titles.index("substring(text")
    best = plan(dedup.best_ranked(works(spark, small)))
    assert "Generate" not in best and "explode" not in best


def test_methods_are_found_before_the_joins_and_by_their_words(spark, small):
    """Every pattern of the ingest is tried only on texts that hold a word of one of its choices, and labels as without that."""
    from kelpgrid.operators import rules as R
    from kelpgrid.plans import reports

    assert all(R.required_words(p) for _, _, ps in R.INGEST_METHODS for p in ps)
    assert R.required_words(r"(?i)\b(two[- ]stage least squares|iv estimators?)\b") == ("stage least squares", "iv estimator")
    assert R.required_words(r"\b(IV|2SLS)\b") == () and R.required_words(r"(?i)\bcorrelat(ion|ed)\b") == ("correlat",)
    texts = ["A DIFFERENCE in-differences design", "diff-in-diff", "the iv estimator", "Two-Stage least squares", "2SLS", "rdd", "xrdd", "Panel  data", "panel data", "érct", "RCT", "Cross sectional", None, "", "ethnograph", "ethnographic"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    plain = F.coalesce(*[F.when(F.col("t").rlike(R.plain_bounds(p)), F.lit(d)) for _, d, ps in R.INGEST_METHODS for p in ps])
    rows = df.select(classify.method(F.col("t"), R.INGEST_METHODS).design.alias("a"), plain.alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and len({r.a for r in rows}) == 7
    found = plan(reports.k04_ingest_methods(spark, small))
    assert found.index("Join LeftOuter") < found.index("RLIKE")
