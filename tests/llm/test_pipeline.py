from __future__ import annotations

import random

import pytest

import corpus_pipeline as C
from kelpgrid.llm import secret_scan, simhash_dedup, toxicity
from kelpgrid.sources.tables import table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    path = str(tmp_path_factory.mktemp("tables"))
    words = ["word%d" % i for i in range(400)]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        text = rng.choices(words, k=150) + (["idiot"] * 3 if toxic else [])
        rng.shuffle(text)
        docs.append((i, " ".join(text), "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(500 + i, docs[i + 1][1] + (" more" if i % 2 else ""), "en", "s1", 1) for i in range(12)]
    docs += [(600, "a clean text with token = 'abcdef0123456789' in it", "en", "s2", 1), (601, None, None, None, None), docs[5], (None, "no id at all in this row", "en", "s0", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    first = docs
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == first.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        a, b = docs.collect(), after.collect()
        if name == "toxicity":
            assert not any("idiot" in (r.text or "") for r in b)
            assert sum("idiot" not in (r.text or "") for r in a) == len(b)
        elif name == "simhash_dedup":
            fps = [simhash_dedup.simhash(r.text) for r in b]
            assert all((x ^ y).bit_count() > 4 for i, x in enumerate(fps) for y in fps[:i])
            classes = simhash_dedup.near_duplicates(docs).select("component_id").distinct().count()
            assert len(b) == classes
        elif name == "secret_scan":
            assert len(a) == len(b)
            assert not any(secret_scan.scan(r.text or "", secret_scan.default_model()) for r in b)
        elif name == "mixing":
            assert {r.doc_id for r in b} <= {r.doc_id for r in a}
            total = sum(len((r.text or "").split()) for r in a)
            assert sum(len(r.text.split()) for r in b) == pytest.approx(1.5 * total, rel=0.01)
        else:
            assert {r.doc_id for r in b} == {r.doc_id for r in a}
            assert sum(r.length for r in b) == sum({r.doc_id: r.doc_tokens for r in b}.values())
        docs = after


def test_run(spark, folder):
    assert C.run(spark, folder).count() > 0


def test_empty_documents(spark, folder):
    docs = table(spark, folder, "documents").where("doc_id < 0")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_model_is_learned_from_labels(spark, folder):
    model = toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    assert len(model.index) > 0
