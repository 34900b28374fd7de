"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the terms that a text holds: its words and
their first letters, hashed. The pairwise part weighs combinations, such as an insult with the
mention of a group, that no sum of single weights can. Fitted with AdaGrad on a bounded sample of
labelled rows; scoring covers every row and whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgrid.llm.staging import bounded_sample

WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)


def term_hashes(word: str, bits: int = 22) -> tuple[int, ...]:
    """Hashes of a lower-cased word and of its first letters."""
    mask = (1 << bits) - 1
    terms = ["w" + word, *(f"{n}{word[:n]}" for n in STEMS if len(word) >= n)]
    return tuple({zlib.crc32(t.encode("utf-8", "surrogatepass")) & mask for t in terms})


class _Words(dict):
    """Hashes by word, kept for the words met last; only those in ``known`` if it is given."""

    def __init__(self, known: dict[int, int] | None = None, most: int = 200_000):
        super().__init__()
        self.known, self.most = known, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        found = term_hashes(word)
        if self.known is not None:
            found = tuple(self.known[h] for h in found if h in self.known)
        self[word] = found
        return found


def _terms(text: str | None, words: _Words) -> list[int]:
    found: set[int] = set()
    for w in set(WORD.findall((text or "").lower())):
        found.update(words[w])
    return sorted(found)


@dataclass
class FactorizationMachine:
    """Weights of the terms kept, by hash."""

    bias: float = -30.0
    index: dict[int, int] = field(default_factory=dict)
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """The value before the sigmoid, of texts given by the positions of their terms."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        at = np.repeat(np.arange(len(rows)), lengths)
        out = self.bias + np.bincount(at, self.w[flat], len(rows))
        for f in range(self.v.shape[1]):
            x = self.v[flat, f]
            out += 0.5 * (np.bincount(at, x, len(rows)) ** 2 - np.bincount(at, x * x, len(rows)))
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def select_terms(rows: list[np.ndarray], y: np.ndarray, least: int, most: int, bits: int = 22) -> np.ndarray:
    """The ``most`` terms, of those in ``least`` rows or more, with the largest chi-square against the label."""
    n, pos = np.zeros(1 << bits), np.zeros(1 << bits)
    for r, label in zip(rows, y.tolist()):
        n[r] += 1  # a row holds a term once
        pos[r] += label
    terms = np.flatnonzero(n >= least)
    n, pos, p = n[terms], pos[terms], y.mean()
    chi = (pos - n * p) ** 2 / (n * p) + ((n - pos) - n * (1 - p)) ** 2 / (n * (1 - p))
    ok = np.flatnonzero(chi > 6.63)
    return terms[ok[np.argsort(-chi[ok], kind="stable")][:most]]


def fit(rows: list[np.ndarray], y: np.ndarray, factors: int = 4, epochs: int = 12, batch: int = 128, rate: float = 0.2, decay: float = 2e-4, least: int = 5, most: int = 4096, seed: int = 3) -> FactorizationMachine:
    """Logistic loss, AdaGrad, minibatches in an order fixed by ``seed``."""
    y = y.astype(float)
    if not len(y) or y.min() == y.max():
        return FactorizationMachine(30.0 if len(y) and y[0] else -30.0)
    kept = select_terms(rows, y, least, most)
    index = {int(t): i for i, t in enumerate(kept)}
    place = np.full(1 << 22, -1, np.int32)
    place[kept] = np.arange(len(kept))
    rows = [p[p >= 0].astype(np.int64) for p in (place[r] for r in rows)]
    rng = np.random.default_rng(seed)
    m = FactorizationMachine(float(np.log(y.mean() / (1 - y.mean()))), index, np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), factors)))
    gw, gv, gb = np.full(len(kept), 1e-6), np.full(m.v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            part = order[a : a + batch]
            mine = [rows[i] for i in part]
            flat = np.concatenate(mine)
            at = np.repeat(np.arange(len(part)), [len(r) for r in mine])
            error = (m.score(mine) - y[part]) / len(part)
            touched, which = np.unique(flat, return_inverse=True)
            sums = np.stack([np.bincount(at, m.v[flat, f], len(part)) for f in range(factors)], 1)
            dw = np.bincount(which, error[at], len(touched)) + decay * m.w[touched]
            dv = np.stack([np.bincount(which, error[at] * (sums[at, f] - m.v[flat, f]), len(touched)) for f in range(factors)], 1) + decay * m.v[touched]
            db = error.sum()
            gw[touched] += dw**2
            gv[touched] += dv**2
            gb += db**2
            m.w[touched] -= rate * dw / np.sqrt(gw[touched])
            m.v[touched] -= rate / 4 * dv / np.sqrt(gv[touched])
            m.bias -= rate * db / np.sqrt(gb)
    return m


def held_out(id_col: str = "doc_id"):
    """True for the rows whose labels are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000) -> FactorizationMachine:
    """Fits on at most ``sample_rows`` labelled rows that are not held out (least hashes of the id).

    Only text and label are used. Rows without id, label or a document are not learned from; an id
    labelled twice has its largest label, and of documents of one id one is learned from. With one class only the score is that class for all.
    """
    labelled = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .where("id is not null and y is not null")
        .where(~held_out("id"))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    chosen = bounded_sample(labelled, "id", sample_rows)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for rows in batches:
            data = [np.array(_terms(t, words), np.int32).tobytes() for t in rows.text]
            yield pd.DataFrame({"id": rows.id.astype(str), "y": rows.y, "terms": data})

    # one row an id, however often a document is repeated
    each = picked.mapInPandas(run, "id string, y int, terms binary").groupBy("id").agg(F.min(F.struct("y", "terms")).alias("r")).select("id", "r.y", "r.terms")
    got = sorted(each.toLocalIterator())
    return fit([np.frombuffer(r.terms, np.int32) for r in got], np.array([r.y for r in got], float))


def scorer(docs: DataFrame, model: FactorizationMachine):
    """A function of a text column that gives the score, 0 to 1, of each whole text; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        words = _Words(m.index)
        for batch in texts:
            yield pd.Series(m.score([np.array(_terms(t, words), np.int64) for t in batch]))

    return of


def without_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    return docs.where(scorer(docs, model)(F.col(text_col)) < threshold)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, repeated rows each."""
    model = train(docs, labels, id_col, text_col, label_col)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = picked.select("doc_id", held_out().alias("held_out"), scorer(docs, model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
