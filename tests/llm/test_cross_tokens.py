"""Token alignment against the definition, byte by byte."""

from __future__ import annotations

import glob
import hashlib
from collections import Counter, defaultdict
from functools import partial

import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
from tokenizers import Tokenizer

from kelpgrid.llm import cross_tokens, staging
from kelpgrid.llm.queries import op12_alignment
from kelpgrid.llm.tokens import _byte_of

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_definition(rows):
    """``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of texts from ids of whole texts."""
    bpe = Tokenizer.from_file(BPE)
    bpe.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    coded = _byte_of()

    def piece_bytes(i):
        name = piece.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if piece.is_byte(i) else name.replace("▁", " ").encode()

    found = []
    for text in rows:
        links, groups = Counter(), []
        a = bpe.encode(" " + text, add_special_tokens=False).ids if text else []
        b = piece.encode(text) if text else []
        spans = []
        for ids, raw in ((a, [bytes(coded[c] for c in bpe.id_to_token(i)) for i in a]), (b, [piece_bytes(i) for i in b])):
            at, out = 0, []
            for i, x in zip(ids, raw):
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append((out, b"".join(raw)))
        whole = (" " + text).encode() if text else b""
        if spans[0][1] != whole or spans[1][1] != whole:
            spans = [([], b""), ([], b"")]
        sa, sb = spans[0][0], spans[1][0]
        for x in sa:
            for y in sb:
                if x[0] < y[1] and y[0] < x[1]:
                    links[x[2], y[2]] += 1
        shared = sorted({x[1] for x in sa} & {y[1] for y in sb})
        start = 0
        for end in shared:
            part = lambda s: ",".join(str(i) for p, e, i in s if start <= p and e <= end)  # noqa: B023, E731
            groups.append(f"{part(sa)}|{part(sb)}")
            start = end
        found.append((len(sa), len(sb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    held = Counter(pair for _, _, _, links, _ in found for pair in links)
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [(na, nb, ng, sum(x.values()), sum(n for p, n in x.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in x.items()), sha) for na, nb, ng, x, sha in found]


TEXTS = [
    "plain words here",
    "",
    None,
    "two  spaces, a tab\t here\n\n and \n lines ",
    " leading space",
    "ends with space ",
    "<|endoftext|> and <s> <0x0A> are plain",
    "größer naïve — 東京 🙂🙂 é",
    "under▁score is no space",
    "plain words here",
    "\x00\x01 control \x1c   nbsp",
    "word  em space  x",
    "don't can't it's we'll " * 30,
    "x" * 300 + " " + "ab1" * 200,
    "a",
    " ",
    "\n",
]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def compare(rows, result):
    wanted = sorted((-1 if i is None else i, *w) for (i, _), w in zip(rows, by_definition([t for _, t in rows])))
    assert sorted((-1 if r.doc_id is None else r.doc_id, *(r[c] for c in COLUMNS)) for r in result) == wanted


def test_against_the_definition(spark):
    rows = [(None if i == 3 else i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, batch string, links int").repartition(3)
    result = cross_tokens.alignment(docs, BPE, PIECE).collect()
    compare(rows, result)
    shuffled = cross_tokens.alignment(docs, BPE, PIECE, most_pairs=3).collect()  # the joined way
    compare(rows, shuffled)


def test_small_batches_and_repeated_ids(spark):
    rows = [(7, t) for t in TEXTS if t] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    batches = cross_tokens.both_tokens(docs, BPE, PIECE, batch_chars=200)
    assert batches.count() > 5
    assert sum(len(r.docs) for r in batches.collect()) == len(rows)
    compare(rows, cross_tokens.alignment(docs, BPE, PIECE).collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert cross_tokens.alignment(docs, BPE, PIECE).collect() == []


def test_given_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    few = [r for r in rows if r[1] and len(r[1]) < 600][:40]
    docs = spark.createDataFrame(few, "doc_id long, text string")
    compare(few, cross_tokens.alignment(docs, BPE, PIECE).collect())
    assert op12_alignment(spark, small).count() == len(rows)


def test_chunks_of_one_form_are_aligned_once(spark):
    """Ends at the same bytes are handed on once; around 64 bytes, where they are told apart by other means, nothing is mixed up."""
    texts = ["was, wit. are, hat. one, two. six, ten. was, wit.", *["ab1 " * 3 + "q7" * n + "z" * (n % 3) for n in range(26, 40)], "é" * 31 + " " + "é" * 32 + " " + "xé" * 21 + " " + "ex" * 31 + "é"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for r in cross_tokens.both_tokens(docs.limit(1), BPE, PIECE).collect():
        assert (len(r.form), len(r.a_ends), len(r.b_ends)) == (8, max(r.form) + 1, max(r.form) + 1)
        assert len(r.a_ends) < len(r.form)
    compare(rows, cross_tokens.alignment(docs, BPE, PIECE).collect())


def test_batches_are_row_groups_of_their_own(spark, monkeypatch):
    """A task holds one batch when it writes and one when it reads, however many it has (a hundred and more before)."""
    paths = []
    new_path = staging.new_path
    monkeypatch.setattr(staging, "new_path", lambda s, name: paths.append((name, new_path(s, name))) or paths[-1][1])
    monkeypatch.setattr(cross_tokens, "aligned", partial(cross_tokens.aligned, batch_chars=200))
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    compare(rows, cross_tokens.alignment(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), BPE, PIECE).collect())
    files = [pq.ParquetFile(f).metadata for name, path in paths if name == "aligned" for f in glob.glob(f"{path}/*.parquet")]
    assert sum(m.num_rows for m in files) > 5
    assert {m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)} == {1}
