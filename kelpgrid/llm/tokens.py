"""Token ids of texts under a public tokenizer file; each distinct word of a batch is encoded once, all of them together."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: White space parts the pieces of the word tokenizer, so that runs between it can be encoded alone. Characters whose lower case and composed form do not depend on their neighbours or the library.
PLAIN_LINES = re.compile(r"[\x21-\x7EÀ-ÖØ-öø-ÿ\n]*")
#: The pieces of a lower-cased plain run.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+")
END = "\x01"  # in no plain run: stands for the end of a word


def _byte_of() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of the vocabulary in ``path``, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Where the file is a lower-casing BPE with word ends whose ids follow the order of its merges, plain chunks
    are encoded by byte ranks; every other chunk, and any other vocabulary as a whole, by the tokenizer itself.
    ``dtype`` is the narrowest type that holds every id.
    """

    def __init__(self, path: str, most: int = 50_000, batch_chars: int = 1 << 22):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else "<u4")
        self.odd: dict[str, np.ndarray] = {}
        self.most, self.batch_chars, self.ranks = most, batch_chars, self._ranks(spec)
        if self.ranks:
            self.plain = tiktoken.Encoding("plain", pat_str=rf"[^{END}\n]+{END}", mergeable_ranks=self.ranks, special_tokens={})
            self.ends = np.zeros(max(self.ranks.values()) + 1, bool)
            self.ends[[i for t, i in self.ranks.items() if t.endswith(END.encode()) and len(t) > 1]] = True

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        model, parts = spec["model"], [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or parts != ["NFC", "Replace", "Lowercase"]:
            return None
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(vocab.get("".join(p)) != 512 + i for i, p in enumerate(pairs)):
            return None
        byte_of, special = _byte_of(), {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for token, i in vocab.items():
            if token not in special:
                word = token[:-4] if token.endswith("</w>") and len(token) > 4 else token
                raw = bytes(byte_of[c] for c in word)
                if word == token and END.encode() in raw and len(raw) > 1:
                    return None
                ranks[raw + (END.encode() if word != token else b"")] = i
        return ranks

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _odd(self, chunk: str) -> np.ndarray:
        if len(self.odd) >= self.most:
            self.odd.clear()
        if chunk not in self.odd:
            self.odd[chunk] = self._whole(chunk)
        return self.odd[chunk]

    def _plain(self, lines: str, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain chunks, a line each, and where those of each end."""
        joined = PIECE.sub(rf"\g<0>{END}", lines.lower()) + "\n"
        marks = np.frombuffer(joined.encode("latin-1"), np.uint8)
        pieces = np.cumsum(marks == ord(END))[marks == ord("\n")]  # up to the end of each chunk
        ids = np.array(self.plain.encode_ordinary(joined), np.int32)
        return ids.astype(self.dtype), np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])[pieces[:count]]

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct chunks, one after the other in some order, and where those of each start and how many there are."""
        lines = "\n".join(chunks.to_numpy(zero_copy_only=False))
        if PLAIN_LINES.fullmatch(lines) and "<|" not in lines:
            ids, ends = self._plain(lines, len(chunks))
            sizes = np.diff(ends, prepend=0)
            return ids, ends - sizes, sizes
        every = lines.split("\n")
        at = np.array([i for i, c in enumerate(every) if PLAIN_LINES.fullmatch(c) and "<|" not in c], np.int64)
        ids, ends = self._plain("\n".join([every[i] for i in at.tolist()]), len(at))
        starts, sizes, found, total = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64), [ids], len(ids)
        sizes[at] = np.diff(ends, prepend=0)
        starts[at] = ends - sizes[at]
        for i in np.setdiff1d(np.arange(len(every)), at).tolist():
            ids = self._odd(every[i])
            starts[i], sizes[i] = total, len(ids)
            total += len(ids)
            found.append(ids)
        return np.concatenate(found), starts, sizes

    def _batch(self, texts: list[str]) -> Iterator[bytes]:
        # Arrow's Unicode white space is what the tokenizer drops, but for U+001C-1F, which it keeps
        kept = any(c in t for t in texts for c in "\x1c\x1d\x1e\x1f")
        words = (pc.ascii_split_whitespace if kept else pc.utf8_split_whitespace)(pa.array(texts, pa.large_string()))
        coded = words.flatten().dictionary_encode()
        ids, starts, sizes = self._chunks(coded.dictionary)
        which = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        shift = (starts[which] - ends[:-1]).astype(np.int32 if len(ids) + ends[-1] < 1 << 31 else np.int64)
        out = np.repeat(shift, sizes[which])
        out += np.arange(ends[-1], dtype=out.dtype)
        out = ids[out]
        bounds = ends[words.offsets.to_numpy()]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield out[a:b].tobytes()

    def encoded(self, texts: Sequence[str | None]) -> Iterator[bytes]:
        """The ids of each whole text, as bytes of ``dtype``; none for null and empty texts."""
        if not self.ranks:
            yield from (self._whole(t or "").tobytes() for t in texts)
            return
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= self.batch_chars:
                yield from self._batch(held)
                held, size = [], 0
        if held:
            yield from self._batch(held)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of one whole text."""
        return np.frombuffer(next(self.encoded([text])), self.dtype)


@lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process."""
    return WordTokenizer(path)
