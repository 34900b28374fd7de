"""Secret scans: base patterns, and formats learned as probabilistic automata.

Labelled credentials are put into a prefix tree whose states carry counts. States are merged, from
the root on, when their frequencies of ending and of every next symbol, and those of their
successors, are statistically compatible (Hoeffding bound). The result is a probabilistic
deterministic automaton: a candidate's likelihood under it, against that under a background
automaton of ordinary words, says whether it has the format of a credential.
"""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgrid.llm.staging import id_text, with_long_id

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs [0-9a-f]+ of 24 characters or more
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SEPARATOR = re.compile(r"[+/_.=-]")
KINDS = ("assign", "access", "hex", "format")

# Public credential formats, as a prefix, an alphabet and lengths.
UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
FORMATS = {
    "aws_access": ("AKIA", UPPER + DIGITS, (16,)),
    "aws_session": ("ASIA", UPPER + DIGITS, (16,)),
    "github": ("ghp_", UPPER + LOWER + DIGITS, (36,)),
    "github_oauth": ("gho_", UPPER + LOWER + DIGITS, (36,)),
    "gitlab": ("glpat-", UPPER + LOWER + DIGITS + "_-", (20,)),
    "slack_bot": ("xoxb-", DIGITS + "-" + UPPER + LOWER, (40, 50)),
    "slack_user": ("xoxp-", DIGITS + "-" + UPPER + LOWER, (40, 50)),
    "stripe_live": ("sk_live_", UPPER + LOWER + DIGITS, (24, 32)),
    "stripe_test": ("sk_test_", UPPER + LOWER + DIGITS, (24, 32)),
    "google": ("AIza", UPPER + LOWER + DIGITS + "_-", (35,)),
    "package": ("npm_", UPPER + LOWER + DIGITS, (36,)),
    "jwt": ("eyJ", UPPER + LOWER + DIGITS + "_-.", (60, 90)),
    "md5": ("", DIGITS + "abcdef", (32,)),
    "sha1": ("", DIGITS + "abcdef", (40,)),
    "sha256": ("", DIGITS + "abcdef", (64,)),
}


def labelled_credentials(per_format: int = 150, seed: int = 7) -> dict[str, list[str]]:
    """Credentials drawn from the public formats, by label: the examples that the automata learn from."""
    rng = random.Random(seed)
    return {label: [prefix + "".join(rng.choices(chars, k=rng.choice(lengths))) for _ in range(per_format)] for label, (prefix, chars, lengths) in FORMATS.items()}


def ordinary_strings(n: int = 2500, seed: int = 11) -> list[str]:
    """Strings that are no credentials: pronounceable words, paths, dotted names, dates and numbers."""
    rng = random.Random(seed)

    def word() -> str:
        w = "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s", "t"]) for _ in range(rng.randint(1, 7)))
        return w.capitalize() if rng.random() < 0.2 else w

    forms = (
        lambda: word() + word() + word(),
        lambda: "/".join(word() for _ in range(rng.randint(2, 6))),
        lambda: ".".join(word() for _ in range(rng.randint(2, 5))),
        lambda: rng.choice("-_").join(word() for _ in range(rng.randint(2, 6))),
        lambda: "".join(rng.choices(DIGITS, k=rng.randint(6, 19))),
        lambda: "".join(rng.choices(DIGITS, k=rng.choice([8, 10, 13, 16, 16, 20]))),
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        lambda: rng.choice("=-_.+") * rng.randint(16, 80),
        lambda: f"{word()}.{rng.randint(0, 99)}",
        lambda: f"{word()}{rng.choice(['', '1', '27'])}.{word()}.{rng.choice(['com', 'org', 'net'])}",
        lambda: f"{word()}.{rng.randint(0, 99)}@{word()}{rng.randint(0, 99)}.{word()}.{rng.choice(['com', 'org', 'net'])}",
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}",
        lambda: f"www.{word()}.{rng.choice(['com', 'org'])}/{word()}/{rng.randint(1, 9999)}/{word()}.html",
        lambda: f"{word()}_{word()}={word()}{rng.randint(0, 999)}",
        lambda: "-".join(str(rng.randint(0, 9999)) for _ in range(rng.randint(2, 4))),
        lambda: f"{rng.randint(0, 99999)}.{rng.randint(0, 99999999)}",
    )
    return [rng.choice(forms)() for _ in range(n)]


class Automaton:
    """A probabilistic deterministic automaton learned by merging compatible states of a prefix tree."""

    def __init__(self, samples: list[str], alpha: float = 0.05, least: int = 20):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.seen = [0], [0]
        for s in samples:
            self._insert(s)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge(least)

    def _insert(self, s: str) -> None:
        at = 0
        for c in s:
            self.seen[at] += 1
            self.count[at][c] = self.count[at].get(c, 0) + 1
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.count.append({})
                self.ends.append(0)
                self.seen.append(0)
            at = self.next[at][c]
        self.seen[at] += 1
        self.ends[at] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b or not self.seen[a] or not self.seen[b]:
                continue
            if self._differ(self.ends[a], self.seen[a], self.ends[b], self.seen[b]):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), self.seen[a], self.count[b].get(c, 0), self.seen[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to the states from a on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.seen[a] += self.seen[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self, least: int) -> None:
        """Red-blue order: a blue state joins the first compatible red one or turns red; rare ones join the most alike sink."""
        red = [0]
        while True:
            kept = set(red)
            blue = sorted({(-self.seen[t], t, r, c) for r in red for c, t in self.next[r].items() if t not in kept})
            if not blue:
                break
            n, b, parent, symbol = blue[0]
            for r in red:
                # a state of few examples says too little to be split off, or to join a state that it never follows
                if (-n >= least or r == parent) and self._compatible(r, b):
                    self.next[parent][symbol] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
        number = {state: i for i, state in enumerate(red)}  # only these can still be reached
        self.next = [{c: number[t] for c, t in self.next[r].items()} for r in red]
        self.count, self.ends, self.seen = ([x[r] for r in red] for x in (self.count, self.ends, self.seen))

    def log_likelihood(self, s: str, floor: float = 1e-4) -> float:
        """Mean log probability of the symbols of s and of its end, rare symbols at ``floor``."""
        at, total = 0, 0.0
        for i, c in enumerate(s):
            if not self.seen[at] or c not in self.next[at]:
                return (total + (len(s) - i + 1) * math.log(floor)) / (len(s) + 1)
            total += math.log(max(floor, self.count[at][c] / self.seen[at]))
            at = self.next[at][c]
        return (total + math.log(max(floor, self.ends[at] / max(1, self.seen[at])))) / (len(s) + 1)

    def log_likelihoods(self, s: str, start: int, ends: set[int], floor: float = 1e-4) -> Iterator[tuple[int, float]]:
        """``end, log_likelihood(s[start:end])`` for the ends that are reached by seen symbols only."""
        at, total = 0, 0.0
        for i in range(start, len(s) + 1):
            if i in ends and i > start:
                yield i, (total + math.log(max(floor, self.ends[at] / max(1, self.seen[at])))) / (i - start + 1)
            if i == len(s) or s[i] not in self.next[at]:
                return
            total += math.log(max(floor, self.count[at][s[i]] / self.seen[at]))
            at = self.next[at][s[i]]


class FormatModel:
    """One automaton for each label, and one of ordinary strings that a candidate's likelihood is held against."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str], kept_back: int = 5, quantile: float = 0.01):
        self.ordinary = Automaton(ordinary)
        self.formats, self.least, kept = {}, {}, []
        for label, examples in credentials.items():
            own = Automaton([s for i, s in enumerate(examples) if i % kept_back])
            rest = [s for i, s in enumerate(examples) if i % kept_back == 0]
            alone = sorted(map(own.log_likelihood, rest))
            self.formats[label], self.least[label] = own, alone[int(len(alone) * quantile)] - 0.1
            kept += rest
        first = {os.path.commonprefix(examples) for examples in credentials.values()} - {""}
        self.first = re.compile("|".join(map(re.escape, sorted(first, key=len, reverse=True)))) if first else None
        scores = sorted(self.score(s) for s in kept)
        self.threshold = max(0.2, scores[int(len(scores) * quantile)])

    def score(self, s: str) -> float:
        """Log likelihood ratio a symbol of the likeliest format whose own examples are as likely; -inf if none."""
        own = {label: a.log_likelihood(s) for label, a in self.formats.items()}
        fit = [x for label, x in own.items() if x >= self.least[label]]
        return max(fit) - self.ordinary.log_likelihood(s) if fit else -math.inf

    def is_secret(self, s: str) -> bool:
        return self.score(s) >= self.threshold

    def parts(self, s: str, least: int = 16) -> list[tuple[int, int]]:
        """Ranges of s with the format of a credential, overlapping ones as one.

        They start at s, after a separator or at the first symbols of a format, and end before a separator or with s.
        """
        cuts = [m.start() for m in SEPARATOR.finditer(s)]
        starts = {0, *(c + 1 for c in cuts), *(m.start() for m in self.first.finditer(s))} if self.first else {0, *(c + 1 for c in cuts)}
        ends, found = {*cuts, len(s)}, []
        for i in sorted(starts):
            if len(s) - i < least:
                break
            fit = {j for label, a in self.formats.items() for j, x in a.log_likelihoods(s, i, ends) if j - i >= least and x >= self.least[label]}
            to = next((j for j in sorted(fit, reverse=True) if self.is_secret(s[i:j])), None)
            if to is None:
                continue
            if found and i < found[-1][1]:
                found[-1] = (found[-1][0], max(to, found[-1][1]))
            else:
                found.append((i, to))
        return found


@lru_cache(1)
def default_model() -> FormatModel:
    return FormatModel(labelled_credentials(), ordinary_strings())


def scan(text: str, model: FormatModel) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of every secret of a text, in code points, by start and then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base, at, end = sorted((a, b) for a, b, _ in found), 0, 0

    def inside(a: int, b: int) -> bool:
        """Whether a base span holds a .. b; asked with rising a, so that the spans are walked once."""
        nonlocal at, end
        while at < len(base) and base[at][0] <= a:
            at, end = at + 1, max(end, base[at][1])
        return end >= b

    for m in CANDIDATE.finditer(text):
        if inside(m.start(), m.end()):
            continue
        s = m.group()
        if model.is_secret(s.strip(".=-")):
            found.append((m.start(), m.end(), "format"))
            continue
        for i, j in model.parts(s):
            a, b = m.start() + i, m.start() + j
            if not inside(a, b):
                found.append((a, b, "format"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: FormatModel | None = None) -> DataFrame:
    """``doc_id, spans`` for every row; spans is an array of ``kind, start, end, secret``.

    Whole texts are scanned (a null text is empty, with no spans); repeated rows are returned each, a
    null id stays null; other columns are not read. Spans of the kind ``format`` are those that the
    learned automata add; they lie outside the base spans.
    """
    model = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            spans = []
            for text in rows.text:
                text = text or ""
                spans.append([{"kind": k, "start": a, "end": b, "secret": text[a:b]} for a, b, k in scan(text, model)])
            yield pd.DataFrame({"doc_id": rows.doc_id, "spans": spans})

    picked = docs.select(id_text(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_long_id(picked.mapInPandas(run, "doc_id string, spans array<struct<kind:string,start:long,end:long,secret:string>>"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash of the base spans and all spans as text, from the rows of :func:`find_secrets`."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(said(F.filter("spans", lambda s: s.kind != "format")), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )


def masked(text: str | None, model: FormatModel, mask: str = "[SECRET]") -> str | None:
    """The text with every secret (overlapping ones as one) replaced."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, _ in scan(text, model):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars", model: FormatModel | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with the secrets in the text masked and the length recounted."""
    model = model or default_model()

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(t, model) for t in texts], dtype=object)

    out = docs.withColumn(text_col, mask(F.col(text_col)))
    return out.withColumn(n_chars_col, F.length(text_col).cast("long")) if n_chars_col in docs.columns else out
