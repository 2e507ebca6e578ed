"""Secret scanning: fixed patterns, and a guess-cost model of values in credential contexts.

Base spans are those of three fixed patterns. A further span, of kind `guess`, is a value in a credential context (whether
or not a base span holds it) that an attacker would not guess soon: dynamic programming over the value finds its
cheapest segmentation into words, dates, repeats, keyboard walks and brute-force spans, and values whose log10 of
guesses is at least HARD are reported. Words are ranked: the commonest passwords, then the words of public vocabularies
in the order of their ids, so ordinary words are cheap. A context is a name that ends in a credential word, a colon,
an equals sign or `is`, and a value; after `is` a value of letters alone is prose.

The words (a fixed number) are read on the driver and broadcast. A value takes memory in proportion to its length.

Defined cases: a null text is empty; values of any length are scored whole, repeats of any length are one piece; an
empty table gives an empty table; repeated rows are separate rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import small_batches

TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")
VOCABULARIES = (f"{TOKENIZERS}/word_bpe_49k.json", f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "guess")

#: Long credential words may end any name; short ones begin at a word, an underscore or a change of case.
_LONG = "password|passwd|passphrase|passcode|secret|token|credentials?|api_?key|access_?key|private_?key|auth_?key"
_SHORT = "pass|pwd|pin|key"
CONTEXT = re.compile(rf"""(?:(?i:{_LONG})|(?<![A-Za-z])(?i:{_SHORT})|(?<=[a-z])(?:Pass|Pwd|Pin|Key))["']?\x20*(=>|[:=]|\bis\b)\x20*["']?([^\s"'<>,;]+)""", re.A)
CONTEXT_HINT = re.compile(r"pass|pwd|pin|secret|token|credential|key", re.I | re.A)
LEAST_GUESS = 8
#: log10 of the guesses from which a value counts as a secret.
HARD = 10.0
#: Values up to this long are remembered by a task.
REMEMBERED_CHARS, REMEMBERED = 128, 1 << 14

# What passwords are most often made of, likeliest first.
COMMON = """password admin welcome letmein login master dragon monkey qwerty shadow sunshine princess football baseball
secret superman batman trustno hello freedom whatever summer winter spring autumn love test guest root user
changeme default example access system server database token""".split()
# Rows of keyboards, and of the alphabet and digits, along which walks go.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm", "qwertzuiop", "azertyuiop")
LEET = str.maketrans("@430157$!", "aaeoistsi")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d")
LEAST_WORD, LEAST_WALK = 3, 3
#: Longest period of a repeat; its number of repetitions is not bounded.
PERIODS = 64
#: Another piece doubles the guesses.
LINK = math.log10(2)


def ranked_words(vocabularies: tuple[str, ...] = VOCABULARIES) -> dict[str, int]:
    """Lower-case words and their ranks from 1: COMMON, then the whole words of the vocabularies by their ids."""
    out = {w: k + 1 for k, w in enumerate(COMMON)}
    for path in vocabularies:
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                ids = json.load(f)["model"]["vocab"]
            words = [(i, w.removesuffix("</w>")) for w, i in ids.items() if w.endswith("</w>")]
        else:
            with open(path, "rb") as f:
                lines = [line.split() for line in f if line.strip()]
            words = [(int(i), base64.b64decode(w).decode("utf-8", "replace").strip().lower()) for w, i in lines]
        for i, w in sorted(words):
            if len(w) >= LEAST_WORD and w.isalpha():
                out[w] = min(out.get(w, 1 << 30), len(COMMON) + i + 1)
    return out


def class_size(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33


def _periodic(low: str) -> list[tuple[int, int, int]]:
    """(begin, end, period) of all maximal runs that repeat a period at least three times, or twice over six characters."""
    codes, out = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32), []
    for p in range(1, min(PERIODS, len(low) // 2) + 1):
        same = np.concatenate([[False], codes[p:] == codes[:-p], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if j - i >= 2 * p or (j - i >= p and j + p - i >= 6):
                out.append((i, j + p, p))
    return out


class Guesser:
    """Scores values with ranked words."""

    def __init__(self, rank: dict[str, int]):
        self.rank = rank
        self.prefixes = {w[:k] for w in rank for k in range(1, len(w))}
        self.known: dict[str, float] = {}

    def pieces(self, value: str, low: str, plain: str, i: int) -> Iterator[tuple[int, float]]:
        """(end, log10 guesses) of words, dates and walks of value that begin at i."""
        n = len(value)
        for form, factor in ((low, 1), (plain, 2)) if plain[i : i + 32] != low[i : i + 32] else ((low, 1),):
            j = i + 1
            while j <= n:
                part = form[i:j]
                if (k := self.rank.get(part)) is not None:
                    yield j, math.log10(2 * k * factor * (1 if value[i:j].islower() else 2))
                if part not in self.prefixes:
                    break
                j += 1
        if low[i].isdigit() and (m := DATE.match(value, i)):
            yield m.end(), math.log10(365 * 120 if m.end() - i > 4 else 120)
        for row in WALKS:
            at = row.find(low[i])
            for step in (1, -1) if at >= 0 else ():
                k, p = i + 1, at + step
                while k < n and 0 <= p < len(row) and low[k] == row[p]:
                    k, p = k + 1, p + step
                    if k - i >= LEAST_WALK:
                        yield k, math.log10(len(WALKS) * len(row) * 2 * (k - i))

    def cost(self, value: str) -> float:
        """log10 of the guesses for the cheapest segmentation: costs of pieces add up, and so does a link for each further
        piece. A brute-force span costs the classes of its characters, a repeat its period and its count."""
        n, low = len(value), value.lower()
        if len(low) != n:  # some capitals have longer small letters
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = low.translate(LEET)
        chars = {c: math.log10(class_size(c)) for c in set(value)}
        runs: dict[int, list[tuple[int, float]]] = {}
        for i, j, p in _periodic(low):
            runs.setdefault(i, []).append((j, sum(chars[c] for c in value[i : i + p]) + math.log10((j - i) / p)))
        best = [math.inf] * (n + 1)
        best[0] = 0.0
        brute = math.inf  # cheapest segmentation whose last piece is a brute-force span that ends here
        for i in range(n):
            base = best[i] + (LINK if i else 0)
            for j, c in self.pieces(value, low, plain, i):
                if base + c < best[j]:
                    best[j] = base + c
            for j, c in runs.pop(i, ()):
                if base + c < best[j]:
                    best[j] = base + c
            brute = min(brute, base) + chars[value[i]]
            if brute < best[i + 1]:
                best[i + 1] = brute
        return best[n]

    def hard(self, value: str) -> bool:
        if len(value) > REMEMBERED_CHARS:
            return self.cost(value) >= HARD
        if value not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[value] = self.cost(value)
        return self.known[value] >= HARD


def spans_of(text: str | None, guesser: Guesser) -> list[tuple[int, int, str]]:
    """(begin, end, kind), ends exclusive, in code points, by begin, then kind as listed, then end."""
    text = text or ""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if CONTEXT_HINT.search(text):
        for m in CONTEXT.finditer(text):
            value = m[2].rstrip(".)]}!?")
            if len(value) >= LEAST_GUESS and not (m[1] == "is" and value.isalpha()) and guesser.hard(value):
                out.append((m.start(2), m.start(2) + len(value), "guess"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_guessers: dict[str, Guesser] = {}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """The id and its spans array<struct<begin, stop, kind, value>> for every row."""
    small_batches(docs.sparkSession)
    words = ranked_words(vocabularies)
    name = hashlib.sha256(json.dumps(words).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _guessers:  # one for each worker
            _guessers[name] = Guesser(shared.value)
        own = _guessers[name]
        for b in batches:
            found = [[{"begin": i, "stop": j, "kind": k, "value": t[i:j]} for i, j, k in spans_of(t, own)] for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "spans": found}).astype({"id": "Int64"})

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id bigint, spans array<struct<begin:int, stop:int, kind:string, value:string>>").withColumnRenamed("id", id_col)


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256 and spans of every document."""
    found = scan(docs)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
