"""Quality rules: plain word rules, and the fertility of a text under public tokenizer vocabularies.

The vocabularies (files, a parameter) are read on the driver and broadcast: they are of fixed size. Each whole text is
tokenised with each; characters per token, the share of byte-fallback tokens (white space apart) and the evenness of its
tokens (their entropy over the most that as many distinct tokens allow, so that it does not fall with length) are
measured. Bands are fitted to all documents that pass the base rules: for each language, and for each main script for
texts without a language or whose language has under LEAST_GROUP documents, the median of a measure and on either side
SPREAD times the distance from it to the decile, as a normal spread. Texts of few tokens scatter more, so the distance
grows as their number falls below the group's median. Too many or too few characters per token, too large a fallback
share or too little evenness reject a text; the column `reasons` tells which, under which vocabulary.

Defined cases: a null or blank text has no words and fails the base rules; groups under LEAST_GROUP documents have no
bands and reject nothing; repeated rows are separate rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import saved, small_batches

if TYPE_CHECKING:
    import sentencepiece

TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")
#: SentencePiece models and tiktoken rank files.
VOCABULARIES = (f"{TOKENIZERS}/piece_bpe_32k.model", f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
#: How rank files cut words: the pattern that belongs to them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPREAD = 6.0
LEAST_GROUP = 64
#: Least spread of log characters per token, fallback share and evenness: what rounding and chance alone give.
LEAST_SPREAD = (0.02, 0.005, 0.02)
#: Groups up to which bands are broadcast.
FEW_GROUPS = 10_000
MEASURES = ("chars", "fallback", "evenness")
BLANK = "\u2581"  # how SentencePiece writes a blank
# Fixed values of the contract's base rules.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: First code points of ranges and the script that they belong to; None: none, like digits and punctuation.
RANGES = [(0, None), (0x41, "Latin"), (0x5B, None), (0x61, "Latin"), (0x7B, None), (0xC0, "Latin"), (0x250, None), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, None), (0x900, "Indic"), (0xE00, "Thai"), (0xE80, None), (0x1100, "Hangul"), (0x1200, None), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, None), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, None), (0xAC00, "Hangul"), (0xD7A4, None), (0xF900, "Han"), (0xFB00, None), (0x20000, "Han"), (0x32000, None)]
_STARTS = np.array([r[0] for r in RANGES])
_SCRIPTS = sorted({r[1] for r in RANGES if r[1]})
_OF = np.array([_SCRIPTS.index(r[1]) if r[1] else len(_SCRIPTS) for r in RANGES])


def main_script(text: str) -> str | None:
    """The script of most characters; None without letters of a known one."""
    if text.isascii():
        return "Latin" if any(c.isalpha() for c in text) else None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(_OF[np.searchsorted(_STARTS, codes, "right") - 1], minlength=len(_SCRIPTS) + 1)[:-1]
    return _SCRIPTS[int(n.argmax())] if n.any() else None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more in the list."""
    if len(words) <= window:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    m = len(words) - window + 1
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for k in range(window):
            h = (h ^ ids[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not twice.size:
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    exact = Counter(tuple(words[i : i + window]) for i in at.tolist())  # equal hashes need not mean equal windows
    cover = np.zeros(len(words) + 1, np.int64)
    for i in at.tolist():
        if exact[tuple(words[i : i + window])] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: blank and 9 to 13 only
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


class Vocabulary:
    """A tokenizer of either kind, and which of its tokens are pieces of characters."""

    def __init__(self, name: str, data: bytes):
        if name.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_proto=data)
            spaces = {f"<0x{ord(c):02X}>" for c in SPACES}
            self.fallback = np.array([own.is_byte(i) and own.id_to_piece(i) not in spaces for i in range(own.get_piece_size())])
            plain = _as_ranks(data, own)
            self.encode = lambda text: plain(text) or own.encode(text, num_threads=1)
        else:
            import tiktoken

            ranks = {base64.b64decode(w): int(i) for w, i in (line.split() for line in data.splitlines() if line.strip())}
            self.fallback = np.zeros(max(ranks.values()) + 1, bool)
            self.fallback[[i for w, i in ranks.items() if "\ufffd" in w.decode("utf-8", "replace")]] = True
            self.encode = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _as_ranks(data: bytes, own: sentencepiece.SentencePieceProcessor) -> Callable[[str], list[int] | None]:
    """The ids of a text whose characters have pieces of one or two bytes, by the same merges as ranks of the other library,
    which is faster: each joins two symbols to the piece of the best score. None for other texts, for those with a piece
    whose score another one shares (runs of blanks), and for all of them if
    the model does more than such merges, or if a piece could span words or would not come out of its own text."""
    import tiktoken
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(data)
    norm, kind = model.normalizer_spec, pb.ModelProto.SentencePiece
    pieces = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
    merged = sorted((p for p in pieces if len(p) > 1), key=lambda p: -pieces[p][0])
    words = [p for p in merged if p.startswith(BLANK)]
    as_it_is = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    merges = model.trainer_spec.model_type == pb.TrainerSpec.BPE and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix
    known = not any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces) and set("".join(merged)) <= pieces.keys()
    apart = not any(BLANK in p.lstrip(BLANK) for p in merged)
    if not (as_it_is and merges and known and apart) or own.encode([p[1:] for p in words], num_threads=1) != [[pieces[p][1]] for p in words]:
        return lambda text: None
    scores = Counter(pieces[p][0] for p in merged)
    tied = [p.replace(BLANK, " ") for p in merged if scores[pieces[p][0]] > 1]
    tied = [p for p in tied if not any(q in p for q in tied if q != p)]  # the others hold one of these
    two = [c for c in pieces if len(c.encode()) == 2 and len(c) == 1]
    tokens = [(c.encode(), pieces[c][1]) for c in two]  # characters come before all merges
    tokens += [(p.replace(BLANK, " ").encode(), pieces[p][1]) for p in merged]
    single = {b: chr(b).replace(" ", BLANK) for b in range(128)}
    tokens += [(bytes([b]), pieces[single[b]][1] if single.get(b) in pieces else own.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
    ranks = {token: k for k, (token, _) in enumerate(tokens)}
    encode = tiktoken.Encoding("merges", pat_str=" *[^ ]+| +", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    other, ids = re.compile(f"[^\\x00-\\x7f{re.escape(''.join(two))}]"), [i for _, i in tokens]

    def plain(text: str) -> list[int] | None:
        text = text and f" {text}"
        if not text or any(p in text for p in tied) or not text.isascii() and other.search(text):
            return None
        return [ids[k] for k in encode(text)]

    return plain


def fertility(text: str, ids: list[int], fallback: np.ndarray) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte-fallback share, evenness (0 for a single distinct token)."""
    if not ids:
        return 0, 0.0, 0.0, 0.0
    at = np.sort(np.array(ids))
    n = np.diff(np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]))
    p = n / n.sum()
    even = -(p * np.log2(p)).sum() / np.log2(len(n)) if len(n) > 1 else 0.0
    return len(ids), len(text) / len(ids), float(fallback[at].mean()), float(even)


_vocabularies: dict[str, list[Vocabulary]] = {}
MEASURED = "id bigint, lang string, script string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, fertility array<struct<tokens:bigint, chars:double, fallback:double, evenness:double>>"


def measured(docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """id, lang, script, base counts and fertility under each vocabulary of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    files = []
    for path in vocabularies:
        with open(path, "rb") as f:
            files.append((os.path.basename(path), f.read()))
    name = hashlib.sha256(b"".join(data for _, data in files)).hexdigest()
    shared = spark.sparkContext.broadcast(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _vocabularies:  # once for each worker
            _vocabularies[name] = [Vocabulary(*f) for f in shared.value]
        for b in batches:
            rows = []
            for i, lang, t in zip(b["id"], b["lang"], b["text"], strict=True):
                t = t or ""
                n, chars, symbols, dup, repeat = base_counts(t)
                failed = n < LEAST_WORDS or 100 * repeat > MOST_REPEATED * n
                found = [fertility(t, v.encode(t), v.fallback) for v in _vocabularies[name]]
                rows.append((i, lang, main_script(t), n, chars, symbols, dup, repeat, failed, [dict(zip(("tokens", *MEASURES), x, strict=True)) for x in found]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURED.split(", ")[:9]] + ["fertility"]).astype({"id": "Int64"})

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), lang.alias("lang"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, MEASURED)


def _measure(v: int, m: str) -> Column:
    x = F.col("fertility")[v][m]
    return F.round(F.log(F.greatest(x, F.lit(0.01))) if m == "chars" else x, 3)


def bands(known: DataFrame, vocabularies: int) -> DataFrame:
    """group, and for each vocabulary v and measure m the deciles and median m_v, and tokens_v, the median of log2 of the
    tokens. Values are rounded, so that a group's counts take bounded memory."""
    keys = F.array(F.concat(F.lit("lang:"), F.col("lang")), F.concat(F.lit("script:"), F.coalesce("script", F.lit(""))))
    rows = known.filter("not base_failed").withColumn("group", F.explode(F.filter(keys, lambda k: k.isNotNull())))
    aggs = [F.percentile(_measure(v, m), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias(f"{m}_{v}") for v in range(vocabularies) for m in MEASURES]
    aggs += [F.percentile(F.round(F.log2(F.greatest(F.col("fertility")[v]["tokens"], F.lit(1))), 1), F.lit(0.5)).alias(f"tokens_{v}") for v in range(vocabularies)]
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("documents"), *aggs).filter(F.col("documents") >= LEAST_GROUP).drop("documents")


def _reasons(names: list[str], spread: float) -> Column:
    """Names of the measures out of their bands, comma-joined."""
    told = []
    for v, name in enumerate(names):
        tokens = F.greatest(F.col("fertility")[v]["tokens"], F.lit(1))
        wide = F.sqrt((1 + F.pow(F.lit(2.0), F.col(f"tokens_{v}")) / tokens) / 2) * spread / 1.2816  # deciles of a normal lie at 1.2816
        for m, least in zip(MEASURES, LEAST_SPREAD, strict=True):
            at, x = F.col(f"{m}_{v}"), _measure(v, m)
            side = lambda d, least=least: F.greatest(d, F.lit(least * 1.2816)) * wide  # noqa: B023, E731
            low, high = x < at[1] - side(at[1] - at[0]), x > at[1] + side(at[2] - at[1])
            out = low | high if m == "chars" else high if m == "fallback" else low
            told.append(F.when(out, F.lit(f"{m}:{name}")))
    return F.concat_ws(",", *told)


def quality(docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", spread: float = SPREAD) -> DataFrame:
    """The id, base counts and verdict, and the fertility figures of every row."""
    known = saved(measured(docs, vocabularies, id_col, text_col, lang_col))
    found = saved(bands(known, len(vocabularies)))
    few = F.broadcast if found.count() <= FEW_GROUPS else lambda df: df
    sides = {k: found.select(F.col("group").alias(f"{k}_group"), *[F.col(c).alias(f"{k}_{c}") for c in found.columns[1:]]) for k in ("lang", "script")}
    rows = known.join(few(sides["lang"]), F.concat(F.lit("lang:"), F.col("lang")) == F.col("lang_group"), "left")
    rows = rows.join(few(sides["script"]), F.concat(F.lit("script:"), F.coalesce("script", F.lit(""))) == F.col("script_group"), "left")
    rows = rows.select(*known.columns, *[F.coalesce(f"lang_{c}", f"script_{c}").alias(c) for c in found.columns[1:]])
    names = [os.path.basename(p).split(".")[0] for p in vocabularies]
    rows = rows.withColumn("reasons", F.when(F.col("base_failed"), F.lit("base")).otherwise(_reasons(names, spread)))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select(F.col("id").alias(id_col), *counts, (F.col("reasons") == "").alias("kept"), "reasons", "fertility")
