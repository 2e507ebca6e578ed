"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts for each language and n-gram bucket are summed by Spark over all training rows. The matrix of log
probabilities (languages x BUCKETS floats, a fixed number of buckets) is broadcast; each text is scored from
its sparse bucket counts in numpy.

Defined cases: a text that is null or has no letter is `und` with score 0; rows without lang, with a null or a
held-out id teach nothing; without any training row every text is `und`; other columns are ignored by the query and pass through the stage,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import free_name, held_out, small_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages of which one task holds counts at once; more only means more partial rows.
HELD_LANGUAGES = 64
#: Characters of one text that are hashed at a time; all are.
CHUNK = 1 << 18
UND = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _codes(text: str | None) -> np.ndarray | None:
    """Lower-case code points with 32 for all that is no letter; None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    return np.where(letter, codes, np.uint32(32)) if letter.any() else None


def sparse_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the n-grams of one text, padded with blanks; None without letters."""
    codes = _codes(text)
    if codes is None:
        return None
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for begin in range(0, len(codes), CHUNK):
        part = codes[begin : begin + CHUNK + max(ORDERS) - 1]
        for n in ORDERS:
            m = min(CHUNK, len(part) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            blank = np.ones(m, bool)
            for k in range(n):
                c = part[k : k + m]
                h = (h * np.uint32(0x01000193)) ^ c
                blank &= c == 32
            h = (h * np.uint32(0x9E3779B1)) >> shift
            total += np.bincount(h[~blank], minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}

    def flush() -> Iterator[pd.DataFrame]:
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(v[at], docs[lang])})

    for b in batches:
        for text, lang in zip(b["text"], b["lang"], strict=True):
            found = sparse_counts(text)
            if found is None:
                continue
            if lang not in sums:
                if len(sums) >= HELD_LANGUAGES:
                    yield from flush()
                    sums, docs = {}, {}
                sums[lang], docs[lang] = np.zeros(BUCKETS, np.int64), 0
            sums[lang][found[0]] += found[1]
            docs[lang] += 1
    yield from flush()


def train(rows: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """rows: text and lang. Languages in code-point order, log priors, log probabilities (buckets, languages)."""
    small_batches(rows.sparkSession)
    sums = rows.select("text", "lang").filter("lang is not null").mapInPandas(_count, "lang string, bucket int, n bigint")
    found = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts, docs = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        docs[k] = own.loc[own["bucket"] < 0, "n"].sum()
        own = own[own["bucket"] >= 0]
        counts[own["bucket"].to_numpy(), k] = own["n"]
    counts += smoothing
    return langs, np.log(docs / max(1, docs.sum())), np.log(counts / counts.sum(0))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text", out: str = "__language") -> DataFrame:
    """docs with a column struct<lang_pred, score> (score: posterior probability); other columns stay as they are."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model[0], model[1], model[2]))

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        langs, prior, logp = shared.value
        names, scores = [], []
        for t in texts:
            found = sparse_counts(t) if langs else None
            if found is None:
                names.append(UND)
                scores.append(0.0)
                continue
            z = prior + found[1] @ logp[found[0]]
            p = np.exp(z - z.max())
            best = int(p.argmax())
            names.append(langs[best])
            scores.append(float(p[best] / p.sum()))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn(out, score(F.col(text_col)))


def learn_from_documents(docs: DataFrame):
    """The model of all documents whose id is not held out and whose lang is known."""
    return train(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, learn_from_documents(docs)).select("doc_id", "held_out", "__language.*")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents with a letter whose best language is likelier than all others together."""
    out = free_name(docs, "__language")
    known = predict(docs, learn_from_documents(docs), out=out)
    return known.filter((F.col(f"{out}.lang_pred") != UND) & (F.col(f"{out}.score") >= least)).select(*docs.columns)
