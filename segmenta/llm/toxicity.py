"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input is its log odds among toxic texts (a hashed table), a learned embedding of its hash, and the mean of learned
embeddings of its character trigrams. The network reads windows of WINDOW words that start every STRIDE words, so
all words lie in two windows; a text's score is that of its likeliest window, and every window is scored.

The network is fitted on the driver to at most SAMPLE labelled texts of each class (least hashes of the ids), none of
them held out. A text's label belongs to its likeliest window: rounds of scoring all windows and of training
on the chosen ones take turns. The scores are then calibrated on a fifth of the sample. Log odds that a text is trained with come from the other half of the sample.

Defined cases: a text without a word (null included) scores 0; without both classes among the labels every text scores
0; labels of repeated ids count once, toxic if any is, and of a repeated id's texts the least in code-point order is
trained with; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import held_out, small_batches

WINDOW, STRIDE = 24, 12
SAMPLE = 2500
THRESHOLD = 0.7
ODDS_BITS, WORD_BITS, GRAM_BITS = 20, 15, 12
WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 7, 8, 12, 8
ROUNDS, BATCH, RATE = 6, 128, 0.01
#: Least portions of a round: few texts are gone through several times.
STEPS = 24
#: Words whose gate inputs a worker remembers, and windows that run side by side.
REMEMBERED = 1 << 17
SIDE_BY_SIDE = 1024

TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of <word> for all words, and how many each has."""
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = ((codes[:-2] * np.uint32(0x01000193) ^ codes[1:-1]) * np.uint32(0x01000193) ^ codes[2:]) * np.uint32(0x9E3779B1)
    begin = np.cumsum(n + 2) - (n + 2)
    at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
    return (h[at] >> np.uint32(32 - GRAM_BITS)).astype(np.int64), n


def window_starts(n: int) -> range:
    return range(0, max(1, n - STRIDE), STRIDE)


def windows_of(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids (windows, WINDOW), padded with 0, and the text of each window."""
    starts = [np.array(window_starts(len(i))) for i in ids]
    n = np.array([len(s) for s in starts])
    flat = np.concatenate([*ids, np.zeros(0, np.int64)])
    base = np.cumsum([len(i) for i in ids]) - [len(i) for i in ids]
    begin = np.concatenate(starts) + np.repeat(base, n)
    stop = np.repeat(base + [len(i) for i in ids], n)
    at = begin[:, None] + np.arange(WINDOW)
    return np.where(at < stop[:, None], flat[np.minimum(at, len(flat) - 1)], 0), np.repeat(np.arange(len(ids)), n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Net:
    """Parameters by name, forward and backward."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = 1 + WORD_DIM + GRAM_DIM
        norm = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {"words": norm(1 << WORD_BITS, WORD_DIM, k=0.05), "grams": norm(1 << GRAM_BITS, GRAM_DIM, k=0.1)}
        for way in "fb":
            self.p[f"W{way}"] = norm(d, 3 * HIDDEN, k=1 / math.sqrt(d))
            self.p[f"b{way}"] = np.zeros(3 * HIDDEN, np.float32)
            self.p[f"U{way}"] = norm(HIDDEN, 3 * HIDDEN, k=1 / math.sqrt(HIDDEN))
        self.p |= {"A": norm(2 * HIDDEN, ATTEND, k=1 / math.sqrt(2 * HIDDEN)), "v": norm(ATTEND), "o": norm(2 * HIDDEN, k=0.3), "c": np.zeros(1, np.float32)}
        self.odds = np.zeros(1 << ODDS_BITS, np.float32)
        self.slope, self.shift = 1.0, 0.0  # from the likeliest window's logit to the text's

    def inputs(self, words: list[str], odds: np.ndarray | None = None) -> np.ndarray:
        """(words, features)."""
        if not words:
            return np.zeros((0, 1 + WORD_DIM + GRAM_DIM), np.float32)
        h = np.fromiter(map(word_hash, words), np.int64, len(words))
        rows, n = gram_rows(words)
        grams = np.add.reduceat(self.p["grams"][rows], np.cumsum(n) - n) / n[:, None]
        table = self.odds if odds is None else odds
        return np.concatenate([table[h & ((1 << ODDS_BITS) - 1), None], self.p["words"][h & ((1 << WORD_BITS) - 1)], grams], 1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What a word adds to the gates of both ways; its update gate shut for the padding row."""
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], 1)

    def run(self, gate: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """gate: (time, batch, 6 hidden), mask: (time, batch). Logits; keep gets what backward needs."""
        steps, n, _ = gate.shape
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        for way, order, base in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), 3 * HIDDEN)):
            u, h = self.p[f"U{way}"], np.zeros((n, HIDDEN), np.float32)
            for t in order:
                g, a = gate[t, :, base : base + 3 * HIDDEN], h @ u
                zr = sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                z[~mask[t]] = 1
                new = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
                if keep is not None:
                    keep.append((way, t, h, z, r, new, a[:, 2 * HIDDEN :]))
                h = new + z * (h - new)
                states[t, :, base // 3 : base // 3 + HIDDEN] = h
        look = np.tanh(states @ self.p["A"])
        weight = look @ self.p["v"]
        weight[~mask] = -1e9
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        value = states @ self.p["o"]
        if keep is not None:
            keep.append((states, look, weight, value))
        return (weight * value).sum(0) + self.p["c"]

    def backward(self, keep: list, mask: np.ndarray, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the shared parameters, and of the gate inputs."""
        states, look, weight, value = keep.pop()
        grad = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("words", "grams")}
        grad["c"][0] = dlogit.sum()
        dweight = value * dlogit
        grad["o"] = np.einsum("tn,tnh->h", weight * dlogit, states)
        dscore = weight * (dweight - (weight * dweight).sum(0))
        grad["v"] = np.einsum("tn,tna->a", dscore, look)
        dlook = dscore[..., None] * self.p["v"] * (1 - look**2)
        grad["A"] = np.einsum("tnh,tna->ha", states, dlook)
        dstates = (weight * dlogit)[..., None] * self.p["o"] + dlook @ self.p["A"].T
        dgate = np.zeros((*mask.shape, 6 * HIDDEN), np.float32)
        dh, last = None, None
        for way, t, h, z, r, new, an in reversed(keep):
            base = 0 if way == "f" else 3 * HIDDEN
            if way != last:
                dh, last = np.zeros_like(h), way
            dh = dh + dstates[t, :, base // 3 : base // 3 + HIDDEN]
            dnew = dh * (1 - z) * (1 - new**2)
            dz = dh * (h - new) * z * (1 - z) * mask[t][:, None]
            dr = dnew * an * r * (1 - r)
            dgate[t, :, base : base + 3 * HIDDEN] = np.concatenate([dz, dr, dnew], 1)
            da = np.concatenate([dz, dr, dnew * r], 1)
            grad[f"U{way}"] += h.T @ da
            dh = dh * z + da @ self.p[f"U{way}"].T
        return grad, dgate

    def gradients(self, words: list[str], odds: np.ndarray, at: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of windows at (windows, WINDOW) of indexes into words, from 1; 0 is padding."""
        used, of = np.unique(at, return_inverse=True)
        of = of.reshape(at.shape)
        some = [words[i - 1] for i in used.tolist() if i]
        x = np.zeros((len(used), 1 + WORD_DIM + GRAM_DIM), np.float32)
        x[len(used) - len(some) :] = self.inputs(some, odds)
        mask, keep = (at != 0).T.copy(), []
        p = sigmoid(self.run(self.gates(x)[of.T], mask, keep).astype(np.float64))
        dlogit = ((p - label) / len(label)).astype(np.float32)
        grad, dgate = self.backward(keep, mask, dlogit)
        dg = np.zeros((len(used), 6 * HIDDEN), np.float32)
        np.add.at(dg, of.T.ravel(), dgate.reshape(-1, 6 * HIDDEN))
        dx = np.zeros_like(x)
        for way, base in (("f", 0), ("b", 3 * HIDDEN)):
            part = dg[:, base : base + 3 * HIDDEN]
            grad[f"W{way}"], grad[f"b{way}"] = x.T @ part, part.sum(0)
            dx += part @ self.p[f"W{way}"].T
        dx = dx[len(used) - len(some) :]
        grad["words"], grad["grams"] = np.zeros_like(self.p["words"]), np.zeros_like(self.p["grams"])
        if some:
            h = np.fromiter(map(word_hash, some), np.int64, len(some))
            np.add.at(grad["words"], h & ((1 << WORD_BITS) - 1), dx[:, 1 : 1 + WORD_DIM])
            rows, n = gram_rows(some)
            np.add.at(grad["grams"], rows, np.repeat(dx[:, 1 + WORD_DIM :] / n[:, None], n, 0))
        loss = -float(np.mean(np.where(label > 0, np.log(p + 1e-12), np.log(1 - p + 1e-12))))
        return loss, grad


def log_odds(texts: list[list[str]], label: np.ndarray) -> np.ndarray:
    """Shrunken log odds of toxicity of texts that have a word, by word hash; 0 for words of a single text."""
    seen = np.zeros((2, 1 << ODDS_BITS), np.float32)
    for words, y in zip(texts, label, strict=True):
        seen[int(y), np.unique(np.fromiter((word_hash(w) for w in set(words)), np.int64)) & ((1 << ODDS_BITS) - 1)] += 1
    n = np.array([max(1, (label == 0).sum()), max(1, (label == 1).sum())], np.float32)
    base = n[1] / n.sum()
    rate = (seen[1] / n[1] + 0.5 / n[1]) / (seen[0] / n[0] + 0.5 / n[1])
    both = seen.sum(0)
    # how far the count of toxic texts is from what chance gives, in standard deviations, tells how far to trust it
    sure = np.abs(seen[1] - both * base) / np.sqrt(both * base * (1 - base) + 1e-6)
    out = np.log(rate) * np.clip((sure - 2) / 4, 0, 1)
    return np.where(both > 1, np.clip(out, -3, 5), 0).astype(np.float32)


def fit(texts: list[str], label: list[int], rounds: int = ROUNDS, seed: int = 7) -> Net | None:
    """The network for those texts; None if they have but one class."""
    cut = [tokens(t) for t in texts]
    some = [k for k, w in enumerate(cut) if w]
    cut, y = [cut[k] for k in some], np.array([label[k] for k in some])
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    net = Net(seed)
    net.odds = log_odds(cut, y)
    half = rng.permutation(len(cut)) % 2
    other = [log_odds([cut[k] for k in np.flatnonzero(half != s)], y[half != s]) for s in (0, 1)]
    place: dict[str, int] = {}
    words: list[str] = []
    ids = []
    for w in cut:
        for x in w:
            if x not in place:
                words.append(x)
                place[x] = len(words)
        ids.append(np.array([place[x] for x in w]))
    at, of = windows_of(ids)
    hashes = np.fromiter(map(word_hash, words), np.int64, len(words)) & ((1 << ODDS_BITS) - 1)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for k in range(rounds):
        score = np.empty(len(at), np.float32)
        for s in (0, 1):
            own = np.flatnonzero(half[of] == s)
            if k == 0:  # the windows whose words are most telling
                known = np.r_[np.float32(0), other[s][hashes]]
                score[own] = known[at[own]].sum(1)
            else:
                x = np.concatenate([np.zeros((1, 1 + WORD_DIM + GRAM_DIM), np.float32), net.inputs(words, other[s])])
                score[own] = window_logits(net, net.gates(x), at[own])
        best = np.array([i + int(score[i:j].argmax()) for i, j in zip(first, [*first[1:], len(at)], strict=True)])
        calm = rng.choice(len(at), len(best))  # and windows of clean texts at random
        chosen = np.concatenate([best, calm[y[of[calm]] == 0]])
        passes = max(1, STEPS * BATCH // len(chosen))
        for portion in np.array_split(np.concatenate([rng.permutation(chosen) for _ in range(passes)]), max(1, passes * len(chosen) // BATCH)):
            for s in (0, 1):
                own = portion[half[of[portion]] == s]
                if not len(own):
                    continue
                _, grad = net.gradients(words, other[s], at[own], y[of[own]])
                step += 1
                rate = RATE * math.sqrt(1 - 0.999**step) / (1 - 0.9**step) / (1 + k)
                for name, g in grad.items():
                    m = moments[name]
                    m[0] *= 0.9
                    m[0] += 0.1 * g
                    m[1] *= 0.999
                    m[1] += 0.001 * g * g
                    net.p[name] -= (rate * m[0] / (np.sqrt(m[1]) + 1e-7)).astype(np.float32)
    return net


def fit_calibrated(texts: list[str], label: list[int]) -> Net | None:
    """The network for all texts; slope and shift of its scores come from one that has not seen a fifth of them."""
    net = fit(texts, label)
    fifth = np.random.default_rng(3).permutation(len(texts)) % 5 == 0
    part = lambda v, m: [x for x, k in zip(v, m, strict=True) if k]
    without = fit(part(texts, ~fifth), part(label, ~fifth)) if net is not None else None
    if without is None:
        return net
    p = Scorer(without).score(part(texts, fifth))
    p, y = p[p > 0], np.array(part(label, fifth))[p > 0]
    p = np.clip(p, 1e-6, 1 - 1e-6)
    z = np.log(p / (1 - p))
    x = np.stack([z, np.ones(len(z))], 1)
    prior, trust = np.array([1.0, 0.0]), np.array([4.0, 1.0])  # few texts leave the scores as they are

    def loss(w: np.ndarray) -> float:
        return np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + 0.5 * (trust * (w - prior) ** 2).sum()

    w = prior.copy()
    for _ in range(50):
        q = sigmoid(x @ w)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(trust), x.T @ (q - y) + trust * (w - prior))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-6:
            step /= 2
        w = w - step
    net.slope, net.shift = max(0.1, float(w[0])), float(w[1])
    return net


def window_logits(net: Net, gates: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logit of every window of rows of gates; row 0 is padding."""
    out = np.empty(len(at), np.float32)
    for k in range(0, len(at), SIDE_BY_SIDE):
        part = np.ascontiguousarray(at[k : k + SIDE_BY_SIDE].T)
        out[k : k + SIDE_BY_SIDE] = net.run(gates[part], part != 0)
    return out


class Scorer:
    """Scores batches of texts; remembers the gate inputs of words, up to a bound."""

    def __init__(self, net: Net):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.gates = np.zeros((1, 6 * HIDDEN), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.place) > REMEMBERED:
            self._forget()
        cut = [tokens(t) for t in texts]
        new = list({w for words in cut for w in words if w not in self.place})
        if new:
            self.place.update(zip(new, range(len(self.place) + 1, len(self.place) + 1 + len(new)), strict=True))
            self.gates = np.concatenate([self.gates, self.net.gates(self.net.inputs(new))])
        some = [k for k, w in enumerate(cut) if w]
        out = np.zeros(len(texts))
        if some:
            at, of = windows_of([np.fromiter(map(self.place.__getitem__, cut[k]), np.int64, len(cut[k])) for k in some])
            best = np.full(len(some), -np.inf)
            np.maximum.at(best, of, window_logits(self.net, self.gates, at))
            out[some] = sigmoid(self.net.slope * best + self.net.shift)
        return out


def sample_of(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> pd.DataFrame:
    """text and toxic of at most `most` labelled texts of each class, none held out."""
    own = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [own.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    ids = chosen[0].union(chosen[1])  # 2 * most rows at most
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return found.orderBy("doc_id").select("text", "toxic").toPandas()


_scorers: dict[str, Scorer] = {}


def with_score(docs: DataFrame, net: Net | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each text added."""
    if net is None:
        return docs.withColumn(out, F.lit(0.0))
    shared, name = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(_scorers[name].score(texts.tolist()))

    return docs.withColumn(out, score(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    small_batches(docs.sparkSession)
    known = sample_of(docs, labels, most)
    net = fit_calibrated(known["text"].tolist(), known["toxic"].astype(int).tolist())
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return with_score(rows, net).drop("text").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
